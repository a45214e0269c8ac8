"""Secrets in text: assignments, access keys and hex runs, and encoded keys confirmed by their structure.

Base spans are plain matches. Further spans are reported only after decoding: base64 or hex that holds a
private key in nested type-length-value form, key files with length-prefixed fields, framed keys, and
signed tokens whose header names an algorithm. Encodings may be wrapped over lines and stand behind '-', '_'
or '/'; text that they decode to is looked through in the same way.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import struct
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The base patterns and their least lengths.
ASSIGN = re.compile(
    r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE, LEAST_ACCESS = 6, 20

KINDS = ("assign", "access", "hex", "der", "jwt", "openssh", "pem")
_BREAK = r"[\x20\t]*(?:\r?\n|(?:\\r)?\\n)[\x20\t]*"
_ENCODED = re.compile(rf"[A-Za-z0-9+/_-]{{16,}}(?:{_BREAK}[A-Za-z0-9+/_-]+)*={{0,2}}")
_HEX_RUN = re.compile(rf"(?<![0-9A-Fa-f])[0-9A-Fa-f]{{16,}}(?:{_BREAK}[0-9A-Fa-f]+(?![0-9A-Za-z]))*(?![0-9A-Fa-f])")
_GAP = re.compile(_BREAK)
_LEAST_ENCODED, _LEAST_HEX = 32, 48
_GLUE = re.compile(r"[-_/]+")
_SIGNED = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]*")
_FRAME = re.compile(
    r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----((?:(?:\s|\\[rn])*[A-Za-z][A-Za-z0-9-]*:[^\r\n\\]*(?:\r?\n|(?:\\r)?\\n))*)"
    r"([A-Za-z0-9+/=\s\\]*?)-----END \1-----"
)
# The three forms of '-----BEGIN ' in base64, by the place of its first letter among four.
_FRAMES_INSIDE = re.compile(r"LS0tLS1CRUdJTi|0tLS0tQkVHSU4g|tLS0tLUJFR0lOI")
_PLACE = {"L": 0, "0": 2, "t": 3}
_HEX_FRAME = b"-----BEGIN ".hex()
# PKCS#5 and PKCS#12 password-based encryption.
_ENCRYPTIONS = (b"\x06\x09\x2a\x86\x48\x86\xf7\x0d\x01\x05", b"\x06\x0a\x2a\x86\x48\x86\xf7\x0d\x01\x0c\x01")
_OPENSSH = b"openssh-key-v1\0"
_OPENSSH_64 = "b3BlbnNzaC1rZXktdjEA"
_DEPTH = 8
#: Encodings inside encodings are followed so deep.
_LAYERS = 4

SPANS = "array<struct<kind:string,start:int,end:int>>"


def decoded(run: str) -> bytes | None:
    """Bytes of base64 (either alphabet, padding or none); None if it is no such text."""
    plain = run.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(plain + "=" * (-len(plain) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def elements(data: bytes) -> list[tuple[int, bytes]] | None:
    """Tags and contents of type-length-value elements that fill the bytes exactly; else None."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size >= 0x80:
            many = size & 0x7F
            if not 1 <= many <= 4 or at + many > len(data):
                return None
            size, at = int.from_bytes(data[at : at + many]), at + many
        if at + size > len(data):
            return None
        out.append((tag, data[at : at + size]))
        at += size
    return out


def nested(data: bytes, depth: int = _DEPTH) -> bool:
    """Whether every constructed element's lengths add up inside it."""
    found = elements(data)
    if found is None or not depth:
        return False
    return all(nested(body, depth - 1) for tag, body in found if tag & 0x20 and body)


def is_private_der(data: bytes) -> bool:
    """A sequence that starts with a small version and goes on like a private key: numbers, an algorithm or an octet string."""
    if data[:1] != b"\x30":
        return False
    outer = elements(data)
    if outer is None or len(outer) != 1:
        return False
    inner = elements(outer[0][1])
    if not inner or len(inner) < 2 or inner[0][0] != 2 or len(inner[0][1]) != 1 or inner[0][1][0] > 3:
        return False
    second = inner[1][0]
    shaped = (
        second == 0x04
        or (second == 0x30 and len(inner) > 2 and inner[2][0] == 0x04 and inner[1][1][:1] == b"\x06")
        or (second == 0x02 and len(inner) >= 6 and all(tag == 2 for tag, _ in inner[:6]))
    )
    return shaped and nested(data)


def is_encrypted_der(data: bytes) -> bool:
    """A sequence of a password-based encryption algorithm and an octet string."""
    outer = elements(data) if data[:1] == b"\x30" else None
    inner = elements(outer[0][1]) if outer and len(outer) == 1 else None
    if not inner or [tag for tag, _ in inner] != [0x30, 0x04]:
        return False
    return inner[0][1].startswith(_ENCRYPTIONS) and nested(data)


def is_key_der(data: bytes) -> bool:
    return is_private_der(data) or is_encrypted_der(data)


def der_size(head: bytes) -> int | None:
    """Bytes of a sequence by its own length; None if the bytes start no sequence."""
    if len(head) < 2 or head[0] != 0x30:
        return None
    many = head[1] & 0x7F
    if head[1] < 0x80:
        return 2 + many
    return 2 + many + int.from_bytes(head[2 : 2 + many]) if 1 <= many <= 4 and len(head) >= 2 + many else None


def _openssh_size(data: bytes) -> int | None:
    """Bytes of a key file by its own lengths; None if it is no such file, all bytes if a later length does not hold."""
    if not data.startswith(_OPENSSH):
        return None
    at = len(_OPENSSH)
    for _ in range(3):
        if at + 4 > len(data):
            return None
        (size,) = struct.unpack_from(">I", data, at)
        at += 4 + size
    if at + 4 > len(data):
        return None
    (keys,) = struct.unpack_from(">I", data, at)
    if not 1 <= keys <= 64:
        return None
    at += 4
    for _ in range(keys + 1):
        if at + 4 > len(data):
            return len(data)
        (size,) = struct.unpack_from(">I", data, at)
        at += 4 + size
    return min(at, len(data))


def is_openssh(data: bytes) -> bool:
    """The file mark, then cipher, key derivation and its options, each with its length, and a count of keys."""
    return _openssh_size(data) is not None


def is_signed_token(run: str) -> bool:
    """Header and claims decode to objects, and the header names its algorithm."""
    header, claims = run.split(".")[:2]
    try:
        head, body = (json.loads(decoded(part) or b"") for part in (header, claims))
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(body, dict)


def _is_framed_key(headers: str, body: bytes) -> bool:
    """What a frame holds: a key, or by its headers a ciphertext of whole blocks."""
    if is_key_der(body) or is_openssh(body):
        return True
    sealed = re.search(r"Proc-Type:\s*4,\s*ENCRYPTED", headers) and "DEK-Info:" in headers
    return bool(sealed) and len(body) >= 16 and len(body) % 8 == 0


def _start(run: str) -> bytes:
    """Bytes of base64 up to the last whole one."""
    return decoded(run[: len(run) - (len(run) % 4 == 1)]) or b""


def _read(data: bytes, layers: int) -> list[tuple[str, int, int]]:
    """Spans confirmed in decoded bytes; a rest of blanks belongs to the span before it."""
    found = list(confirmed(data.decode("latin-1"), layers - 1)) if layers else []
    return [(kind, at, end if data[end:].strip() else len(data)) for kind, at, end in found]


def _in_base64(run: str, lines: list[int], layers: int) -> Iterator[tuple[str, int, int]]:
    """Keys in base64 without breaks or padding, at its start or that of a line or behind '-', '_' or '/'."""
    ends = {*lines, len(run)}
    for at in sorted({*lines, *(m.end() for m in _GLUE.finditer(run))}):
        if run.startswith("M", at):
            size = der_size(decoded(run[at : at + 8]) or b"")
            end = at - (-4 * size // 3) if size else len(run) + 1
            if end - at < _LEAST_ENCODED or not (end in ends or end < len(run) and run[end] in "-_/"):
                continue
            body = decoded(run[at:end])
            if body and len(body) == size and is_key_der(body):
                yield "der", at, end
        elif run.startswith(_OPENSSH_64, at):
            body = _start(run[at:])
            if size := _openssh_size(body):
                yield "openssh", at, len(run) if size == len(body) else at - (-4 * size // 3)
    # The decoding of the whole run if it is text, and from the first frame of each of the four alignments on.
    first: dict[int, int] = {}
    for m in _FRAMES_INSIDE.finditer(run):
        at = m.start() - _PLACE[m[0][0]]
        first.setdefault(at % 4, at)
    whole = _start(run) if layers else b""
    if 0 not in first and whole and whole.isascii():
        first[0] = 0
    for at in first.values():
        body = _start("A" * max(0, -at) + run[max(0, at) :])
        for kind, low, high in _read(body, layers):
            end = len(run) if high == len(body) else at - (-4 * high // 3)
            yield kind, max(0, at + 4 * low // 3), end


def _in_hex(run: str, lines: list[int], layers: int) -> Iterator[tuple[str, int, int]]:
    """Keys in hex digits without breaks, at their start or that of a line."""
    ends = {*lines, len(run)}
    small = run.lower()
    mark = _OPENSSH.hex()
    for at in lines:
        if small.startswith("30", at):
            head = small[at : at + 12]
            size = der_size(bytes.fromhex(head[: len(head) // 2 * 2]))
            end = at + 2 * (size or 0)
            if end - at >= _LEAST_HEX and end in ends and is_key_der(bytes.fromhex(run[at:end])):
                yield "der", at, end
        elif small.startswith(mark, at):
            body = bytes.fromhex(run[at : len(run) - (len(run) - at) % 2])
            if size := _openssh_size(body):
                yield "openssh", at, len(run) if size == len(body) else at + 2 * size
    at = small.find(_HEX_FRAME)
    if at < 0:
        whole = bytes.fromhex(run[: len(run) - len(run) % 2]) if layers else b""
        at = 0 if whole.isascii() else -1
    if at >= 0:
        body = bytes.fromhex(run[at : len(run) - (len(run) - at) % 2])
        for kind, low, high in _read(body, layers):
            yield kind, at + 2 * low, len(run) if high == len(body) else at + 2 * high


def _unwrapped(m: re.Match) -> tuple[str, list[int], list[int]]:
    """A match without breaks and padding, where its lines start in it, and where they start in the text."""
    inside, outside, parts, at = [], [], [], 0
    low = m.start()
    for gap in [*_GAP.finditer(m[0]), None]:
        part = m[0][low - m.start() : gap.start() if gap else len(m[0].rstrip("="))]
        inside.append(at)
        outside.append(low)
        parts.append(part)
        at += len(part)
        low = m.start() + gap.end() if gap else low
    return "".join(parts), inside, outside


def confirmed(text: str, layers: int = _LAYERS) -> Iterator[tuple[str, int, int]]:
    """Spans of candidates whose decoded structure holds."""
    framed = []
    for m in _FRAME.finditer(text):
        body = decoded("".join(re.sub(r"\\[rn]", "", m[3]).split()))
        if body and _is_framed_key(m[2], body):
            framed.append(m.span())
            yield "pem", *m.span()
    for pattern, least, keys in ((_ENCODED, _LEAST_ENCODED, _in_base64), (_HEX_RUN, _LEAST_HEX, _in_hex)):
        for m in pattern.finditer(text):
            if m.end() - m.start() < least:
                continue
            run, inside, outside = _unwrapped(m)
            if len(run) < least:
                continue
            for kind, low, high in keys(run, inside, layers):
                line = bisect_right(inside, low) - 1
                start = outside[line] + low - inside[line]
                line = bisect_right(inside, high - 1) - 1
                end = m.end() if high == len(run) else outside[line] + high - inside[line]
                # What a frame holds in parts is reported with it.
                if (start, end) == m.span() and len(inside) == 1 or not any(a <= start and end <= b for a, b in framed):
                    yield kind, start, end
    for m in _SIGNED.finditer(text):
        if m[0].startswith("e") and is_signed_token(m[0]):
            yield "jwt", *m.span()


def spans_of(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points by start, then by kind as listed."""
    if not text:
        return []
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[1]) >= LEAST_VALUE]
    found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    found += confirmed(text)
    return sorted(set(found), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def spans(text: Column) -> Column:
    """All spans of a text column, an empty list for null and empty texts.

    Texts are scanned whole, of any length; equal texts have equal spans, of ties in place the kind listed first
    comes first. An empty table gives no rows; no other column is looked at.
    """

    @F.pandas_udf(SPANS)
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in spans_of(t)] for t in texts])

    return run(text)


def redacted_of(text: str | None) -> str | None:
    """The text with every maximal stretch of spans replaced by the kind of its first one in brackets."""
    if not text:
        return text
    out, done = [], 0
    stretch: tuple[str, int, int] | None = None
    for kind, start, end in [*spans_of(text), ("", len(text), len(text))]:
        if stretch and start < stretch[2]:
            stretch = (stretch[0], stretch[1], max(end, stretch[2]))
            continue
        if stretch:
            out += [text[done : stretch[1]], f"[{stretch[0]}]"]
            done = stretch[2]
        stretch = (kind, start, end)
    return "".join([*out, text[done:]])


def redacted(text: Column) -> Column:
    """The text column with its secrets taken out; null stays null and empty stays empty.

    Texts are scanned whole, of any length; equal texts come out equal. An empty table gives no rows; no other column is
    looked at.
    """

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([redacted_of(t) for t in texts], dtype=object)

    return run(text)
