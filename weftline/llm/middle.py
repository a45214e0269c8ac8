"""Fill-in-the-middle: cut texts at code points and reorder the parts.

Code points are found eight bytes at a time: the UTF-8 bytes are viewed as 64-bit words, the bytes that end a
code point are marked by arithmetic on the words, set marks are counted by word, and a cut is found by a search in
the running counts and a select within one word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.buffers import text_blocks

MARKS = ("<P>", "<S>", "<M>")
PLAIN, PSM, SPM = "plain", "psm", "spm"
_HIGH = np.uint64(0x8080808080808080)
_ONES = np.uint64(0x0101010101010101)


class CodePoints:
    """Where the code points of a piece of UTF-8 end."""

    def __init__(self, data: np.ndarray) -> None:
        padded = np.zeros((len(data) // 8 + 2) * 8, dtype=np.uint8)
        padded[: len(data)] = data
        words = padded.view("<u8")
        # A byte goes on with a code point if its top bits are 10; padding starts new ones.
        opens = ~(words & ~(words << np.uint64(1))) & _HIGH
        # A byte ends a code point if the next byte opens one.
        self.ends = (opens[:-1] >> np.uint64(8)) | (opens[1:] << np.uint64(56))
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.ends), dtype=np.int64)])

    def count(self, ends: np.ndarray) -> np.ndarray:
        """Code points that end within the first bytes, for each number of bytes."""
        word, rest = ends >> 3, (ends & 7).astype(np.uint64)
        below = np.where(rest > 0, (np.uint64(1) << (rest * np.uint64(8))) - np.uint64(1), np.uint64(0))
        return self.before[word] + np.bitwise_count(self.ends[word] & below)

    def after(self, units: np.ndarray) -> np.ndarray:
        """Bytes that so many code points take up."""
        word = np.maximum(np.searchsorted(self.before, units, "left") - 1, 0)
        rank = (units - self.before[word]).astype(np.uint64)
        # Marks up to each byte, in that byte; those below the rank come before the byte that is looked for.
        running = (self.ends[word] >> np.uint64(7)) * _ONES
        reached = ((running | _HIGH) - rank * _ONES) & _HIGH
        inside = 9 - np.bitwise_count(reached).astype(np.int64)
        return np.where(units > 0, word * 8 + inside, 0)


def assembled(prefix: bytes, middle: bytes, suffix: bytes, form: str, marks: Sequence[bytes]) -> bytes:
    p, s, m = marks
    return b"".join((p, prefix, s, suffix, m, middle) if form == PSM else (s, suffix, p, prefix, m, middle))


def restored(output: bytes, form: str, marks: Sequence[bytes]) -> bytes:
    """The text an output was made from: its parts between the marks, in the order of the text."""
    if form == PLAIN:
        return output
    p, s, m = marks
    first, second = (p, s) if form == PSM else (s, p)
    one, _, rest = output.removeprefix(first).partition(second)
    two, _, middle = rest.partition(m)
    return b"".join((one, middle, two) if form == PSM else (two, middle, one))


def _checked(marks: Sequence[str]) -> list[bytes]:
    """Marks that cannot be found anywhere but where they were put."""
    if len(marks) != 3 or len(set(marks)) != 3 or not all(marks):
        raise ValueError("three different marks are needed")
    if any(a[0] in b[1:] for a in marks for b in marks):
        raise ValueError("no mark may hold the first character of a mark after its own first")
    return [m.encode() for m in marks]


def _transformed(text: bytes, low: int, high: int, form: str, marks: Sequence[bytes]) -> tuple[str, bytes]:
    if not text or form == PLAIN or any(m in text for m in marks):
        return PLAIN, text
    return form, assembled(text[:low], text[low:high], text[high:], form, marks)


def infilled(
    docs: DataFrame, text: str = "text", key: str = "doc_id", seed: str = "1", plain_percent: int = 10,
    spm_percent: int = 20, marks: Sequence[str] = MARKS, with_output: bool = True,
) -> DataFrame:
    """(key, n, form, prefix_chars, middle_chars, output, output_sha256, restored_sha256) for each row of ``docs``.

    Four numbers drawn from a hash of seed and key say where a text is cut in two places, whether it stays plain, and
    which part comes first. Texts that are null (empty), empty or hold a mark stay plain, with null lengths. A null key
    draws as an empty one; repeated rows get the same result each. Texts are cut whole, of any length; other columns are
    not looked at, and an empty table gives no rows. ``with_output=False`` leaves the output out.
    """
    used = _checked(marks)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"), 256)
    draws = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i}") for i in range(4)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(2, 6)]
            done = 0
            for data, offsets in text_blocks(batch.column(1)):
                many = len(offsets) - 1
                rows, points, raw = slice(done, done + many), CodePoints(data), data.tobytes()
                counted = points.count(offsets)
                n = np.diff(counted)
                cuts = np.sort(np.stack([h[0][rows] % (n + 1), h[1][rows] % (n + 1)]), axis=0)
                low, high = (points.after(counted[:-1] + c) for c in cuts)
                asked = np.where(h[2][rows] % 100 >= 100 - plain_percent, PLAIN, np.where(h[3][rows] % 100 < spm_percent, SPM, PSM))
                forms, outputs, again = [], [], []
                for i in range(many):
                    start, end = offsets[i], offsets[i + 1]
                    form, out = _transformed(raw[start:end], low[i] - start, high[i] - start, asked[i], used)
                    forms.append(form)
                    outputs.append(out)
                    again.append(hashlib.sha256(restored(out, form, used)).hexdigest())
                plain = np.array(forms) == PLAIN
                columns = [
                    batch.column(0).slice(done, many), pa.array(n), pa.array(forms),
                    pa.array(cuts[0], mask=plain), pa.array(cuts[1] - cuts[0], mask=plain),
                ]
                columns += [pa.array(outputs, type=pa.binary()).cast(pa.string())] if with_output else []
                columns += [pa.array([hashlib.sha256(o).hexdigest() for o in outputs]), pa.array(again)]
                yield pa.RecordBatch.from_arrays(columns, names)
                done += many

    kind = docs.select(F.col(key)).schema[0].dataType.simpleString()
    schema = f"key {kind}, n long, form string, prefix_chars long, middle_chars long"
    schema += (", output string" if with_output else "") + ", output_sha256 string, restored_sha256 string"
    names = [part.strip().split(" ")[0] for part in schema.split(", ")]
    made = docs.select(F.col(key).alias("key"), F.col(text), *draws).mapInArrow(run, schema)
    return made.withColumnRenamed("key", key)
