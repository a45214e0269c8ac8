"""Document fingerprints as invertible Bloom lookup sketches of paragraph digests.

A cell holds a count, the xor of the digests that fall into it, and the xor of their checks. Two sketches
subtract cell by cell; a cell left with one digest gives it away, and taking that digest out of its other
cells frees more (peeling). If that stops early, larger sketches are compared.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HASHES = 3
CELLS = 15
LARGE = 1 << 16
#: Paragraphs are cut after units (words, or letters of scripts without blanks) whose hash is a multiple of the number that
#: holds up to so many units of the text, and of CUT from there on, so that short texts have enough pieces and an edit changes few.
CUTS = ((32, 4), (256, 12))
CUT = 24
#: The text is also cut after so many units, and a text of fewer than SHORT characters is taken letter by letter. One that an
#: edit of its last third can make so short is taken both ways. A unit has at most two thirds of SHORT bytes, so the first
#: one is whole where two thirds of a longer text are kept.
FIRST = (1, 2, 4, 8, 16)
SHORT = 48
#: Bins for each of the session's shuffle partitions, which are set for the size of the data.
BINS = 4
#: Texts compared side by side have so many characters, or are two.
HELD_CHARACTERS = 1 << 20
_UNIT = re.compile(rb"(?:[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf7][\x80-\xbf]{3}|[^\s\xe0-\xf7]{1,32}|\S)\s*")
_LETTER = re.compile(rb"(?:[\xc0-\xff][\x80-\xbf]*|\S)\s*")

#: What the hash of each of the first units must be a multiple of, by its number; 1 where the text is always cut.
_EARLY = [0] + [1 if at in FIRST else next(cut for most, cut in CUTS if at <= most) for at in range(1, CUTS[-1][0] + 1)]


def _ends(units: list[bytes], passed: int) -> list[int]:
    """After how many units of a line it is cut; ``passed`` units of the text come before it."""
    hashes = map(xxhash.xxh32_intdigest, units)
    cuts = itertools.chain(_EARLY[passed + 1 :], itertools.repeat(CUT))
    return [i for i, (h, cut) in enumerate(zip(hashes, cuts, strict=False), 1) if h % cut == 0]


def _cut(lines: list[bytes], unit: re.Pattern) -> Iterator[bytes]:
    passed = 0
    for line in lines:
        units, begin = unit.findall(line), 0
        for end in _ends(units, passed):
            yield b"".join(units[begin:end]).rstrip()
            begin = end
        if begin < len(units):
            yield b"".join(units[begin:])
        passed += len(units)


def pieces(text: str) -> Iterator[bytes]:
    """Paragraphs (lines) with something in them, cut by their content."""
    lines = [line.encode("utf-8", "surrogatepass") for line in map(str.strip, text.split("\n")) if line]
    if 2 * len(text) < 3 * SHORT:
        yield from _cut(lines, _LETTER)
    if len(text) >= SHORT:
        yield from _cut(lines, _UNIT)


def digests(text: str) -> list[int]:
    """One number for each piece; a repeated piece is told apart by how often it came before."""
    seen: dict[bytes, int] = {}
    out = []
    for piece in pieces(text):
        before = seen.get(piece, 0)
        seen[piece] = before + 1
        out.append(xxhash.xxh64_intdigest(piece, before))
    return list(dict.fromkeys(out))


class Cells(NamedTuple):
    """Counts, digests and checks of the cells of one sketch, or of many in a row."""

    counts: np.ndarray
    digests: np.ndarray
    checks: np.ndarray

    def without(self, other: Cells) -> Cells:
        return Cells(self.counts - other.counts, self.digests ^ other.digests, self.checks ^ other.checks)


def _check(digests: np.ndarray) -> np.ndarray:
    return digests * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(32)


def _spots(digests: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """One cell in each of three parts of so many cells. Parts of more cells than 21 bits spread over take a 64-bit mix each."""
    of = parts.astype(np.uint64)
    mixed = (digests ^ digests >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    low = np.uint64(0x1FFFFF)
    spots = np.stack([(mixed & low) % of, (mixed >> np.uint64(21) & low) % of, (mixed >> np.uint64(42)) % of])
    large = np.flatnonzero(parts > LARGE)
    if len(large):
        first = mixed[large]
        second = (first ^ first >> np.uint64(33)) * np.uint64(0xC4CEB9FE1A85EC53)
        third = (second ^ second >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15)
        spots[:, large] = [(m ^ m >> np.uint64(32)) % of[large] for m in (first, second, third)]
    return spots.astype(np.int64) + np.arange(HASHES)[:, None] * parts


def _places(digest: int, cells: int) -> tuple[int, ...]:
    return tuple(_spots(np.array([digest], dtype=np.uint64), np.array([cells // HASHES]))[:, 0].tolist())


def _numbers(of: list[int] | np.ndarray) -> np.ndarray:
    return np.asarray(of, dtype=np.uint64)


def sketches(of: list[np.ndarray], sizes: np.ndarray) -> Cells:
    """The sketches of many sets of digests, one behind the other, each with its own number of cells."""
    owner = np.repeat(np.arange(len(of)), [len(x) for x in of])
    digests = np.concatenate([*of, np.zeros(0, dtype=np.uint64)])
    spots = (_spots(digests, sizes[owner] // HASHES) + (np.cumsum(sizes) - sizes)[owner]).ravel()
    made = Cells(np.bincount(spots, minlength=int(sizes.sum())), *np.zeros((2, int(sizes.sum())), dtype=np.uint64))
    np.bitwise_xor.at(made.digests, spots, np.tile(digests, HASHES))
    np.bitwise_xor.at(made.checks, spots, np.tile(_check(digests), HASHES))
    return made


def peeled(rest: Cells, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Digests left in subtracted sketches, their sketch and side, and whether each sketch was peeled whole.

    All cells with a single digest go at once, which frees the next ones. Changes ``rest``.
    """
    owner, start = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    look = np.arange(len(owner))
    for _ in range(2 + len(owner)):
        look = look[np.abs(rest.counts[look]) == 1]
        pure = look[_check(rest.digests[look]) == rest.checks[look]]
        if not len(pure):
            break
        # A digest may be alone in several of its cells.
        order = np.lexsort((rest.digests[pure], owner[pure]))
        pure = pure[order]
        new = np.ones(len(pure), dtype=bool)
        new[1:] = (owner[pure[1:]] != owner[pure[:-1]]) | (rest.digests[pure[1:]] != rest.digests[pure[:-1]])
        pure = pure[new]
        digests, own, sign = rest.digests[pure], owner[pure], rest.counts[pure]
        found.append((digests, own, sign))
        spots = (_spots(digests, sizes[own] // HASHES) + start[own]).ravel()
        np.subtract.at(rest.counts, spots, np.tile(sign, HASHES))
        np.bitwise_xor.at(rest.digests, spots, np.tile(digests, HASHES))
        np.bitwise_xor.at(rest.checks, spots, np.tile(_check(digests), HASHES))
        look = np.unique(spots)
    left = (rest.counts != 0) | (rest.digests != 0) | (rest.checks != 0)
    whole = np.bincount(owner[left], minlength=len(sizes)) == 0
    parts = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, dtype=t) for t in (np.uint64, np.int64, np.int64)]
    return *parts, whole


def sketch(of: list[int], cells: int = CELLS) -> Cells:
    return sketches([_numbers(of)], np.array([cells]))


def peel(left: Cells, right: Cells) -> tuple[set[int], set[int]] | None:
    """Digests only in the left sketch and only in the right one; None if peeling stops early."""
    digests, _, sign, whole = peeled(left.without(right), np.array([len(left.counts)]))
    return (set(digests[sign > 0].tolist()), set(digests[sign < 0].tolist())) if whole[0] else None


class Sketched:
    """A text and its digests."""

    def __init__(self, text: str):
        self.text, self.digests = text, digests(text)


def _after(size: int, many: int) -> int:
    """The size that follows one that failed: enough for sides that share nothing, then twice as many cells."""
    return HASHES << max(3, many.bit_length() - 1) if size == CELLS else 2 * size


def difference(left: Sketched, right: Sketched) -> tuple[set[int], set[int]]:
    """Digests on one side only, from the fingerprints or, where peeling these fails, from larger sketches."""
    size = CELLS
    while (found := peel(sketch(left.digests, size), sketch(right.digests, size))) is None:
        size = _after(size, len(left.digests) + len(right.digests))
    return found


def differing(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many digests are on one side only, for each pair; all pairs are compared side by side, as ``difference`` does."""
    many, out = [len(a) + len(b) for a, b in zip(left, right, strict=True)], np.zeros(len(left), dtype=np.int64)
    waiting, sizes = np.arange(len(left)), np.full(len(left), CELLS)
    while len(waiting):
        rest = sketches([left[i] for i in waiting], sizes).without(sketches([right[i] for i in waiting], sizes))
        _, own, _, whole = peeled(rest, sizes)
        out[waiting[whole]] = np.bincount(own, minlength=len(waiting))[whole]
        waiting, sizes = waiting[~whole], sizes[~whole]
        sizes = np.array([_after(int(s), many[i]) for i, s in zip(waiting, sizes, strict=True)], dtype=np.int64)
    return out


def likenesses(pairs: list[tuple[Sketched, Sketched]]) -> list[float]:
    """Share of digests on both sides, for each pair; 1 for two texts without any."""
    left, right = ([_numbers(p[k].digests) for p in pairs] for k in (0, 1))
    total = [len(a) + len(b) for a, b in zip(left, right, strict=True)]
    return [1 - d / t if t else 1.0 for d, t in zip(differing(left, right).tolist(), total, strict=True)]


def likeness(left: Sketched, right: Sketched) -> float:
    return likenesses([(left, right)])[0]


_PACKED = np.dtype([("count", ">u2"), ("digest", ">u8"), ("check", ">u4")])


def fingerprints(of: list[Sketched]) -> list[str]:
    """The sketch of each text as text: counts modulo 65,536, digests and checks, in base64."""
    cells = sketches([_numbers(x.digests) for x in of], np.full(len(of), CELLS))
    laid = np.zeros(len(cells.counts), dtype=_PACKED)
    laid["count"], laid["digest"], laid["check"] = cells.counts & 0xFFFF, cells.digests, cells.checks
    return [base64.b64encode(laid[at : at + CELLS].tobytes()).decode() for at in range(0, len(laid), CELLS)]


def edited(text: str, following: str) -> str:
    """The last third replaced by as many first characters of the following text."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def _bins(docs: DataFrame, key: str, bins: int) -> tuple[list[int], dict[int, int | None]]:
    """Bounds between bins of about as many keys each, and the first (largest) key of every bin that has rows.

    Gathered at the driver: two numbers for each bin.
    """
    shares = F.array(*(F.lit(i / bins) for i in range(1, bins)))
    bounds = docs.agg(F.percentile_approx(key, shares, F.lit(20 * bins)).alias("b")).first()["b"] or []
    bounds = sorted(set(bounds), reverse=True)
    rows = docs.groupBy(_bin(F.col(key), bounds).alias("bin")).agg(F.max(key).alias("first")).collect()
    return bounds, {r["bin"]: r["first"] for r in rows}


def _bin(key, bounds: list[int]):
    """Bins count down from the largest keys; rows without a key come last."""
    if not bounds:
        return F.when(key.isNull(), F.lit(1)).otherwise(F.lit(0))
    # Two steps, so that a row is compared with few bounds: every stride-th one, then those of one stride.
    stride = math.isqrt(len(bounds)) + 1
    coarse, fine = (F.array(*map(F.lit, some)) for some in (bounds[::stride], bounds))
    passed = F.size(F.filter(coarse, lambda b: b > key))
    within = F.size(F.filter(F.slice(fine, (F.greatest(passed, F.lit(1)) - 1) * stride + 1, F.lit(stride)), lambda b: b > key))
    above = F.when(passed == 0, F.lit(0)).otherwise((passed - 1) * stride + within)
    return F.when(key.isNull(), F.lit(len(bounds) + 1)).otherwise(above)


_RESULT = (
    "key long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _rows(pairs: list[tuple[int | None, Sketched, Sketched]]) -> pa.RecordBatch:
    """Result rows of (key, document, following document)."""
    own = [o for _, o, _ in pairs]
    new = [Sketched(edited(o.text, f.text)) for _, o, f in pairs]
    like = likenesses([*zip(own, new, strict=True), *((o, f) for _, o, f in pairs)])
    marks = fingerprints([*own, *new])
    columns = [
        [k for k, _, _ in pairs], [len(o.text) for o in own],
        [hashlib.sha256(n.text.encode("utf-8", "surrogatepass")).hexdigest() for n in new],
        marks[: len(own)], marks[len(own) :], like[: len(own)], like[len(own) :],
    ]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)], [c.split(" ")[0] for c in _RESULT.split(", ")]
    )


def versions(docs: DataFrame, text: str = "text", key: str = "doc_id", bins: int | None = None) -> DataFrame:
    """Fingerprints of each row of ``docs`` and of its edited text, and their likeness.

    The next document has the next smaller key, after the smallest the largest; rows without a key come
    after all others. Repeated keys follow each other by text. Null texts are empty ones; the only row of
    a table is its own next. An empty table gives no row; other columns are ignored. Texts move once, to
    bins of keys; the first document of a bin goes to the bin before it, too.
    """
    docs = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    bins = bins or BINS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds, first = _bins(docs, "key", bins)
    order = sorted(first)
    before = [(first[bin_], order[i - 1]) for i, bin_ in enumerate(order)]
    own = F.struct(_bin(F.col("key"), bounds).alias("bin"), F.lit(False).alias("lent"))
    lends = F.lit(None).cast("int")
    for without in (to for k, to in before if k is None):
        lends = F.when(F.col("key").isNull(), F.lit(without))
    named = [F.lit(x) for k, to in before if k is not None for x in (k, to)]
    if named:
        at = F.try_element_at(F.create_map(*named), F.col("key"))
        lends = F.when(F.col("key").isNotNull(), at).otherwise(lends)
    lent = F.when(lends.isNotNull(), F.struct(lends.alias("bin"), F.lit(True).alias("lent")))
    placed = docs.select("key", "text", F.inline(F.array_compact(F.array(own, lent))))
    dealt = placed.repartition("bin").sortWithinPartitions("bin", "lent", F.col("key").desc_nulls_last(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, bin_, pairs, held = None, None, [], 0
        for batch in batches:
            for at, lent, number, body in zip(*(batch.column(n) for n in ("bin", "lent", "key", "text")), strict=True):
                at, lent, number = at.as_py(), lent.as_py(), number.as_py()
                if lent and (waiting is None or at != bin_):
                    continue
                known = Sketched(body.as_py() or "")
                if waiting is not None:
                    pairs.append((*waiting, known))
                    held += len(known.text)
                waiting, bin_ = (None, at) if lent else ((number, known), at)
                if held > HELD_CHARACTERS:
                    yield _rows(pairs)
                    pairs, held = [], 0
        if pairs:
            yield _rows(pairs)

    return dealt.mapInArrow(run, _RESULT).withColumnRenamed("key", key)
