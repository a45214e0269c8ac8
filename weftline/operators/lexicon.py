"""Lexicons compiled to one literal table, so that tokens are looked up within their row.

Each word stands in one of the two slots its hash names (cuckoo placement), so a lookup is two comparisons
whatever the size of the lexicon, and needs no join.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lexicons up to so many bytes of text are compiled; larger ones are joined.
COMPILED_BYTES = 1 << 20
#: Bits of a filter: a literal of 128 KB.
FILTER_BITS = 1 << 20
_SEEDS = range(7, 27)
_MOVES = 500


def _slots(word: Column, seed: int, size: int) -> list[Column]:
    digest = F.xxhash64(word, F.lit(seed))
    return [F.shiftright(digest, k).bitwiseAND(F.lit(size - 1)).cast("int") for k in (0, 32)]


def _placed(homes: list[tuple[int, int]], size: int) -> list[int | None] | None:
    """Which entry lies in each slot, every entry in one of its two; None if they do not fit."""
    table: list[int | None] = [None] * size
    for entry in range(len(homes)):
        moving, at = entry, homes[entry][0]
        for _ in range(_MOVES):
            moving, table[at] = table[at], moving
            if moving is None:
                break
            first, second = homes[moving]
            at = second if at == first else first
        else:
            return None
    return table


@dataclass(frozen=True)
class Compiled:
    """A lexicon as columns of one row-independent value: words, and for each a number and an array by slot."""

    words: Column
    marks: Column
    slots: Column
    seed: int
    size: int

    def at(self, word: Column) -> Column:
        """Where a word lies, else null."""
        first, second = _slots(word, self.seed, self.size)
        return F.when(F.get(self.words, first) == word, first).when(F.get(self.words, second) == word, second)

    def mark(self, word: Column) -> Column:
        """The number a word has, else 0."""
        first, second = _slots(word, self.seed, self.size)
        return (
            F.when(F.get(self.words, first) == word, F.get(self.marks, first))
            .when(F.get(self.words, second) == word, F.get(self.marks, second))
            .otherwise(0)
        )

    def values(self, word: Column) -> Column:
        """The (family, value) entries of a word; null for other words."""
        return F.get(self.slots, self.at(word))


def compile_entries(entries: DataFrame, marks: dict[str, int], most_bytes: int = COMPILED_BYTES) -> Compiled | None:
    """(surface, mark, slots) rows, one for each surface, and words with a fixed mark as a compiled lexicon.

    None if the entries take more than ``most_bytes``, which is measured before any is gathered.
    """
    sized = entries.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    if sized > most_bytes:
        return None
    found = {r["surface"]: [r["mark"], [(s["family"], s["value"]) for s in r["slots"]]] for r in entries.collect()}
    for word, mark in marks.items():
        found.setdefault(word, [0, []])[0] |= mark
    words = sorted(found)
    size = 1 << max(2, (3 * len(words)).bit_length())
    for seed in _SEEDS:
        homes = entries.sparkSession.createDataFrame([(w,) for w in words], "w string").select(*_slots(F.col("w"), seed, size)).collect()
        table = _placed([tuple(h) for h in homes], size)
        if table is not None:
            break
    else:
        raise ValueError("the entries cannot be placed")

    def literal(values: Sequence, kind: str) -> Column:
        return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")

    def column(read) -> list:
        return [None if e is None else read(words[e]) for e in table]

    slots = column(lambda w: [{"family": f, "value": v} for f, v in found[w][1]])
    return Compiled(
        literal(column(lambda w: w), "string"), literal(column(lambda w: found[w][0]), "int"),
        literal(slots, "array<struct<family:string,value:string>>"), seed, size,
    )


def bit_filter(words: DataFrame, bits: int = FILTER_BITS) -> Callable[[Column], Column]:
    """A test that every word of a one-column table passes, and few others, from one literal of fixed size.

    Bits are set by an aggregate; the driver gathers at most one number for 64 of them, however many words there are.
    """
    spot = lambda word: F.xxhash64(word).bitwiseAND(F.lit(bits - 1))
    at = words.select(spot(F.col(words.columns[0])).alias("at"))
    set_ = at.groupBy(F.shiftright("at", 6).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(F.lit(63)).cast("int"))).alias("mask")
    )
    masks = [0] * (bits // 64)
    for row in set_.collect():
        masks[row["word"]] = row["mask"]
    table = F.from_json(F.lit(json.dumps(masks)), "array<bigint>")

    def may_be(word: Column) -> Column:
        mask = F.get(table, F.shiftright(spot(word), 6).cast("int"))
        return F.call_function("shiftright", mask, spot(word).bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1

    return may_be


def has(mark: Column, *bits: int) -> Column:
    """Whether a number has one of the bits."""
    return mark.bitwiseAND(F.lit(reduce(lambda a, b: a | b, bits))) != 0
