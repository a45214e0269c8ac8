"""SimHash fingerprints, and exact links between them through a forest of vantage-point trees.

The 64 bits are cut into ``bands`` runs. Two fingerprints at ``radius`` or fewer differing bits differ in
at most ``radius // bands`` bits of some run, so one tree for each run, searched with that smaller radius,
finds every link. A node of a tree measures the Hamming distance between a small group of the run's bits
and its vantage point, and has one child for each distance; a leaf is a shard. By the triangle inequality
a child can hold a match only if its distance is within the rest of the radius, and since the groups of
a path are disjoint, the bounds of its nodes add up. A fingerprint is stored in one shard of each tree and
asks the shards that such bounds cannot rule out; the whole fingerprints are compared there.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.frames import in_few_files, keyed
from weftline.llm.links import components, spanning
from weftline.session import cut_lineage

BITS = 64
SEED = 42
GROUP_BITS = 2
SHARD_ROWS = 4096
PAIRS_AT_ONCE = 1 << 18
LINKS_AT_ONCE = 1 << 17
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def fingerprint_of(text: str | None, words: int = 4) -> int:
    """The fingerprint of one text; 0 without a word."""
    tokens = _WORD.findall((text or "").translate(_LOWER))
    if not tokens:
        return 0
    parts = [t.encode() for t in tokens]
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = min(words, len(parts))
    count = len(parts) - size + 1
    digest = xxhash.xxh64_intdigest
    totals = np.zeros(BITS, dtype=np.int64)
    for low in range(0, count, 1 << 16):
        high = min(count, low + (1 << 16))
        spans = zip(starts[low:high].tolist(), ends[low + size - 1 : high + size - 1].tolist(), strict=True)
        hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in spans), dtype="<u8", count=high - low)
        totals += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * totals > count, bitorder="little").view("<u8")[0])


def fingerprint(text: Column, words: int = 4) -> Column:
    """SimHash of lower-cased (A-Z) word shingles, repeats included, as a signed long."""

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        made = np.array([fingerprint_of(t, words) for t in texts], dtype=np.uint64)
        return pd.Series(made.view(np.int64))

    return run(text)


def as_hex(value: Column) -> Column:
    """16 lowercase hex digits of a fingerprint."""
    return F.lpad(F.lower(F.hex(value)), 16, "0")


class Forest:
    """The trees: their vantage points, and the shards of fingerprints."""

    def __init__(self, radius: int = 4, bands: int = 3, group_bits: int = GROUP_BITS):
        self.radius, self.bands = radius, bands
        self.rest = radius // bands
        edges = [round(i * BITS / bands) for i in range(bands + 1)]
        self.trees = []
        for tree, (low, high) in enumerate(itertools.pairwise(edges)):
            groups = [(at, min(group_bits, high - at)) for at in range(low, high, group_bits)]
            vantage = xxhash.xxh64_intdigest(str(tree).encode(), SEED)
            strides = [(group_bits + 1) ** level for level in range(len(groups))]
            self.trees.append((vantage, groups, strides, self._moves(groups)))

    def _moves(self, groups: list[tuple[int, int]]) -> list[tuple[tuple[int, int], ...]]:
        """Changes of distances, as (level, change), that together stay within the tree's radius."""
        out: list[tuple[tuple[int, int], ...]] = []
        changes = [c for c in range(-self.rest, self.rest + 1) if c]
        for many in range(self.rest + 1):
            for levels in itertools.combinations(range(len(groups)), many):
                for steps in itertools.product(changes, repeat=many):
                    if sum(map(abs, steps)) <= self.rest:
                        out.append(tuple(zip(levels, steps, strict=True)))
        return out

    def shards(self, prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """(rows, shard of each, stored there) of every tree: the home shard, then those to be asked.

        Of two shards that may hold a pair, the lower asks the higher one.
        """
        for tree, (vantage, groups, strides, moves) in enumerate(self.trees):
            away = prints ^ np.uint64(vantage)
            rings = [
                np.bitwise_count(away >> np.uint64(at) & np.uint64((1 << size) - 1)).astype(np.int64)
                for at, size in groups
            ]
            home = np.int64(tree) << 56
            home = home + sum(r * s for r, s in zip(rings, strides, strict=True))
            for move in moves:
                offset = sum(step * strides[level] for level, step in move)
                if not move:
                    yield np.arange(len(prints)), home, True
                elif offset > 0:
                    inside = np.ones(len(prints), dtype=bool)
                    for level, step in move:
                        inside &= (rings[level] + step >= 0) & (rings[level] + step <= groups[level][1])
                    rows = np.flatnonzero(inside)
                    yield rows, home[rows] + offset, False


def _shard_rows(prints: DataFrame, forest: Forest, homes_only: bool = False) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
            for rows, shard, stored in forest.shards(own.view(np.uint64)):
                if stored or not homes_only:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(shard), pa.array(np.full(len(rows), not stored)), pa.array(own[rows])],
                        ["shard", "asks", "fp"],
                    )

    return prints.select("fp").mapInArrow(run, "shard long, asks boolean, fp long")


def _in_blocks(rows: DataFrame, homes: DataFrame, shard_rows: int) -> DataFrame:
    """Shards above ``shard_rows`` are stored in blocks; what asks such a shard asks every block."""
    large = (
        homes.groupBy("shard").count().where(F.col("count") > shard_rows)
        .select("shard", F.ceil(F.col("count") / shard_rows).cast("int").alias("blocks"))
    )
    own = F.pmod(F.xxhash64("fp"), "blocks").cast("int")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    later = F.when(F.col("asks"), every).otherwise(F.filter(every, lambda b: b >= own))
    split = rows.join(large, "shard", "left").select(
        "shard", "fp", "asks", F.coalesce("blocks", F.lit(1)).alias("blocks")
    )
    return split.select("shard", "fp", "asks", own.alias("own"), F.explode(later).alias("block")).select(
        "shard", "block", (F.col("asks") | (F.col("own") != F.col("block"))).alias("asks"), "fp"
    )


def _starts(shard: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Where runs of one shard and block begin."""
    changed = (shard[1:] != shard[:-1]) | (block[1:] != block[:-1])
    return np.flatnonzero(np.concatenate([[True], changed]))


def _close(first: np.ndarray, asks: np.ndarray, fp: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links within each run: of stored rows among themselves and of asking rows to stored ones."""
    sizes = np.diff(np.append(first, len(fp)))
    stored_end = first + np.add.reduceat((~asks).astype(np.int64), first)
    begin = np.where(asks, np.repeat(first, sizes), np.arange(len(fp)) + 1)
    many = np.maximum(np.repeat(stored_end, sizes) - begin, 0)
    total = np.cumsum(many)
    low = 0
    while low < len(fp):
        high = max(low + 1, int(np.searchsorted(total, total[low] - many[low] + PAIRS_AT_ONCE, side="right")))
        count = many[low:high]
        a = np.repeat(np.arange(low, high), count)
        b = np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin[low:high], count)
        near = np.bitwise_count(fp[a] ^ fp[b]) <= radius
        a, b = a[near], b[near]
        if len(a):
            yield fp[a].view(np.int64), fp[b].view(np.int64)
        low = high


def _search(rows: DataFrame, radius: int) -> DataFrame:
    """Links found shard by shard. What a task gives out is bounded by its nodes, not by its pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        found: list[tuple[np.ndarray, np.ndarray]] = []

        def give(links: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(links[0]), pa.array(links[1])], ["a", "b"])

        def reduced() -> tuple[np.ndarray, np.ndarray]:
            return spanning(np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found]))

        def search(rows: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
            shard, block, asks, fp = rows
            for links in _close(_starts(shard, block), asks.astype(bool), fp.view(np.uint64), radius):
                found.append(links)
                if sum(len(x) for x, _ in found) > LINKS_AT_ONCE:
                    found[:] = [reduced()]
                    if len(found[0][0]) > LINKS_AT_ONCE // 2:
                        yield give(found.pop())

        def joined() -> tuple[np.ndarray, ...]:
            return tuple(np.concatenate(x) for x in zip(*held, strict=True))

        for batch in batches:
            if not batch.num_rows:
                continue
            new = tuple(batch.column(n).to_numpy(zero_copy_only=False) for n in ("shard", "block", "asks", "fp"))
            same_run = bool(held) and held[0][0][0] == new[0][-1] and held[0][1][0] == new[1][-1]
            held.append(new)
            if not same_run:
                rows = joined()
                cut = int(_starts(rows[0], rows[1])[-1])
                held[:] = [tuple(x[cut:] for x in rows)]
                if cut:
                    yield from search(tuple(x[:cut] for x in rows))
        if held:
            yield from search(joined())
        if found:
            yield give(reduced())

    dealt = rows.repartition("shard", "block").sortWithinPartitions("shard", "block", "asks")
    return dealt.mapInArrow(run, "a long, b long")


def links(prints: DataFrame, radius: int = 4, bands: int = 3, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Links (a, b) that connect exactly the distinct fingerprints ``fp`` reachable in steps of ``radius`` bits.

    Between fingerprints of one dense group only as many links are given as connect it.
    """
    forest = Forest(radius, bands)
    rows = _in_blocks(_shard_rows(prints, forest), _shard_rows(prints, forest, homes_only=True), shard_rows)
    return _search(rows, radius)


def classes(
    prints: DataFrame, radius: int = 4, bands: int = 3, shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """(fp, component) from rows (key, fp): the smallest key among the fingerprints reachable through links."""
    nodes = cut_lineage(prints.groupBy("fp").agg(F.min("key").alias("least")))
    many = nodes.count()
    roots = components(links(nodes, radius, bands, shard_rows))
    placed = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    placed = cut_lineage(in_few_files(placed, many))
    least = cut_lineage(in_few_files(placed.groupBy("root").agg(F.min("least").alias("component")), many))
    return cut_lineage(in_few_files(placed.join(least, "root").select("fp", "component"), many))


def near_duplicates(
    docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = 4, radius: int = 4, bands: int = 3,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """(key, fp, component): the smallest key among documents reachable through links.

    One row for each row of ``docs``; other columns are not looked at. A null or blank text has the
    fingerprint 0 and is linked like any other; repeated rows share their component. A null key never
    is a component unless all its members have none. An empty table gives no row.
    """
    prints = cut_lineage(docs.select(F.col(key).alias("key"), fingerprint(F.col(text), words).alias("fp")))
    named = classes(prints, radius, bands, shard_rows)
    return prints.join(named, "fp").select(F.col("key").alias(key), "fp", "component")


def representatives(
    docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = 5, radius: int = 7, bands: int = 4,
) -> DataFrame:
    """One row of each group of linked documents, with the columns of ``docs``: the one with the smallest key.

    Keys may be null (such a row stays only if its whole group has none) or repeated (one of the rows
    stays). Texts are read once for the fingerprints, and move once, to the rows that stay.
    """
    rows, (one, two) = keyed(docs)
    rank = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.col(one).alias("one"), F.col(two).alias("two"))
    prints = cut_lineage(rows.select(rank.alias("key"), fingerprint(F.col(text), words).alias("fp")))
    found = classes(prints, radius, bands)
    first = found.select(F.col("component.one").alias(one), F.col("component.two").alias(two)).distinct()
    return rows.join(first, [one, two], "left_semi").select(*docs.columns)
