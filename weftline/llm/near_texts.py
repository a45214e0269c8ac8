"""Near-duplicate texts: a forest over fingerprints names candidates, sets of word shingles decide.

Texts with the same set of shingles are one node. Nodes meet in the shards of vantage-point trees over runs
of the fingerprint's bits, asked one bit around, and are candidates within ``radius`` bits of the whole
fingerprint if the sizes of their sets allow the similarity and so do 64 one-bit MinHashes, which rule out the
unrelated texts that are near by chance (their number grows with the square of the texts). A first search gives the nodes that have
candidates, no pairs; these are dealt again with the parities of their sets, which rule out a pair where it meets, before it is a row.
Two more searches keep dense groups linear: one gives each node no more than its smallest neighbours, whose exact
similarity links classes; the other gives every candidate pair whose ends are still in different classes.

Fingerprints and MinHashes miss some similar pairs, so nodes that are still in different classes meet once more by their rarest
shingles: sets that share four fifths have one in common among the first fifth of each, in any order that holds for all sets.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.frames import in_few_files, keyed
from weftline.llm.links import components
from weftline.llm.simhash import BITS, LINKS_AT_ONCE, PAIRS_AT_ONCE, SEED, SHARD_ROWS, Forest
from weftline.session import cut_lineage, written

#: Similar are sets that share four fifths of their union.
PART, WHOLE = 4, 5
RADIUS = 14
BANDS = 5
#: Unrelated texts are hardly ever so near.
TIGHT = 7
#: MinHash bits that may differ. One differs with half of one minus the similarity: 0.1 at 0.8, where 17 or more of 64
#: do once in 5,000 pairs; of unrelated texts 32 differ, and 16 or fewer once in 25,000 pairs.
MOST_APART = 16
#: Words of 64 parities of pairs that are compared at once (16 MB).
PARITIES_AT_ONCE = 1 << 21
#: A shingle is common if so many texts of a task have it, among so many shingles looked at once; so many at most are sent out.
OFTEN, SHINGLES_AT_ONCE, MOST_COMMON = 8, 1 << 21, 1 << 17
#: Bits of a filter of wanted rows (8 MB).
MOST_BITS = 1 << 26
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
_CARRIED = ["fp", "node", "size", "class", "sign"]
_NODE = "shard long, asks boolean, fp long, node long, size int, class long, sign long"
_NAMES = ["shard", "asks", *_CARRIED]
_ORDERS = np.array([xxhash.xxh64_intdigest(str(i), SEED) | 1 for i in range(BITS)], dtype=np.uint64)


def hashes_of(text: str | None, words: int) -> np.ndarray:
    """A hash for each word shingle of a text, repeats included; a shorter text is one shingle."""
    parts = [w.encode() for w in _WORD.findall((text or "").translate(_LOWER))]
    if not parts:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = min(words, len(parts))
    count = len(parts) - size + 1
    spans = zip(starts[:count].tolist(), ends[size - 1 :].tolist(), strict=True)
    return np.fromiter((xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in spans), dtype=np.uint64, count=count)


def fingerprint_of(hashes: np.ndarray) -> int:
    """Bits set in more than half of the hashes; 0 without any."""
    totals = np.zeros(BITS, dtype=np.int64)
    for low in range(0, len(hashes), 1 << 16):
        block = hashes[low : low + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        totals += np.unpackbits(block, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * totals > len(hashes), bitorder="little").view("<u8")[0])


def sign_of(held: np.ndarray) -> int:
    """A bit of the least hash in each of 64 orders of the set; 0 for an empty one."""
    if not len(held):
        return 0
    least = np.full(BITS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for low in range(0, len(held), 1 << 12):
        np.minimum(least, (_ORDERS[:, None] * held[None, low : low + (1 << 12)]).min(1), out=least)
    return int(np.packbits((least >> np.uint64(20) & np.uint64(1)).astype(bool), bitorder="little").view("<u8")[0])


def prints(text: Column, words: int) -> Column:
    """Struct (node, fp, size, sign): digest of the set of shingles, fingerprint, shingles in the set, MinHash bits."""

    @F.pandas_udf("node long, fp long, size int, sign long")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            hashes = hashes_of(text, words)
            held = np.unique(hashes)
            digest = xxhash.xxh64_intdigest(held.astype("<u8").tobytes(), SEED)
            rows.append((digest, fingerprint_of(hashes), len(held), sign_of(held)))
        made = np.array(rows, dtype=np.uint64).reshape(-1, 4)
        longs = {name: made[:, i].copy().view(np.int64) for i, name in ((0, "node"), (1, "fp"), (3, "sign"))}
        return pd.DataFrame({**longs, "size": made[:, 2].astype(np.int32)})[["node", "fp", "size", "sign"]]

    return run(text)


def shingle_set(text: Column, words: int) -> Column:
    """Distinct shingle hashes of a text."""

    @F.pandas_udf("array<long>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(hashes_of(t, words)).view(np.int64) for t in texts])

    return run(text)


def parities(held: Column, size: Column) -> Column:
    """Whether an odd number of a set's hashes falls into each of 2, 4, 8, ... times 32 places, at least two for each hash.

    A place where two sets of places differ holds a hash of one of them only, so no more places differ than hashes do.
    """

    @F.pandas_udf("binary")
    def run(sets: pd.Series, sizes: pd.Series) -> pd.Series:
        out = []
        for hashes, many in zip(sets, sizes, strict=True):
            places = 64 << max(0, int(many) - 1 >> 5).bit_length()
            odd = np.bincount(np.asarray(hashes, dtype=np.int64) & (places - 1), minlength=places) & 1
            out.append(np.packbits(odd.astype(bool), bitorder="little").tobytes())
        return pd.Series(out, dtype=object)

    return run(held, size)


def _may_share(odd: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of pairs (a, b) of rows with parities and sizes, whether their sets may share enough."""
    length = np.fromiter(map(len, odd), dtype=np.int64, count=len(odd)) >> 3
    apart = np.zeros(len(a), dtype=np.int64)
    least = np.minimum(length[a], length[b])
    for words in np.unique(least).tolist():
        pairs = np.flatnonzero(least == words)
        place = np.zeros(len(odd), dtype=np.int64)
        table = []
        for many in np.unique(length[np.concatenate([a[pairs], b[pairs]])]).tolist():
            rows = np.unique(np.concatenate([x[pairs][length[x[pairs]] == many] for x in (a, b)]))
            place[rows] = np.arange(len(rows)) + sum(map(len, table))
            # A longer row of places folds onto a shorter one.
            made = np.frombuffer(b"".join(odd[rows]), dtype="<u8").reshape(len(rows), -1, words)
            table.append(np.bitwise_xor.reduce(made, axis=1))
        table = np.concatenate(table)
        step = max(1, PARITIES_AT_ONCE // words)
        for low in range(0, len(pairs), step):
            some = pairs[low : low + step]
            apart[some] = np.bitwise_count(table[place[a[some]]] ^ table[place[b[some]]]).sum(1, dtype=np.int64)
    # The union is half of both sizes and of what differs.
    return (WHOLE + PART) * apart <= (WHOLE - PART) * (size[a] + size[b])


def may_share(one: Column, two: Column, size_one: Column, size_two: Column) -> Column:
    """False for sets that differ in too many hashes for the similarity, by their parities; true for all similar ones."""

    @F.pandas_udf("boolean")
    def run(ones: pd.Series, twos: pd.Series, sizes: pd.Series, others: pd.Series) -> pd.Series:
        odd = np.concatenate([x.to_numpy(dtype=object) for x in (ones, twos)])
        size = np.concatenate([x.to_numpy(np.int64) for x in (sizes, others)])
        rows = np.arange(len(ones))
        return pd.Series(_may_share(odd, size, rows, rows + len(ones)))

    return run(one, two, size_one, size_two)


def among(wanted: DataFrame, keys: tuple[str, str]) -> Column:
    """Whether a row's keys may be those of a wanted row, by a bit filter that is never wrong about wanted ones.

    Gathered at the driver and sent to executors: at most ``MOST_BITS`` bits.
    """
    bits = min(max(1 << (16 * wanted.count()).bit_length(), 1 << 16), MOST_BITS)
    place = F.pmod(F.xxhash64(*keys), F.lit(bits))
    words = wanted.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("m")
    ).toPandas()
    table = np.zeros(bits // 64, dtype=np.uint64)
    table[words["w"].to_numpy(np.int64)] = words["m"].to_numpy(np.int64).view(np.uint64)
    sent = wanted.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def run(places: pd.Series) -> pd.Series:
        at = places.to_numpy(np.int64)
        return pd.Series((sent.value[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool))

    return run(place)


def _dealt(nodes: DataFrame, forest: Forest, shard_rows: int) -> DataFrame:
    """Nodes in their home shards and in those they ask; shards above ``shard_rows`` in blocks, of which askers ask all."""

    def placed(homes_only: bool) -> DataFrame:
        odd = [c for c in ("odd",) if c in nodes.columns and not homes_only]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                fp = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
                for rows, shard, stored in forest.shards(fp.view(np.uint64)):
                    if stored or not homes_only:
                        took = batch.take(pa.array(rows))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(shard), pa.array(np.full(len(rows), not stored)), *took.columns], [*_NAMES, *odd]
                        )

        sign = F.col("sign") if "sign" in nodes.columns else F.lit(0).cast("long").alias("sign")
        return nodes.select(*_CARRIED[:-1], sign, *odd).mapInArrow(run, _NODE + ", odd binary" * len(odd))

    return _in_blocks(placed(False), placed(True), shard_rows)


def _in_blocks(rows: DataFrame, homes: DataFrame, shard_rows: int) -> DataFrame:
    """Rows of shards, with a block: shards above ``shard_rows`` have several, of which askers ask all."""
    large = (
        homes.groupBy("shard").count().where(F.col("count") > shard_rows)
        .select("shard", F.ceil(F.col("count") / shard_rows).cast("int").alias("blocks"))
    )
    own = F.pmod(F.xxhash64("node"), "blocks").cast("int")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    later = F.when(F.col("asks"), every).otherwise(F.filter(every, lambda b: b >= own))
    split = rows.join(cut_lineage(large), "shard", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    return split.select("*", own.alias("own"), F.explode(later).alias("block")).select(
        "shard", "block", (F.col("asks") | (F.col("own") != F.col("block"))).alias("asks"), *_CARRIED,
        *(c for c in ("odd",) if c in rows.columns),
    )


def _met(rows: list[np.ndarray], radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(larger node, smaller node, bits) of candidates: stored nodes among themselves and with those that ask."""
    shard, block, asks, fp, node, size, kind, sign, *odd = rows
    asks, bits, sign = asks.astype(bool), fp.view(np.uint64), sign.view(np.uint64)
    first = np.flatnonzero(np.concatenate([[True], (shard[1:] != shard[:-1]) | (block[1:] != block[:-1])]))
    runs = np.diff(np.append(first, len(fp)))
    stored_end = first + np.add.reduceat((~asks).astype(np.int64), first)
    begin = np.where(asks, np.repeat(first, runs), np.arange(len(fp)) + 1)
    many = np.maximum(np.repeat(stored_end, runs) - begin, 0)
    total = np.cumsum(many)
    size = size.astype(np.int64)
    low = 0
    while low < len(fp):
        high = max(low + 1, int(np.searchsorted(total, total[low] - many[low] + PAIRS_AT_ONCE, side="right")))
        count = many[low:high]
        a = np.repeat(np.arange(low, high), count)
        b = np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin[low:high], count)
        away = np.bitwise_count(bits[a] ^ bits[b])
        near = np.flatnonzero(away <= radius)
        a, b, away = a[near], b[near], away[near]
        allowed = (kind[a] != kind[b]) & (np.bitwise_count(sign[a] ^ sign[b]) <= MOST_APART) & (WHOLE * np.minimum(size[a], size[b]) >= PART * np.maximum(size[a], size[b]))
        a, b, away = a[allowed], b[allowed], away[allowed]
        if odd and len(a):
            may = _may_share(odd[0], size, a, b)
            a, b, away = a[may], b[may], away[may]
        if len(a):
            yield np.maximum(node[a], node[b]), np.minimum(node[a], node[b]), away
        low = high


def _smallest(found: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Of each node's smaller neighbours the smallest, and the smallest of the tight ones."""
    large, small, away = (np.concatenate(x) for x in zip(*found, strict=True))
    kept = []
    for rows in (np.arange(len(large)), np.flatnonzero(away <= TIGHT)):
        order = rows[np.lexsort((small[rows], large[rows]))]
        kept.append(order[np.concatenate([[True], large[order][1:] != large[order][:-1]])] if len(order) else order)
    rows = np.unique(np.concatenate(kept))
    return large[rows], small[rows], away[rows]


def _searched(
    nodes: DataFrame, radius: int, bands: int, shard_rows: int, kind: str,
    reduced: Callable[[list[tuple[np.ndarray, ...]]], tuple[np.ndarray, ...]] | None,
) -> DataFrame:
    """What ``reduced`` makes of the candidate pairs of the forest that meet in a task, or all of them: distinct rows of the columns ``kind``."""
    # Runs of one bit each: what differs in less than two bits for each run is found, and most of what differs in more.
    return _in_shards(_dealt(nodes, Forest(2 * bands - 1, bands, group_bits=1), shard_rows), radius, kind, reduced)


def _in_shards(
    dealt: DataFrame, radius: int, kind: str, reduced: Callable[[list[tuple[np.ndarray, ...]]], tuple[np.ndarray, ...]] | None
) -> DataFrame:
    """The same for rows that are dealt to shards and blocks."""
    names = [part.split(" ")[0] for part in kind.split(", ")]

    def give(found: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in found[: len(names)]], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        found: list[tuple[np.ndarray, ...]] = []

        def search(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            for pairs in _met(rows, radius):
                if reduced is None:
                    yield give(pairs)
                    continue
                found.append(pairs)
                if sum(len(x[0]) for x in found) > LINKS_AT_ONCE:
                    found[:] = [reduced(found)]
                    if len(found[0][0]) > LINKS_AT_ONCE // 2:
                        yield give(found.pop())

        def joined() -> list[np.ndarray]:
            return [np.concatenate(x) for x in zip(*held, strict=True)]

        for batch in batches:
            if not batch.num_rows:
                continue
            new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            same = bool(held) and held[0][0][0] == new[0][-1] and held[0][1][0] == new[1][-1]
            held.append(new)
            if not same:
                rows = joined()
                last = (rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1])
                cut = int(np.argmax(last))
                held[:] = [[x[cut:] for x in rows]]
                if cut:
                    yield from search([x[:cut] for x in rows])
        if held:
            yield from search(joined())
        if found:
            yield give(reduced(found))

    sorted_rows = dealt.repartition("shard", "block").sortWithinPartitions("shard", "block", "asks")
    return sorted_rows.mapInArrow(run, kind).distinct()


def candidates(nodes: DataFrame, radius: int, bands: int, every: bool, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Candidate pairs (a, b) of nodes (fp, node, size, class, sign, odd) in different classes; without a sign or parities none is ruled out by them.

    All of them, or a few for each node that has any. A task holds the rows of one shard's block and a bounded number of pairs.
    """
    return _searched(nodes, radius, bands, shard_rows, "a long, b long", None if every else _smallest)


def _ends(found: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """The nodes of pairs, each once, in columns like those of pairs."""
    node = np.unique(np.concatenate([x for large, small, *_ in found for x in (large, small)]))
    return node, node, node


def paired(nodes: DataFrame, radius: int, bands: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The nodes that are in any candidate pair: at most one row for each node and task, however many pairs there are."""
    return _searched(nodes, radius, bands, shard_rows, "node long", _ends)


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs whose sets share enough."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("held").alias("of_a")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("held").alias("of_b")), "b"
    )
    shared = F.size(F.array_intersect("of_a", "of_b"))
    union = F.size("of_a") + F.size("of_b") - shared
    return cut_lineage(both.where(WHOLE * shared >= PART * union).select("a", "b"))


def common_shingles(rows: DataFrame, text: str, words: int) -> np.ndarray:
    """Shingles that many texts have, sorted. They come last in the order of shingles, and which they are decides nothing else."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def give() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts >= OFTEN
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(values[often].view(np.int64)), pa.array(counts[often])], ["shingle", "many"])

        many = 0
        for batch in batches:
            for value in batch.column(0):
                held.append(np.unique(hashes_of(value.as_py(), words)))
                many += len(held[-1])
                if many > SHINGLES_AT_ONCE:
                    many = 0
                    yield give()
        if held:
            yield give()

    counted = rows.select(text).mapInArrow(run, "shingle long, many long").groupBy("shingle").agg(F.sum("many").alias("many"))
    most = counted.orderBy(F.desc("many"), "shingle").limit(MOST_COMMON).toPandas()
    return np.sort(most["shingle"].to_numpy(np.int64).view(np.uint64))


def first_shingles(text: Column, words: int, common: np.ndarray) -> Column:
    """Struct (node, size, first): the first shingles of the set, rare ones before common ones, of which similar sets share one."""
    sent = SparkSession.active().sparkContext.broadcast(common)

    @F.pandas_udf("node long, size int, first array<long>")
    def run(texts: pd.Series) -> pd.DataFrame:
        often = sent.value
        nodes, sizes, first = [], [], []
        for text in texts:
            held = np.unique(hashes_of(text, words))
            nodes.append(xxhash.xxh64_intdigest(held.astype("<u8").tobytes(), SEED))
            sizes.append(len(held))
            # Two sets whose shared part is PART / WHOLE of either cannot miss each other in what exceeds that, and one more.
            taken = len(held) - -(-PART * len(held) // WHOLE) + 1 if len(held) else 0
            late = np.isin(held, often, assume_unique=True)
            first.append(np.concatenate([held[~late], held[late]])[:taken].view(np.int64))
        return pd.DataFrame({
            "node": np.array(nodes, dtype=np.uint64).view(np.int64), "size": np.array(sizes, dtype=np.int32), "first": pd.Series(first, dtype=object),
        })

    return run(text)


def _meeting(first: DataFrame, roots: DataFrame) -> DataFrame:
    """(shard, node, size, class): nodes by the first shingles that they share with nodes of other classes."""
    each = first.select("node", "size", F.explode("first").alias("shard"))

    # Rows of equal texts pass too; the classes tell.
    shared = cut_lineage(each.groupBy("shard").count().where("count > 1").select("shard"))
    met = each.where(among(shared, ("shard",))).join(shared, "shard").distinct()
    classed = written(met.join(roots, "node", "left").withColumn("class", F.coalesce("root", "node")).drop("root"), "classed")
    # Of shingles that the same nodes have, by 128 bits, one is enough for these to meet.
    held = [F.bit_xor(F.xxhash64("node", F.lit(n))).alias(f"held{n}") for n in (0, 1)]
    ends = classed.groupBy("shard").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.count("*").alias("many"), *held)
    mixed = ends.where("low <> high").groupBy("many", "held0", "held1").agg(F.min("shard").alias("shard")).select("shard")
    return written(classed.join(mixed, "shard").select("shard", "node", "size", "class"), "meeting")


def _sets_of(rows: DataFrame, wanted: DataFrame, keys: tuple[str, str], text: str, words: int) -> DataFrame:
    """Wanted nodes, which name a row by its keys, with the sets of these rows. Texts stay where they are."""
    made = rows.where(among(wanted, keys)).select(*keys, shingle_set(F.col(text), words).alias("held"))
    return cut_lineage(made.join(wanted, list(keys)).drop(*keys))


def representatives(
    docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = 5, radius: int = RADIUS, bands: int = BANDS,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """One row of each group of similar documents, with the columns of ``docs``: the one with the smallest key.

    Similar are documents whose sets of ``words``-word shingles (lower-cased A-Z) have a Jaccard similarity of 0.8
    or more; groups are what such links reach. No pair below that is linked. The forest finds most links; those it misses, by
    fingerprints that are far apart or by MinHash bits, are found by shared rare shingles, so no group is left in parts.
    Keys may be null (such a row stays only if its whole group has none) or
    repeated (one of the rows stays). Texts without a word are one group; shorter ones than ``words`` are one shingle.
    An empty table stays empty.
    """
    rows, (one, two) = keyed(docs)
    rank = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.col(one).alias("one"), F.col(two).alias("two"))
    found = cut_lineage(rows.select(rank.alias("key"), prints(F.col(text), words).alias("p")).select("key", "p.*"))
    least = F.min(F.struct("key", "fp", "size", "sign"))
    nodes = cut_lineage(found.groupBy("node").agg(least.alias("m")).select(
        "node", "m.fp", "m.size", "m.sign", F.col("m.key").alias("least"), F.col("node").alias("class")
    ))
    many = nodes.count()
    ends = paired(nodes, radius, bands, shard_rows)
    wanted = cut_lineage(nodes.join(ends, "node").select(
        "node", "fp", "size", "sign", "class", F.col("least.one").alias(one), F.col("least.two").alias(two)
    ))
    sets = _sets_of(rows, wanted, (one, two), text, words)
    brief = cut_lineage(sets.withColumn("odd", parities(F.col("held"), F.col("size"))).drop("held"))
    near = cut_lineage(candidates(brief, radius, bands, False, shard_rows))
    linked = _similar(near, sets)
    roots = cut_lineage(in_few_files(components(linked), many))
    classed = cut_lineage(brief.drop("class").join(roots, "node", "left").withColumn("class", F.coalesce("root", "node")).drop("root"))
    rest = cut_lineage(candidates(classed, radius, bands, True, shard_rows).join(near, ["a", "b"], "left_anti"))
    linked = linked.union(_similar(rest, sets))
    roots = cut_lineage(in_few_files(components(linked), many))
    common = common_shingles(rows, text, words)
    first = written(rows.select(first_shingles(F.col(text), words, common).alias("p")).select("p.*"), "first")
    meeting = _meeting(first, roots)
    wanted = cut_lineage(nodes.join(meeting.select("node").distinct(), "node").select(
        "node", "size", F.col("least.one").alias(one), F.col("least.two").alias(two)
    ))
    sets = _sets_of(rows, wanted, (one, two), text, words)
    brief = sets.select("node", parities(F.col("held"), F.col("size")).alias("odd"))
    zero = F.lit(0).cast("long")
    met = meeting.join(brief, "node").select(
        "shard", F.lit(False).alias("asks"), zero.alias("fp"), "node", "size", "class", zero.alias("sign"), "odd"
    )
    missed = cut_lineage(_in_shards(_in_blocks(met, meeting, shard_rows), radius, "a long, b long", None))
    linked = linked.union(_similar(missed, sets))
    roots = components(linked)
    placed = nodes.join(roots, "node", "left").select("least", F.coalesce("root", "node").alias("root"))
    first = placed.groupBy("root").agg(F.min("least").alias("least")).select(
        F.col("least.one").alias(one), F.col("least.two").alias(two)
    )
    return rows.join(cut_lineage(first), [one, two], "left_semi").select(*docs.columns)
