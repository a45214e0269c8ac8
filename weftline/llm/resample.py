"""Importance resampling towards a target corpus over hashed word n-grams.

Each block of texts is normalised once to words with one blank between them; the running CRCs of that string
give the CRC of every n-gram of any size as the part between two of its prefixes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.buffers import text_blocks
from weftline.llm.crc import RunningCrcs
from weftline.session import cut_lineage, literal_rows

BUCKETS = 10_000
_BYTES = np.arange(256, dtype=np.uint8)
_UPPER = (_BYTES >= ord("A")) & (_BYTES <= ord("Z"))
_LOWERED = np.where(_UPPER, _BYTES + 32, _BYTES).astype(np.uint8)
#: Letters, digits and every byte of a code point above U+007F.
_IN_WORD = _UPPER | ((_BYTES >= ord("a")) & (_BYTES <= ord("z"))) | ((_BYTES >= ord("0")) & (_BYTES <= ord("9"))) | (_BYTES >= 0x80)


def features(data: np.ndarray, offsets: np.ndarray, longest: int = 1) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """Words of each text, and for each n-gram size (text, CRC-32) of all n-grams in order."""
    inside = _IN_WORD[data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    # Words end with their text, whatever follows in the block.
    edges = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
    opens[edges], closes[edges - 1] = inside[edges], inside[edges - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    text = np.searchsorted(offsets, starts, "right") - 1
    words = np.bincount(text, minlength=len(offsets) - 1)
    lengths = ends - starts
    to = np.cumsum(lengths + 1) - 1
    normal = np.full(to[-1] + 1 if len(to) else 0, ord(" "), dtype=np.uint8)
    held = np.flatnonzero(inside)
    normal[np.arange(len(held)) + np.repeat(np.arange(len(starts)), lengths)] = _LOWERED[data[held]]

    def grams() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        crcs = RunningCrcs(normal)
        for n in range(1, longest + 1):
            first = np.flatnonzero(text[: max(0, len(text) - n + 1)] == text[n - 1 :])
            yield text[first], crcs.between(to[first] - lengths[first], to[first + n - 1])

    return words, grams()


def bucket_counts(docs: DataFrame, text: str = "text", longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features of all texts in each bucket that has some; a task gives out each bucket once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for data, offsets in text_blocks(batch.column(0)):
                for _, crcs in features(data, offsets, longest)[1]:
                    total += np.bincount(crcs % buckets, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    counted = docs.select(F.col(text)).mapInArrow(run, "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text: str = "text", longest: int = 1, buckets: int = BUCKETS) -> list[int]:
    """What a feature of each bucket adds to a document's weight: the smoothed log ratio of its shares, in thousandths."""

    def gathered(df: DataFrame) -> dict[int, int]:
        # At most one row for each bucket.
        return {r["bucket"]: r["n"] for r in bucket_counts(df, text, longest, buckets).collect()}

    have, want = gathered(docs), gathered(target)
    all_have, all_want = sum(have.values()), sum(want.values())
    return [
        math.floor(1000 * math.log(float(want.get(b, 0) + 1) * (all_have + buckets) / (float(have.get(b, 0) + 1) * (all_want + buckets))))
        for b in range(buckets)
    ]


def weights(docs: DataFrame, gain: list[int], text: str = "text", key: str = "doc_id", longest: int = 1) -> DataFrame:
    """(key, n_words, n_features, weight) for each row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(np.array(gain, dtype=np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = sent.value
        for batch in batches:
            parts = []
            for data, offsets in text_blocks(batch.column(1)):
                words, grams = features(data, offsets, longest)
                many, weight = np.zeros((2, len(words)), dtype=np.int64)
                for at, crcs in grams:
                    many += np.bincount(at, minlength=len(words))
                    # Sums of whole numbers far below 2 ** 53.
                    weight += np.bincount(at, each[crcs % len(each)], minlength=len(words)).astype(np.int64)
                parts.append((words, many, weight))
            if parts:
                columns = [pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*parts, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["key", "n_words", "n_features", "weight"])

    kind = docs.select(F.col(key)).schema[0].dataType.simpleString()
    made = docs.select(F.col(key).alias("key"), F.col(text)).mapInArrow(run, f"key {kind}, n_words long, n_features long, weight long")
    return made.withColumnRenamed("key", key)


def noise(key: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, rounded down; the same for a key in every run. A null key is an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def drawn(scored: DataFrame, key: str = "doc_id", least_words: int = 20, percent: int = 10) -> DataFrame:
    """``scored`` with rank: 1, 2, 3, ... by falling score and rising key among the share that is drawn, else null.

    Rows are dealt out by ranges of that order and numbered from the counts of the ranges before, so no task
    and no driver holds them all. Gathered at the driver: one row for each range.
    """
    eligible = F.col("n_words") >= least_words
    spread = F.monotonically_increasing_id()
    order = [F.col("_out").asc(), F.col("score").desc(), F.col(key).asc_nulls_last(), F.col("_spread").asc()]
    kept = cut_lineage(scored)
    dealt = kept.withColumns({"_out": ~eligible, "_spread": spread}).repartitionByRange(*order).sortWithinPartitions(*order)
    # The place in a range: the lower 33 bits of the running number.
    numbered = dealt.withColumns({
        "_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)),
    })
    numbered = cut_lineage(numbered.drop("_spread"))
    ranges = numbered.groupBy("_range").agg(F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("_out")).alias("eligible")).collect()
    before, total = [], 0
    for r in sorted(ranges):
        before.append((r["_range"], total))
        total += r["rows"]
    draw = sum(r["eligible"] for r in ranges) * percent // 100
    offsets = literal_rows(scored.sparkSession, before, "_range int, _before bigint")
    rank = F.col("_before") + F.col("_at") + 1
    return numbered.join(offsets, "_range").withColumn("rank", F.when(rank <= draw, rank)).drop("_out", "_range", "_at", "_before")


def resample(
    docs: DataFrame, target: DataFrame, text: str = "text", key: str = "doc_id", longest: int = 1,
    buckets: int = BUCKETS, seed: int = 2024, least_words: int = 20, percent: int = 10,
) -> DataFrame:
    """(key, n_words, n_features, weight, score, rank) for each row of ``docs``, drawn towards ``target``.

    Features are the runs of 1 to ``longest`` words, with repeats, hashed to ``buckets`` by CRC-32. A null text
    has no words, an empty one neither; both have weight 0 and are not drawn. Repeated rows are rows of their
    own, and rows that tie in score and key are numbered in any order. A null key has the noise of an empty key and
    comes last among ties. Other columns are not looked at. An empty table gives no rows; an empty target has
    equal counts of zero.
    """
    gain = gains(docs, target, text, longest, buckets)
    weighed = weights(docs, gain, text, key, longest)
    scored = weighed.withColumn("score", F.col("weight") + noise(F.col(key), seed))
    return drawn(scored, key, least_words, percent)
