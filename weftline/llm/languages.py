"""Language of a text by Bloom filters over character trigrams, one filter for each language, bit-sliced.

A slot of the table holds one bit for each language, so one probe answers for all of them: the bits left
by and-ing a trigram's slots are the languages that hold it. Hits are counted by language and corrected
by the filter's rate of false positives.
"""

from __future__ import annotations

import dataclasses
import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.session import cut_lineage

#: Slots of a filter for each trigram of the language with most of them, and bounds of the table.
ROOM = 16
LEAST_SLOTS, MOST_SLOTS = 1 << 16, 1 << 22
PROBES = 3
#: A language holds a trigram that makes up so much of its own, and so much of the share it has where it is most common.
LEAST_SHARE = 1e-5
LEAST_PART = 0.25
UNKNOWN = "und"
CHUNK = 1 << 20
HELD_GRAMS = 1 << 20
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def grams_of(text: str | None) -> Iterator[np.ndarray]:
    """Trigrams with a letter, as three code points in one number, chunk by chunk; other characters are blanks."""
    if not text:
        return
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype="<u4")
    for low in range(0, len(codes) - 2, CHUNK):
        part = codes[low : low + CHUNK + 2]
        letter = _letters()[part]
        part = np.where(letter, part, 32).astype(np.uint64)
        some = letter[:-2] | letter[1:-1] | letter[2:]
        yield ((part[:-2] << np.uint64(42)) | (part[1:-1] << np.uint64(21)) | part[2:])[some]


def slots_of(grams: np.ndarray, slots: int, probes: int = PROBES) -> Iterator[np.ndarray]:
    for k in range(probes):
        mixed = (grams ^ (grams >> np.uint64(29))) * _MIX[k % len(_MIX)] + np.uint64(k)
        mixed ^= mixed >> np.uint64(32)
        yield ((mixed * _MIX[(k + 1) % len(_MIX)]) >> np.uint64(20)) % np.uint64(slots)


@dataclasses.dataclass
class Filters:
    """The table (words of 64 languages by slots), the languages, and each one's rate of false positives."""

    languages: list[str]
    table: np.ndarray
    false_rate: np.ndarray

    def counts(self, text: str | None) -> tuple[int, np.ndarray]:
        """Trigrams of a text, and how many of them each language holds."""
        total, held = 0, np.zeros(len(self.languages))
        for grams in grams_of(text):
            total += len(grams)
            for word, table in enumerate(self.table):
                masks = functools.reduce(np.bitwise_and, (table[s] for s in slots_of(grams, table.shape[0])))
                for at in range(min(64, len(held) - 64 * word)):
                    held[64 * word + at] += np.count_nonzero(masks >> np.uint64(at) & np.uint64(1))
        return total, held

    def decide(self, text: str | None) -> tuple[str, float]:
        total, held = self.counts(text)
        if not total or not self.languages:
            return UNKNOWN, 0.0
        right = np.clip((held - total * self.false_rate) / (1 - self.false_rate), 0, None)
        best = int(right.argmax())
        return self.languages[best], float(right[best] / right.sum()) if right.sum() else 0.0


def gram_counts(learnt: DataFrame) -> DataFrame:
    """(lang, gram, n) from rows (lang, text); a task gives out each of its trigrams about once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            grams, place = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
            return grams, np.bincount(place, np.concatenate([n for _, n in parts])).astype(np.int64)

        def give(lang: str) -> pa.RecordBatch:
            grams, n = merged(held.pop(lang))
            return pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(grams)), pa.array(grams.view(np.int64)), pa.array(n)], ["lang", "gram", "n"]
            )

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                parts = held.setdefault(lang, [])
                parts.extend(np.unique(g, return_counts=True) for g in grams_of(text.as_py()))
                if sum(len(g) for g, _ in parts[-64:]) and len(parts) > 256:
                    parts[:] = [merged(parts)]
                    if len(parts[0][0]) > HELD_GRAMS:
                        yield give(lang)
        for lang in list(held):
            if held[lang]:
                yield give(lang)

    counted = learnt.select("lang", "text").mapInArrow(run, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn(
    learnt: DataFrame, slots: int | None = None, least_share: float = LEAST_SHARE, least_part: float = LEAST_PART
) -> Filters:
    """Filters of the languages in rows (lang, text): each holds the trigrams its texts have.

    Trigrams that are strays in a language, by the two shares, stay out of its filter; with shares of 0 none does.
    The number of slots follows the trigrams of the language with most, up to ``MOST_SLOTS``; fuller filters have more
    false positives, which the rate of each corrects. Gathered at the driver: one row for each language and at most one for each slot.
    """
    counts = cut_lineage(gram_counts(learnt))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"), F.count("*").alias("grams"))
    sizes = {r["lang"]: r["grams"] for r in totals.collect()}
    languages = sorted(sizes)
    if slots is None:
        slots = min(max(1 << (ROOM * max(sizes.values(), default=1) - 1).bit_length(), LEAST_SLOTS), MOST_SLOTS)
    number = {lang: i for i, lang in enumerate(languages)}
    shares = counts.join(totals, "lang").select("lang", "gram", (F.col("n") / F.col("total")).alias("share"))
    shares = shares.where(F.col("share") >= least_share)
    # A trigram's languages are few: a row for each.
    top = shares.groupBy("gram").agg(
        F.max("share").alias("top"), F.collect_list(F.struct("lang", "share")).alias("each")
    )
    held = top.select("gram", F.explode("each").alias("e"), "top").where(F.col("e.share") >= least_part * F.col("top"))

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which = np.array([number[x] for x in batch.column("lang").to_pylist()], dtype=np.int64)
            grams = batch.column("gram").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            mask = np.left_shift(np.uint64(1), (which % 64).astype(np.uint64)).view(np.int64)
            for slot in slots_of(grams, slots):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(slot.astype(np.int64)), pa.array(which // 64), pa.array(mask)], ["slot", "word", "mask"]
                )

    sliced = held.select("e.lang", "gram").mapInArrow(bits, "slot long, word long, mask long")
    rows = sliced.groupBy("word", "slot").agg(F.bit_or("mask").alias("mask")).toPandas()
    table = np.zeros((max(1, -(-len(languages) // 64)), slots), dtype=np.uint64)
    table[rows["word"].to_numpy(np.int64), rows["slot"].to_numpy(np.int64)] = rows["mask"].to_numpy(np.int64).view(np.uint64)
    filled = np.array([
        np.count_nonzero(table[i // 64] >> np.uint64(i % 64) & np.uint64(1)) / slots for i in range(len(languages))
    ])
    return Filters(languages, table, filled**PROBES)


def predict(filters: Filters, docs: DataFrame, text: Column) -> Column:
    """Struct (lang, score) of a text column; the filters travel once to each executor."""
    sent = docs.sparkSession.sparkContext.broadcast((filters.languages, filters.table, filters.false_rate))

    @F.pandas_udf("lang string, score double")
    def run(texts: pd.Series) -> pd.DataFrame:
        own = Filters(*sent.value)
        return pd.DataFrame([own.decide(t) for t in texts], columns=["lang", "score"])

    return run(text)


def identify(
    docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", folds: int = 4, held_fold: int = 2
) -> DataFrame:
    """(key, held_out, lang_pred, score) for each row of ``docs``.

    Learns from rows with a language whose crc32 of the key leaves another rest than ``held_fold``; rows
    without a key are predicted, not learnt from. Null texts and texts without a letter are ``und`` with score 0; if no
    language is learnt, all are. Ties go to the first language by code point. Repeated rows count each.
    """
    fold = F.crc32(F.col(key).cast("string").cast("binary")) % folds
    rows = docs.select(
        F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"), fold.alias("fold")
    )
    filters = learn(rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col("fold") != held_fold)))
    found = rows.select(
        "key", F.coalesce(F.col("fold") == held_fold, F.lit(False)).alias("held_out"),
        predict(filters, docs, F.col("text")).alias("found"),
    )
    return found.select(F.col("key").alias(key), "held_out", F.col("found.lang").alias("lang_pred"), "found.score")
