"""A supervised text classifier on averaged word and subword vectors.

Words and the character n-grams inside them (with marked ends) are hashed into buckets; a document is the
average of its buckets' vectors, and a softmax layer reads the class. Vectors and layer are learnt by
stochastic gradient descent in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 17
WIDTH = 8
GRAMS = (3, 4, 5)
EPOCHS = 5
RATE = 0.5
#: At most so many labelled documents are learnt from: those whose keys have the smallest hashes.
LEARNT = 6000
CHUNK = 1 << 20
_PRIME = np.uint64(0x100000001B3)
_INVERSE = np.uint64(pow(0x100000001B3, -1, 1 << 64))
_FINAL = np.uint64(0x9E3779B97F4A7C15)
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def _powers(of: np.uint64) -> np.ndarray:
    out = np.full(CHUNK + 3, of, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_TABLES: dict[str, np.ndarray] = {}


def _table(name: str) -> np.ndarray:
    if name not in _TABLES:
        _TABLES[name] = _powers(_PRIME if name == "up" else _INVERSE)
    return _TABLES[name]


def _bucket(hashes: np.ndarray, kind: int) -> np.ndarray:
    mixed = (hashes ^ (hashes >> np.uint64(31)) ^ np.uint64(kind)) * _FINAL
    return ((mixed >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int64)


def _chunks(data: bytes) -> Iterator[bytes]:
    """Pieces cut at a blank; a longer run without one is cut where the piece is full."""
    low = 0
    while low < len(data):
        high = min(len(data), low + CHUNK)
        if high < len(data):
            cut = max(data.rfind(b, low, high) for b in (b" ", b"\n", b"\t"))
            high = cut + 1 if cut > low else high
        yield data[low:high]
        low = high


def features(text: str | None) -> Iterator[np.ndarray]:
    """Buckets of a text's words and n-grams, repeats included; the first one stands for the document."""
    yield np.zeros(1, dtype=np.int64)
    for piece in _chunks((text or "").encode("utf-8", "surrogatepass").translate(_LOWER)):
        data = np.frombuffer(b" " + piece + b" ", dtype=np.uint8)
        blank = _BLANK[data]
        codes = np.where(blank, 32, data).astype(np.uint64)
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(codes * _table("up")[: len(codes)])])
        starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
        ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
        yield _bucket((sums[ends] - sums[starts]) * _table("down")[starts], 0)
        for n in GRAMS:
            if len(data) < n:
                continue
            at = np.arange(len(data) - n + 1)
            # Blanks only at the ends, and at most at one side of three letters or more.
            inner = np.ones(len(at), dtype=bool)
            for k in range(1, n - 1):
                inner &= ~blank[k : k + len(at)]
            at = at[inner]
            yield _bucket((sums[at + n] - sums[at]) * _table("down")[at], n)


def counted(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and how often each occurs."""
    total = np.zeros(0, dtype=np.int64), np.zeros(0)
    for part in features(text):
        ids, n = np.unique(np.concatenate([total[0], part]), return_inverse=True)
        total = ids, np.bincount(n, np.concatenate([total[1], np.ones(len(part))]))
    return total


def train(texts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 7) -> np.ndarray:
    """What each bucket adds to the log odds of class 1, after descent over the documents in random order."""
    random = np.random.default_rng(seed)
    vectors = random.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH))
    layer = np.zeros((2, WIDTH))
    step, steps = 0, max(1, EPOCHS * len(texts))
    for _ in range(EPOCHS):
        for at in random.permutation(len(texts)):
            ids, n = texts[at]
            share = n / n.sum()
            mean = share @ vectors[ids]
            odds = np.exp(layer @ mean - (layer @ mean).max())
            slope = odds / odds.sum()
            slope[labels[at]] -= 1
            rate = RATE * (1 - step / steps)
            back = layer.T @ slope
            layer -= rate * np.outer(slope, mean)
            # A vector steps as far as the average would, but for no more than one word of a document.
            vectors[ids] -= rate * (share * len(ids))[:, None].clip(max=1.0) * back
            step += 1
    return (vectors @ (layer[1] - layer[0])).astype(np.float32)


def fit(labelled: DataFrame, most: int = LEARNT) -> np.ndarray:
    """Weights from rows (key, text, label 0 or 1), learnt in one task from at most ``most`` of them."""
    chosen = labelled.orderBy(F.xxhash64("key"), "key", "label").limit(most)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts, labels, keys = [], [], []
        for frame in frames:
            # Half the size, since all documents learnt from are held together.
            texts += [(ids.astype(np.int32), n.astype(np.float32)) for ids, n in map(counted, frame["text"])]
            labels += frame["label"].tolist()
            keys += frame["key"].tolist()
        order = sorted(range(len(keys)), key=lambda i: (keys[i], labels[i]))
        if order:
            weights = train([texts[i] for i in order], np.array([labels[i] for i in order], dtype=np.int64))
            yield pd.DataFrame({"weights": [weights.tobytes()]})

    made = chosen.coalesce(1).mapInPandas(run, "weights binary").collect()
    return np.frombuffer(made[0]["weights"], dtype=np.float32) if made else np.zeros(BUCKETS, dtype=np.float32)


def score_of(weights: np.ndarray, text: str | None) -> float:
    total, many = 0.0, 0
    for ids in features(text):
        total += float(weights[ids].sum(dtype=np.float64))
        many += len(ids)
    return float(1 / (1 + np.exp(-np.clip(total / many, -500, 500))))


def score(weights: np.ndarray, docs: DataFrame, text: Column) -> Column:
    """Probability of class 1 for a text column; the weights travel once to each executor."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([score_of(sent.value, t) for t in texts], dtype="float64")

    return run(text)


def classify(
    docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", key: str = "doc_id",
    folds: int = 3, held_fold: int = 1, most: int = LEARNT,
) -> DataFrame:
    """(key, held_out, score, predicted) for each row of ``docs``.

    Learns from labelled rows whose crc32 of the key leaves another rest than ``held_fold``, at most
    ``most`` of them. Null labels and keys are not learnt from; null and empty texts are scored by the
    document's own bucket alone. Without labelled rows every score is 0.5. Repeated rows are scored each;
    other columns are ignored. Texts are read whole, of any length; an empty table gives no rows.
    """
    fold = F.crc32(F.col(key).cast("string").cast("binary")) % folds
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    known = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).where("label in (0, 1)")
    known = known.where(F.crc32(F.col("key").cast("string").cast("binary")) % folds != held_fold).distinct()
    # At most so many labels, so the broadcast is bounded and texts stay where they are until they are chosen.
    known = known.orderBy(F.xxhash64("key"), "key", "label").limit(most)
    weights = fit(rows.join(F.broadcast(known), "key"), most)
    scored = docs.select(
        F.col(key).alias(key), F.coalesce(fold == held_fold, F.lit(False)).alias("held_out"),
        score(weights, docs, F.col(text)).alias("score"),
    )
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
