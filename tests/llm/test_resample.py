import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from weftline.llm import resample
from weftline.llm.crc import RunningCrcs, moved
from weftline.session import literal_rows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text, longest):
    words = WORD.findall((text or "").translate(LOWER))
    return [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, longest=1, buckets=10_000, seed=2024, least=20, percent=10):
    """Rows (doc_id, n_words, n_features, weight, score, rank) without any prefix."""
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    have = Counter(bucket(g) for _, t in docs for g in grams(t, longest))
    want = Counter(bucket(g) for t in target for g in grams(t, longest))
    s, t = sum(have.values()), sum(want.values())
    gain = lambda b: math.floor(1000 * math.log((want[b] + 1) * (s + buckets) / ((have[b] + 1) * (t + buckets))))
    rows = []
    for key, text in docs:
        found = grams(text, longest)
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(g)) for g in found)
        rows.append([key, len(grams(text, 1)), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0]))
    drawn = {id(r): i + 1 for i, r in enumerate(able[: percent * len(able) // 100])}
    return sorted(((*r, drawn.get(id(r))) for r in rows), key=repr)


@pytest.mark.parametrize("size", [0, 1, 255, 256, 257, 5000, 300_000])
def test_parts_of_running_crcs(size):
    rng = np.random.default_rng(size)
    data = rng.integers(0, 256, size).astype(np.uint8)
    crcs = RunningCrcs(data)
    ends = np.sort(rng.integers(0, size + 1, (40, 2)), axis=1)
    ends[0], ends[1] = (0, size), (size, size)
    for (a, b), found in zip(ends, crcs.between(ends[:, 0], ends[:, 1]), strict=True):
        assert found == zlib.crc32(data[a:b].tobytes())


def test_moves_of_many_bytes():
    lengths = np.array([0, 1, 255, 256, 1000, 65_536, 1_000_003])
    start = zlib.crc32(b"before")
    found = moved(np.full(len(lengths), start, dtype=np.uint32), lengths)
    for n, crc in zip(lengths, found, strict=True):
        tail = bytes(int(n))
        assert crc ^ zlib.crc32(tail) == zlib.crc32(b"before" + tail)


@pytest.mark.parametrize("longest", [1, 3])
def test_against_brute_force(spark, longest):
    rng = random.Random(longest)
    alphabet = ["The", "cat", "é", "\U0001F600", "x1", "--", "\n", "a.b", "ß" * 90, "q" * 700, "\x00", "İ"]
    docs = [(i, "".join(rng.choice(alphabet) + rng.choice(["", " ", ", "]) for _ in range(rng.choice([0, 3, 30, 200])))) for i in range(250)]
    target = [t for _, t in docs[:9]]
    have = literal_rows(spark, docs, "doc_id long, text string").repartition(3)
    want = literal_rows(spark, list(enumerate(target)), "item_id long, text string")
    found = resample.resample(have, want, longest=longest, buckets=500)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(docs, target, longest, 500)


def test_odd_rows(spark, odd):
    target = literal_rows(spark, [(1, None), (2, "word1 and1 word2")], "item_id long, text string")
    found = resample.resample(odd, target, percent=100, least_words=1).collect()
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    expected = brute(docs, [None, "word1 and1 word2"], least=1, percent=100)
    assert sorted((tuple(r)[:5] for r in found), key=repr) == sorted((r[:5] for r in expected), key=repr)
    ranked = sorted((r["rank"], -r["score"]) for r in found if r["rank"] is not None)
    assert [r for r, _ in ranked] == list(range(1, len(ranked) + 1)) and ranked == sorted(ranked, key=lambda r: (r[1], r[0]))
    assert len(ranked) == sum(r[1] >= 1 for r in expected)
    assert resample.resample(odd.limit(0), target).count() == 0
    assert resample.resample(odd, target.limit(0)).count() == odd.count()


def test_hot_rows(spark):
    """A third of all rows alike, and a whole table of ties: ranks stay 1, 2, 3, ... over many ranges."""
    rows = [(7, "same words " * 12)] * 500 + [(i, f"text {i} " * 12) for i in range(1000)]
    found = resample.resample(literal_rows(spark, rows, "doc_id long, text string"), literal_rows(spark, [(1, "text")], "i long, text string"), percent=90)
    ranks = sorted(r["rank"] for r in found.select("rank").collect() if r["rank"] is not None)
    assert ranks == list(range(1, 1351))
