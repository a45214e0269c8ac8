import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_simhash import reach
from weftline.llm import near_texts
from weftline.session import literal_rows


def shingles(text, words=5):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for blank in "\t\n\x0b\x0c\r":
        lower = lower.replace(blank, " ")
    tokens = [t for t in lower.split(" ") if t]
    return {" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))} if tokens else set()


def families():
    """Unrelated texts, copies with a few words changed, and a chain whose ends differ."""
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(4000)]
    out = []
    for _ in range(25):
        base = rng.choices(vocabulary, k=rng.randrange(60, 300))
        out.append(base)
        for changes in (0, 1, 1, 2, 4, 9):
            copy = list(base)
            for at in rng.sample(range(len(copy)), changes):
                copy[at] = rng.choice(vocabulary)
            out.append(copy)
    at = rng.choices(vocabulary, k=400)
    for _ in range(12):
        at = list(at)
        start = rng.randrange(380)
        at[start : start + 15] = rng.choices(vocabulary, k=15)
        out.append(at)
    rng.shuffle(out)
    return [" ".join(words) for words in out] + ["a b", "A  b\n", "a c", "", None, " \n"]


@pytest.mark.parametrize("shard_rows", [4096, 3])
def test_against_all_pairs(spark, shard_rows):
    texts = families()
    sets = [shingles(t) for t in texts]
    rate = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    near = [(i, j) for i in range(len(sets)) for j in range(i + 1) if rate(sets[i], sets[j]) >= 0.8]
    table = literal_rows(spark, list(enumerate(texts)), "doc_id long, text string")
    kept = {r["doc_id"] for r in near_texts.representatives(table, shard_rows=shard_rows).collect()}
    expected = set(reach(near).values())
    # Nothing below 0.8 goes; of what is to go, nine in ten do at least.
    assert expected <= kept
    assert 10 * len(kept - expected) <= len(texts) - len(expected)


@pytest.mark.parametrize("shard_rows", [4096, 3])
def test_no_similar_pair_is_missed(spark, shard_rows):
    """Short texts that differ in a word, whose fingerprints are far apart, behind a passage that many texts share."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(4000)]
    passage = rng.choices(vocabulary, k=9)
    texts = []
    for n in range(60):
        base = rng.choices(vocabulary, k=rng.randrange(8, 40)) + passage * (n % 2)
        texts += [base, base + [rng.choice(vocabulary)], base[:-1]]
    texts = [" ".join(words) for words in texts]
    sets = [shingles(t) for t in texts]
    near = [(i, j) for i in range(len(sets)) for j in range(i + 1) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    table = literal_rows(spark, list(enumerate(texts)), "doc_id long, text string")
    kept = {r["doc_id"] for r in near_texts.representatives(table, shard_rows=shard_rows).collect()}
    assert kept == set(reach(near).values()) and len(kept) < 100


def test_a_dense_group_gives_few_candidates(spark):
    rng = random.Random(2)
    rows = [(rng.getrandbits(3), i, 100, i) for i in range(600)]
    nodes = literal_rows(spark, rows, "fp long, node long, size int, class long")
    few = near_texts.candidates(nodes, 14, 5, every=False).collect()
    assert len(few) < 10 * len(rows)
    assert set(reach((r["a"], r["b"]) for r in few).values()) == {0}
    assert near_texts.candidates(nodes, 14, 5, every=True).count() == 600 * 599 // 2


def test_sizes_and_classes_rule_pairs_out(spark):
    rows = [(0, 1, 100, 1), (0, 2, 80, 2), (0, 3, 79, 3), (0, 4, 100, 1), ((1 << 15) - 1, 5, 100, 5)]
    nodes = literal_rows(spark, rows, "fp long, node long, size int, class long")
    found = {(r["a"], r["b"]) for r in near_texts.candidates(nodes, 14, 5, every=True).collect()}
    assert found == {(2, 1), (3, 2), (4, 2)}


def test_fingerprint_is_that_of_the_operator():
    from weftline.llm import simhash

    for text in families()[:20] + ["a b c a b c a b c"]:
        assert near_texts.fingerprint_of(near_texts.hashes_of(text, 5)) == simhash.fingerprint_of(text, 5)
    assert len(np.unique(near_texts.hashes_of("a b c d e " * 50, 5))) == 5


def test_signs_follow_the_similarity(spark):
    rng = np.random.default_rng(3)

    def apart(shared, own):
        sets = rng.integers(0, 1 << 63, shared, dtype=np.uint64), *rng.integers(0, 1 << 63, (2, own), dtype=np.uint64)
        return (near_texts.sign_of(np.append(sets[0], sets[1])) ^ near_texts.sign_of(np.append(sets[0], sets[2]))).bit_count()

    # 0.8, 0.5 and nothing shared; sets of one block and of several.
    for many in (80, 8000):
        mean = [np.mean([apart(*of) for _ in range(30)]) for of in ((many, many // 8), (many, many // 2), (0, many))]
        assert np.allclose(mean, [6.4, 16, 32], atol=2.5)
    assert near_texts.sign_of(np.zeros(0, dtype=np.uint64)) == 0
    rows = [(0, 1, 100, 1, 0), (0, 2, 100, 2, (1 << 16) - 1), (0, 3, 100, 3, -1 << 47)]
    nodes = literal_rows(spark, rows, "fp long, node long, size int, class long, sign long")
    found = {(r["a"], r["b"]) for r in near_texts.candidates(nodes, 14, 5, every=True).collect()}
    assert found == {(2, 1)}


def test_parities_rule_out_no_similar_pair(spark):
    rng = np.random.default_rng(5)
    pairs = []
    for many in (1, 4, 9, 40, 300, 3000):
        for part in (0.6, 0.75, 0.8, 0.81, 0.9, 1.0):
            one = [int(x) for x in rng.integers(-(1 << 63), 1 << 63, many)]
            shared = min(many, -(-int(2000 * part * many) // int(1000 * (1 + part))))
            pairs.append((one, one[:shared] + [int(x) for x in rng.integers(-(1 << 63), 1 << 63, many - shared)]))
            pairs.append((one, one[: -(-int(part * 100) * many // 100)]))
    table = spark.createDataFrame(pairs, "a array<long>, b array<long>")
    sizes = F.size("a"), F.size("b")
    odd = near_texts.parities(F.col("a"), sizes[0]), near_texts.parities(F.col("b"), sizes[1])
    found = table.select("a", "b", near_texts.may_share(*odd, *sizes).alias("may")).collect()
    rates = [(len(set(r["a"]) & set(r["b"])) / len(set(r["a"]) | set(r["b"])), len(r["a"]), r["may"]) for r in found]
    assert all(may for rate, _, may in rates if rate >= 0.8) and sum(rate >= 0.8 for rate, *_ in rates) > 30
    assert not any(may for rate, many, may in rates if rate < 0.7 and many >= 300)


def test_pairs_below_the_similarity_are_no_rows(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(4000)]
    base = rng.choices(vocabulary, k=200)
    rows = []
    for i in range(150):
        copy = list(base)
        for at in rng.sample(range(200), 5 if i < 148 else 0):
            copy[at] = rng.choice(vocabulary)
        hashes = near_texts.hashes_of(" ".join(copy + [f"e{i}"]), 5)
        held = np.unique(hashes)
        prints = np.array([near_texts.fingerprint_of(hashes), near_texts.sign_of(held)], dtype=np.uint64).view(np.int64)
        rows.append((int(prints[0]), i, len(held), i, int(prints[1]), held.view(np.int64).tolist()))
    table = spark.createDataFrame(rows, "fp long, node long, size int, class long, sign long, held array<long>")
    nodes = table.withColumn("odd", near_texts.parities(F.col("held"), F.col("size"))).drop("held")
    near = {
        (a, b) for a in range(150) for b in range(a)
        if 9 * len({*rows[a][5]} & {*rows[b][5]}) >= 4 * (len(rows[a][5]) + len(rows[b][5]))
    }
    every = {tuple(r) for r in near_texts.candidates(nodes.drop("odd"), 14, 5, every=True).collect()}
    found = {tuple(r) for r in near_texts.candidates(nodes, 14, 5, every=True).collect()}
    assert len(every) > 2000 > 1000 > len(found)
    assert every & near <= found <= every
    for shard_rows in (4096, 20):
        few = {r["node"] for r in near_texts.paired(nodes.drop("odd"), 14, 5, shard_rows).collect()}
        assert few == {x for pair in every for x in pair}
    sizes = np.array([r[2] for r in rows])
    odd = np.array([bytes(r["odd"]) for r in nodes.orderBy("node").collect()], dtype=object)
    a, b = np.array(sorted(near)).T
    assert near_texts._may_share(odd, sizes, a, b).all()


def test_odd_rows(spark, odd):
    kept = near_texts.representatives(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 4, 5, 7, 8]
    assert near_texts.representatives(odd.limit(0)).count() == 0
