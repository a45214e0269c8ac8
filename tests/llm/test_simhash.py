import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from weftline.llm import links, simhash
from weftline.session import literal_rows


def reach(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


@pytest.mark.parametrize("edges", [
    [(i, i + 1) for i in range(200)], [(0, i) for i in range(1, 200)], [(500 - i, i) for i in range(100)] + [(7, 7), (1, 2), (2, 1)],
    [(random.Random(3).randrange(150) * 7 % 150, i) for i in range(150)],
])
def test_components(spark, edges):
    found = links.components(literal_rows(spark, edges, "a long, b long")).collect()
    expected = {k: v for k, v in reach(e for e in edges if e[0] != e[1]).items()}
    assert {r["node"]: r["root"] for r in found} == expected
    assert len(found) == len(expected)


def test_components_of_nothing(spark):
    assert links.components(literal_rows(spark, [], "a long, b long")).count() == 0


def plain(text, words):
    tokens = [t for t in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).replace("\n", " ").split(" ") if t]
    shingles = [" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))] if tokens else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", ["", "One", "a b c", "The cat SAT on the mat", "a b a b a b a b a b", "é ß\nÉ x y z w"])
def test_fingerprint(text):
    assert simhash.fingerprint_of(text, 4) == plain(text, 4)
    assert simhash.fingerprint_of(None) == 0


def test_shingle_hash_is_the_column_function(spark):
    row = spark.range(1).select(F.xxhash64(F.lit("a b c d")).alias("h")).first()
    assert row["h"] % (1 << 64) == xxhash.xxh64_intdigest(b"a b c d", 42)


def fingerprints():
    """Random ones, chains in steps of up to eight bits, and a dense group."""
    rng = random.Random(1)
    out = [rng.getrandbits(64) for _ in range(300)]
    for base in out[:60]:
        at = base
        for _ in range(6):
            for bit in rng.sample(range(64), rng.randrange(1, 9)):
                at ^= 1 << bit
            out.append(at)
    dense = rng.getrandbits(64)
    out += [dense ^ (1 << a) ^ (1 << b) for a in range(0, 64, 3) for b in range(0, 64, 5)]
    return sorted(set(out))


@pytest.mark.parametrize(("radius", "bands", "shard_rows"), [(4, 3, 4096), (4, 3, 4), (7, 4, 4096), (3, 5, 16), (5, 2, 64)])
def test_links_against_all_pairs(spark, radius, bands, shard_rows):
    prints = np.array(fingerprints(), dtype=np.uint64)
    a, b = np.nonzero(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= radius)
    signed = prints.view(np.int64)
    expected = reach((int(signed[i]), int(signed[j])) for i, j in zip(a, b, strict=True))
    table = literal_rows(spark, [(int(x),) for x in signed], "fp long")
    found = simhash.links(table, radius, bands, shard_rows).collect()
    assert all((r["a"] ^ r["b"]).bit_count() <= 64 for r in found)
    joined = reach([(int(x), int(x)) for x in signed] + [(r["a"], r["b"]) for r in found])
    assert joined == expected


def test_dense_groups_give_few_links(spark):
    signed = [1 << i | 1 << j for i in range(40) for j in range(i)]
    found = simhash.links(literal_rows(spark, [(x,) for x in signed], "fp long"), shard_rows=100)
    assert found.count() < 40 * len(signed)


def test_odd_rows(spark, odd, rows):
    found = rows(simhash.near_duplicates(odd).select("doc_id", "component"))
    assert len(found) == odd.count()
    classes = {(k if k is None else int(k)): c for k, c in found if k is not None}
    assert classes[1] == classes[2] == classes[3] == 1
    assert classes[5] == classes[6] == 5
    assert (None, 1) in found and (None, 5) in found
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_representatives(spark, odd, rows):
    kept = simhash.representatives(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 4, 5, 7, 8]
    assert simhash.representatives(odd.limit(0)).count() == 0
