import math
import random
from collections import Counter, defaultdict

import pytest

from weftline.llm import balance
from weftline.session import literal_rows


def filled(masses, weights=(5, 2, 1), most=3):
    """Targets by resharing until no source is above its cap."""
    order = sorted(masses, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, open_ = {}, set(order)
    while True:
        left = sum(masses.values()) - sum(out.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > most * masses[s]}
        if not over:
            return out | share
        out |= {s: most * masses[s] for s in over}
        open_ -= over


def corpus(spark, sources, seed=3):
    rng = random.Random(seed)
    rows = []
    for s, (many, longest) in sources.items():
        rows += [(len(rows) + i, " ".join(["w"] * int(longest ** rng.random())), s) for i in range(many)]
    return literal_rows(spark, rows, "doc_id long, text string, source string").selectExpr("*", "7L AS size", "7L AS copies")


@pytest.mark.parametrize("sources", [
    {"a": (300, 400), "b": (200, 50), "c": (900, 90), None: (40, 900)}, {"a": (3, 9), "b": (500, 300)}, {"z": (50, 20)},
    {"a": (400, 8), "b": (5, 4), "c": (9, 700), "d": (300, 60)},
])
def test_mix(spark, sources):
    docs = corpus(spark, sources)
    found = balance.mix(docs, keys=("doc_id", "source")).collect()
    assert len(found) == docs.count()
    masses, taken, longest = Counter(), Counter(), defaultdict(int)
    for r in found:
        masses[r["source"]] += r["size"]
        taken[r["source"]] += r["size"] * r["copies"]
        longest[r["source"]] = max(longest[r["source"]], r["size"])
        assert 0 <= r["copies"] <= 3
    expected = filled(dict(masses))
    for r in found:
        assert r["source_size"] == masses[r["source"]]
        assert r["target"] == pytest.approx(expected[r["source"]], rel=1e-9)
    for s in masses:
        assert abs(taken[s] - expected[s]) <= longest[s] + 1
    again = balance.mix(docs.repartition(5), keys=("doc_id", "source")).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))


def test_rates_are_the_balanced_ones(spark):
    """Among rates with the same words, the tilted ones have the least relative entropy: log rate is linear in size."""
    counts = literal_rows(spark, [("a", 1, 50), ("a", 10, 30), ("a", 100, 5), ("a", 300, 1)], "source string, size long, n long")
    aims = literal_rows(spark, [("a", 1150, 700.0)], "source string, source_size long, target double")
    r = balance.tilts(counts, aims).first()
    rates = {z: math.exp(r["tilt"] * z / r["scale"]) for z in (1, 10, 100, 300)}
    assert 50 * rates[1] + 300 * rates[10] + 500 * rates[100] + 300 * rates[300] == pytest.approx(700, rel=1e-8)
    assert not r["full"] and r["tilt"] < 0


def test_hot_cell(spark):
    rows = [(i, "a b c", "hot") for i in range(3000)] + [(9000 + i, "x " * (i + 1), f"s{i % 3}") for i in range(60)]
    found = balance.mix(literal_rows(spark, rows, "doc_id long, text string, source string")).collect()
    hot = [r for r in found if r["doc_id"] < 3000]
    assert abs(sum(r["size"] * r["copies"] for r in hot) - hot[0]["target"]) <= 3
    assert max(r["copies"] for r in hot) - min(r["copies"] for r in hot) <= 1


def test_odd_rows(odd):
    found = balance.mix(odd).collect()
    assert len(found) == odd.count()
    assert {r["size"] for r in found if r["doc_id"] == 1} == {0}
    assert balance.mix(odd.limit(0)).count() == 0
    mixed = balance.mixed(odd)
    assert mixed.columns == odd.columns
    assert mixed.count() == sum(r["copies"] for r in found)
    only_empty = odd.where("doc_id in (1, 2)")
    assert {(r["target"], r["size"]) for r in balance.mix(only_empty).collect()} == {(0.0, 0)}
