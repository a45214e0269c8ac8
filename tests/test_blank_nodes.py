import random

import pytest

from weftline.operators import blank_nodes

TRIPLE = "graph string, s string, p string, o string, o_kind string, datatype string, lang string"


def graph_of(spark, facts):
    rows = [("g", s, p, o, "bnode" if o.startswith("_:") else "iri" if o.startswith("urn:") else "literal", None, None) for s, p, o in facts]
    return spark.createDataFrame(rows, TRIPLE)


def relabelled(facts, seed):
    rng = random.Random(seed)
    old = sorted({t for f in facts for t in (f[0], f[2]) if t.startswith("_:")})
    new = dict(zip(old, rng.sample([f"_:z{i}" for i in range(1000)], len(old)), strict=True))
    return rng.sample([(new.get(s, s), p, new.get(o, o)) for s, p, o in facts], len(facts))


def ring(size, name, p="next"):
    return [(f"_:{name}{i}", p, f"_:{name}{(i + 1) % size}") for i in range(size)]


PLAIN = [("urn:a", "has", "_:x"), ("_:x", "name", "one"), ("_:x", "part", "_:y"), ("_:y", "name", "two"), ("urn:b", "has", "_:z"), ("urn:a", "p", "urn:b")]
TWINS = [("urn:a", "has", f"_:t{i}") for i in range(30)] + [(f"_:t{i}", "name", "same") for i in range(30)] + [("_:s", "self", "_:s")]


@pytest.mark.parametrize("facts", [PLAIN, ring(6, "r") + ring(3, "a") + TWINS])
def test_relabelled_copies_are_equal(spark, facts):
    found = blank_nodes.graph_difference(graph_of(spark, facts), graph_of(spark, relabelled(facts, 3)))
    assert found.collect() == []


def test_what_differs_is_reported(spark):
    changed = [("_:y", "name", "three") if f == ("_:y", "name", "two") else f for f in PLAIN]
    found = blank_nodes.graph_difference(graph_of(spark, PLAIN), graph_of(spark, relabelled(changed, 5))).collect()
    told = {(r["side"], r["p"], r["o"]) for r in found if r["o_kind"] == "literal"}
    assert {("left", "name", "two"), ("right", "name", "three")} <= told
    assert not any(r["s"] in ("urn:b",) or r["o"] == "urn:b" for r in found)
    fewer = blank_nodes.graph_difference(graph_of(spark, TWINS), graph_of(spark, relabelled([f for f in TWINS if "_:t7" not in f], 1)))
    assert {r["side"] for r in fewer.collect()} == {"left", "right"}


def test_two_triangles_are_not_a_hexagon(spark):
    """Every node of both has the same surroundings; only singling one out tells them apart."""
    both = ring(3, "a") + ring(3, "b")
    found = blank_nodes.graph_difference(graph_of(spark, ring(6, "r")), graph_of(spark, both))
    assert {r["side"] for r in found.collect()} == {"left", "right"}


def test_digest_knows_structure_not_labels(spark):
    digest = lambda facts: blank_nodes.graph_digest(graph_of(spark, facts)).first()["digest"]
    two = ring(3, "a") + ring(3, "b")
    assert digest(two) == digest(relabelled(two, 8))
    assert len({digest(two), digest(ring(6, "r")), digest(ring(3, "a"))}) == 3
