import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import closure as reach
from weftline.operators import graph, search, shapes
from weftline.operators.graph import Literal
from weftline.sources import triples
from weftline.sources.triples import LANG_STRING, RDF_TYPE, RDFS, RDFS_LABEL, XSD, XSD_STRING

TRIPLE = "graph string, s string, p string, o string, o_kind string, datatype string, lang string"


def iri(s, p, o):
    return ("g", s, p, o, "iri", None, None)


def text(s, p, o, datatype=XSD_STRING, lang=None):
    return ("g", s, p, o, "literal", LANG_STRING if lang else datatype, lang)


def edge_frame(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def strongly(pairs):
    """Components with a cycle, by reachability; each node with the largest of its component."""
    ahead = {}
    for u, v in pairs:
        ahead.setdefault(u, set()).add(v)
    reach_of = {}
    for u in {x for p in pairs for x in p}:
        seen, todo = set(), [u]
        while todo:
            for v in ahead.get(todo.pop(), ()):
                if v not in seen:
                    seen.add(v)
                    todo.append(v)
        reach_of[u] = seen
    return {frozenset(v for v in reach_of[u] if u in reach_of[v]) | {u} for u in reach_of if any(v != u and u in reach_of[v] for v in reach_of[u])}


@pytest.mark.parametrize("pairs", [
    [(i, (i + 1) % 5) for i in range(5)] + [(4, 10), (10, 11), (11, 12), (12, 20)] + [(20 + i, 20 + (i + 1) % 6) for i in range(6)] + [(30, 31), (31, 0)],
    [(0, 1), (1, 2), (2, 0), (0, 3), (3, 4), (4, 0), (2, 7), (7, 8), (8, 1), (9, 9), (8, 9)],
])
def test_components_of_chains_and_rings(spark, pairs):
    found = reach.strong_components(spark.createDataFrame(pairs, "src long, dst long")).collect()
    groups = {}
    for r in found:
        groups.setdefault(r["component"], set()).add(r["node"])
    assert len(found) == len({r["node"] for r in found})
    assert set(map(frozenset, groups.values())) == strongly([p for p in pairs if p[0] != p[1]])


def test_long_chain_takes_few_rounds(spark, monkeypatch):
    """A chain of 100,000 nodes into a ring of 3,000: rounds grow with the digits of the lengths."""
    chain = spark.range(100_000).selectExpr("id AS src", "id + 1 AS dst")
    ring = spark.range(3_000).selectExpr("100000 + id AS src", "100000 + (id + 1) % 3000 AS dst")
    tail = spark.range(500).selectExpr("CASE WHEN id = 0 THEN 100007 ELSE 200000 + id END AS src", "200001 + id AS dst")
    rounds, cut = [], reach.cut_lineage

    def counted(df):
        rounds.append(1)
        return cut(df)

    monkeypatch.setattr(reach, "cut_lineage", counted)
    edges = chain.union(ring).union(tail)
    found = reach.cycle_edges(edges, spark.createDataFrame([(5,), (200100,), (101000,)], "seed long"))
    assert {r["seed"]: r["n"] for r in found.groupBy("seed").agg(F.count("*").alias("n")).collect()} == {5: 3_000, 101_000: 3_000}
    assert len(rounds) <= 120  # every written step of all rounds; one for each node before


def joined_rows(df):
    """Most rows that a join of the executed plan gave out."""
    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.queryExecution().toRdd().count()
    most, todo = 0, [plan]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            metric = node.metrics().get("numOutputRows")
            if "Join" in kind and metric.isDefined():
                most = max(most, metric.get().value())
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return most


def test_dangling_hub_is_not_multiplied(spark):
    """A star and a chain whose hub has 300 values on two sides and nothing on the third."""
    def triples_of(pairs):
        return spark.createDataFrame([("g", s, p, o, "iri", None, None) for s, p, o in pairs], "graph string, s string, p string, o string, o_kind string, datatype string, lang string")

    star = [("hub", p, f"{p}{i}") for p in "ab" for i in range(300)] + [(f"n{i}", p, f"v{i}") for i in range(20) for p in "abc"]
    found = graph.bgp(triples_of(star), [("?s", "a", "?x"), ("?s", "b", "?y"), ("?s", "c", "?z")])
    assert found.count() == 20 and joined_rows(found) <= len(star) + 20
    chain = [(f"l{i}", "a", "hub") for i in range(300)] + [("hub", "b", f"r{i}") for i in range(300)] + [("l0", "a", "m"), ("m", "b", "q"), ("q", "c", "end")]
    found = graph.bgp(triples_of(chain), [("?w", "a", "?x"), ("?x", "b", "?y"), ("?y", "c", "?z")])
    assert [tuple(r) for r in found.select("w", "x", "y", "z").collect()] == [("l0", "m", "q", "end")] and joined_rows(found) <= len(chain) + 1
    circle = [("a", "p", "b"), ("b", "q", "c"), ("c", "r", "a"), ("b", "q", "d")]
    found = graph.bgp(triples_of(circle), [("?x", "p", "?y"), ("?y", "q", "?z"), ("?z", "r", "?x")])
    assert [tuple(r) for r in found.select("x", "y", "z").collect()] == [("a", "b", "c")]


def test_three_cycle(spark, rows):
    edges = edge_frame(spark, [("A", "B"), ("B", "C"), ("C", "A")])
    seed = spark.createDataFrame([("A",)], "seed string")
    found = reach.closure(edges, seed)
    assert rows(found.pairs) == [("A", "B", 1), ("A", "C", 2)]
    assert rows(reach.traversal_status(seed, found)) == [("A", False, "SUCCESS", None)]
    assert rows(reach.cycle_edges(edges, seed)) == [("A", "A", "B"), ("A", "B", "C"), ("A", "C", "A")]


def test_seventeen_edges_are_cut_at_sixteen(spark, rows):
    edges = edge_frame(spark, [(f"N{n}", f"N{n + 1}") for n in range(17)])
    seed = spark.createDataFrame([("N0",), ("N1",)], "seed string")
    found = reach.closure(edges, seed)
    assert rows(found.pairs.where("seed = 'N0'"), "node", "distance") == sorted(((f"N{n}", n) for n in range(1, 17)), key=repr)
    assert rows(reach.traversal_status(seed, found)) == [
        ("N0", True, "EMPTY_RESULT", "PREREQUISITE_DEPTH_EXCEEDED"), ("N1", False, "SUCCESS", None),
    ]


def test_depth_zero_and_bad_depth(spark, rows):
    edges = edge_frame(spark, [("A", "B")])
    found = reach.all_pairs(edges, max_depth=0)
    assert rows(found.pairs) == [] and rows(found.truncated) == [("A",)]
    with pytest.raises(ValueError):
        reach.all_pairs(edges, max_depth=-1)


def _brute(pairs):
    nodes = {n for p in pairs for n in p}
    after = {n: {d for s, d in pairs if s == n} for n in nodes}
    distances = {}
    for seed in nodes:
        seen, frontier, depth = {seed: 0}, [seed], 0
        while frontier:
            depth += 1
            frontier = [d for d in {d for n in frontier for d in after[n]} if d not in seen]
            seen.update({d: depth for d in frontier})
        distances[seed] = {n: d for n, d in seen.items() if n != seed}
    return nodes, distances


@pytest.mark.parametrize("number", [1, 2])
def test_random_graphs_against_brute_force(spark, rows, number):
    pick = random.Random(number)
    names = [f"n{i:02d}" for i in range(14)]
    pairs = sorted({(pick.choice(names), pick.choice(names)) for _ in range(20)} | {("n00", n) for n in names[1:6]})
    nodes, distances = _brute(pairs)
    edges = edge_frame(spark, pairs)
    seeds = spark.createDataFrame([(n,) for n in sorted(nodes)], "seed string")
    expected = sorted(((s, n, d) for s in nodes for n, d in distances[s].items()), key=repr)
    assert rows(reach.closure(edges, seeds, None).pairs) == expected
    on_cycle = [(u, v) for u, v in pairs if u == v or u in distances[v]]
    cycles = sorted({(s, u, v) for s in nodes for u, v in on_cycle if u == s or u in distances[s]}, key=repr)
    assert rows(reach.cycle_edges(edges, seeds)) == cycles


@pytest.fixture(scope="module")
def notes(spark):
    return spark.createDataFrame(
        [
            iri("n1", RDF_TYPE, "Note"), text("n1", "number", "1"), text("n1", "title", "one", lang="en"), iri("n1", "affects", "c1"),
            iri("n2", RDF_TYPE, "Note"), text("n2", "number", "1", XSD + "integer"), iri("n2", "affects", "c2"), text("n2", "affects", "c1"),
            text("c1", "code", "A-B"), text("c2", "code", "A"), iri("c1", "parent", "c2"),
        ],
        TRIPLE,
    )


def test_patterns(notes, rows):
    found = graph.bgp(notes, [("?n", "affects", "?c"), ("?c", "code", "?code"), ("?n", RDF_TYPE, "Note")])
    assert rows(found, "n", "code") == [("n1", "A-B"), ("n2", "A")]
    assert rows(graph.bgp(notes, [("?n", "number", Literal("1"))])) == [("n1",)]
    assert graph.ask(graph.bgp(notes, [("?n", "number", Literal("1", XSD + "integer"))]))
    # Equal texts of different datatype are different terms.
    same = graph.bgp(notes, [("?a", "number", "?v"), ("?b", "number", "?v")])
    assert rows(same, "a", "b") == [("n1", "n1"), ("n2", "n2")]
    titled = graph.optional(graph.bgp(notes, [("?n", RDF_TYPE, "Note")]), notes, [("?n", "title", "?t")])
    assert rows(titled) == [("n1", "one"), ("n2", None)]
    with pytest.raises(ValueError, match="share no variable"):
        graph.bgp(notes, [("?a", "number", "?b"), ("?c", "code", "?d")])


def test_paths(notes, rows):
    affects, parent = graph.edges(notes, "affects"), graph.edges(notes, "parent")
    assert rows(graph.sequence_path(affects, parent)) == [("n1", "c2")]
    assert rows(graph.alternative_path(affects, parent)) == [("c1", "c2"), ("n1", "c1"), ("n2", "c2")]
    assert rows(graph.zero_or_more_path(parent)) == [("c1", "c1"), ("c1", "c2"), ("c2", "c2")]


def _note_graph(spark):
    return search.NoteGraph(
        notes=spark.createDataFrame(
            [("a", "0000001", "t", 0, 2, "High"), ("b", "0000002", "t", 3, 5, "Low"), ("c", "0000003", None, 0, 9, "Low"), ("d", "0000004", "t", 0, 9, "Low")],
            "note string, note_number string, title string, min_sp int, max_sp int, priority string",
        ),
        alerts=spark.createDataFrame([("a", "X"), ("b", "X"), ("c", "X"), ("d", "Y")], "note string, alert_code string"),
        components=spark.createDataFrame([("a", "MM-PUR-PO"), ("b", "MM-PUR"), ("d", "MM")], "note string, component_code string"),
        versions=spark.createDataFrame([("a", "V1"), ("b", "V1")], "note string, product_version string"),
        parents=spark.createDataFrame(
            [("MM-PUR-PO", "MM-PUR"), ("MM-PUR", "MM"), ("MM", None)], "component_code string, parent_code string"
        ),
    )


REQUEST = "request_id int, note_number string, alert_code string, component_code string, product_version string, priority string, support_package int"


def test_note_search_by_any_slots(spark, rows):
    requests = spark.createDataFrame(
        [
            (1, "0000002", None, None, None, None, None), (2, None, "X", None, None, None, None), (3, None, "X", "MM", None, None, 4),
            (4, None, None, "MM-PUR", "V1", "High", None), (5, None, "X", None, None, None, 9), (6, None, "X", "MM", None, None, 4),
        ],
        REQUEST,
    )
    found = search.note_search(requests, _note_graph(spark))
    # Note c has no title; a component covers the ones below it.
    assert rows(found, "request_id", "note", "rank") == [(1, "b", 1), (2, "a", 2), (2, "b", 1), (3, "b", 1), (4, "a", 1), (6, "b", 1)]
    assert rows(search.note_search(requests, _note_graph(spark), top=1), "request_id", "note")[1] == (2, "b")
    unanchored = requests.select("request_id", "priority").where("request_id = 4")
    assert search.note_search(unanchored, _note_graph(spark)).count() == 0
    assert rows(search.rejected_requests(unanchored)) == [(4, "MISSING_REQUIRED_ENTITY")]


@pytest.mark.parametrize("by_code", [False, True])
def test_relaxation_stops_at_the_first_step_that_helps(spark, rows, by_code):
    requests = spark.createDataFrame(
        [
            (1, None, "X", "MM-PUR", None, None, 1), (2, None, "X", "MM-PUR-PO", None, None, 7), (3, None, "Y", "MM-PUR", None, None, 5),
            (4, None, "Y", "MM-PUR-PO", None, None, None), (5, None, "X", "MM", None, None, 99),
        ],
        REQUEST,
    )
    result = search.relax_search(requests, _note_graph(spark), by_code=by_code)
    assert rows(search.relaxation_outcome(requests, result)) == [
        (1, "SUCCESS", "strict", 0, "NONE", 1), (2, "EMPTY_RESULT", "relaxed", 1, "RELAX_SUPPORT_PACKAGE", 1),
        (3, "EMPTY_RESULT", "relaxed", 2, "WIDEN_COMPONENT", 1), (4, "EMPTY_RESULT", "none", 2, "WIDEN_COMPONENT", 0),
        (5, "EMPTY_RESULT", "relaxed", 1, "RELAX_SUPPORT_PACKAGE", 2),
    ]
    strict = {r[0] for r in rows(result.strict, "request_id")}
    assert not strict & {r[0] for r in rows(result.relaxed, "request_id")}
    none = search.relax_search(requests, _note_graph(spark), budget=0)
    assert rows(none.relaxed) == []


S, P = "https://example.test/support#", "https://example.test/ppms#"
_EN = ["en"]


def support_shapes(spark):
    def tagged(shape, target, path, required):
        rows = [(shape, target, path, "datatype", LANG_STRING, "m"), (shape, target, path, "languageIn", _EN, "m")]
        return rows + ([(shape, target, path, "minCount", 1, "m")] if required else [])

    note, version = S + "Note", P + "ComponentVersion"
    return shapes.shape_table(
        spark,
        [
            *tagged("Note", note, RDFS_LABEL, True), *tagged("Note", note, S + "title", True),
            ("Note", note, S + "noteNumber", "minCount", 1, "m"), ("Note", note, S + "noteNumber", "maxCount", 1, "m"),
            ("Note", note, S + "noteNumber", "datatype", XSD_STRING, "m"),
            ("Note", note, S + "priority", "in", [("High", XSD_STRING), ("Low", XSD_STRING)], "m"),
            ("Note", note, S + "affects", "class", S + "Component", "m"), ("Note", note, S + "affects", "minCount", 1, "m"),
            ("Note", note, S + "validFor", "class", version, "m"), ("Note", note, S + "validFor", "minCount", 1, "m"),
            ("Note", note, S + "product", "minCount", 1, "m"),
            *tagged("Version", version, RDFS_LABEL, True), ("Version", version, P + "string", "minCount", 1, "m"),
        ],
    )


def test_invalid_support_graph(spark, rows):
    data = spark.createDataFrame(
        [
            iri("x:n", RDF_TYPE, S + "Note"), text("x:n", S + "noteNumber", "INVALID"), text("x:n", S + "title", "Invalid title"),
            text("x:n", S + "priority", "High"), iri("x:n", S + "validFor", "x:v"), iri("x:v", RDF_TYPE, P + "ComponentVersion"),
        ],
        TRIPLE,
    )
    found = shapes.validate(data, support_shapes(spark))
    assert rows(found, "focus", "path", "constraint") == sorted(
        [
            ("x:n", RDFS_LABEL, "minCount"), ("x:n", S + "title", "datatype"), ("x:n", S + "title", "languageIn"), ("x:n", S + "affects", "minCount"),
            ("x:n", S + "product", "minCount"), ("x:v", RDFS_LABEL, "minCount"), ("x:v", P + "string", "minCount"),
        ],
        key=repr,
    )
    checks = shapes.conformance([("bad", found, False), ("worse", found, True), ("empty", found.where("false"), True)])
    assert rows(checks, "check_id", "result") == [("bad", "EXPECTED_NONCONFORMANT"), ("empty", "PASS"), ("worse", "FAIL")]


def test_value_constraints(spark, rows):
    data = spark.createDataFrame(
        [
            iri("p", RDF_TYPE, "Posting"), text("p", "amount", "-10.00", XSD + "decimal"), text("p", "day", "2026-02-30", XSD + "date"),
            text("p", "status", "POSTED"), text("q", "amount", "x", XSD + "decimal"), iri("q", RDF_TYPE, "Posting"), text("q", "status", "OPEN"),
        ],
        TRIPLE,
    )
    checks = shapes.shape_table(
        spark,
        [
            ("S", "Posting", "amount", "minInclusive", 0, "m"), ("S", "Posting", "amount", "datatype", XSD + "decimal", "m"),
            ("S", "Posting", "day", "datatype", XSD + "date", "m"), ("S", "Posting", "status", "in", [("POSTED", XSD_STRING)], "m"),
        ],
    )
    found = shapes.validate(data, checks, entail=False)
    assert rows(found, "focus", "path", "constraint") == [
        ("p", "amount", "minInclusive"), ("p", "day", "datatype"), ("q", "amount", "datatype"), ("q", "amount", "minInclusive"), ("q", "status", "in"),
    ]


def test_range_axiom_hides_a_class_violation(spark, rows):
    data = spark.createDataFrame([iri("n", RDF_TYPE, S + "Note"), iri("n", S + "affects", "c")], TRIPLE)
    axioms = spark.createDataFrame([iri(S + "affects", RDFS + "range", S + "Leaf"), iri(S + "Leaf", RDFS + "subClassOf", S + "Component")], TRIPLE)
    only_class = support_shapes(spark).where("constraint = 'class'")
    assert rows(shapes.validate(data, only_class), "constraint") == [("class",)]
    assert rows(shapes.validate(data, only_class, axioms), "constraint") == []


def test_superproperty_brings_its_domain(spark, rows):
    data = spark.createDataFrame([iri("a", "p", "b")], TRIPLE)
    axioms = spark.createDataFrame(
        [iri("p", RDFS + "subPropertyOf", "q"), iri("q", RDFS + "subPropertyOf", "r"), iri("r", RDFS + "domain", "D"), iri("D", RDFS + "subClassOf", "E")], TRIPLE
    )
    assert rows(shapes.rdfs_entail(data, axioms), "s", "p", "o") == sorted(
        [("a", "p", "b"), ("a", "q", "b"), ("a", "r", "b"), ("a", RDF_TYPE, "D"), ("a", RDF_TYPE, "E")], key=repr
    )


@pytest.mark.parametrize("is_set", [False, True])
def test_entailment_is_a_set(spark, rows, is_set):
    """Super-triples that follow twice or are also stated come once, as do types that a property brings."""
    sub, kind = RDFS + "subPropertyOf", S + "kind"
    stated = [iri("a", "p", "b"), iri("a", "q", "b"), iri("a", "r", "b"), iri("a", "x", "b"), iri("a", kind, "C"), iri("a", RDF_TYPE, "C"), text("a", RDF_TYPE, "C")]
    axioms = spark.createDataFrame(
        [iri("p", sub, "pq"), iri("q", sub, "pq"), iri("r", sub, "x"), iri("q", sub, "once"), iri(kind, sub, RDF_TYPE),
         iri("pq", RDFS + "domain", "C"), iri("p", RDFS + "range", "D")], TRIPLE
    )
    data = spark.createDataFrame(stated if is_set else stated * 2, TRIPLE)
    implied = [iri("a", "pq", "b"), iri("a", "once", "b"), iri("b", RDF_TYPE, "D")]
    assert rows(shapes.rdfs_entail(data, axioms, is_set=is_set)) == sorted(stated + implied, key=repr)


def test_entailment_compares_only_types_of_a_set(spark):
    """Whole triples of a set are not moved: only pairs of node and class are."""
    from weftline.plans import shapes as plans
    from weftline.plans.tables import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    made = shapes.rdfs_entail(plans.note_graph(t).localCheckpoint(), plans.ontology(t), is_set=True)
    plan = made._jdf.queryExecution().optimizedPlan().toString().splitlines()
    grouped = [line.split("Aggregate [")[1].split("]")[0] for line in plan if "Aggregate [" in line]
    assert grouped and not any("datatype" in g for g in grouped)


def test_scope_and_labels(spark, rows):
    data = spark.createDataFrame(
        [iri("ok:a", RDF_TYPE, "ok:T"), iri("ok:a", "ok:p", "no:b"), text("ok:a", "ok:name", "x"), text("no:a", "ok:name", "x")], TRIPLE
    )
    assert rows(triples.scope(data, ["ok:"]), "s", "o") == [("ok:a", "ok:T"), ("ok:a", "x")]
    labelled = triples.complete_labels(data, {"ok:T": "ok:name"})
    assert rows(labelled.where(f"p = '{RDFS_LABEL}'"), "s", "o", "lang") == [("ok:a", "x", "en")]
    assert triples.complete_labels(labelled, {"ok:T": "ok:name"}).count() == 5


def test_dataset_label(spark, rows):
    data = spark.createDataFrame([text("a", "id", "two"), text("b", "id", "one"), text("c", "id", "one")], TRIPLE)
    assert rows(shapes.dataset_label(data, "id")) == [("one+two",)]
    with pytest.raises(Exception, match="no dataset"):
        shapes.dataset_label(data, "other").collect()


def test_tasks_of_a_merge_follow_its_rows(spark, monkeypatch):
    """Equal triples meet in as many tasks as the rows need; small graphs stay as they are."""
    from weftline import session

    monkeypatch.setattr(session, "TASK_ROWS", 10)
    columns = "'data' AS graph, 's' || id % 150 AS s, 'p' AS p, 'o' AS o, 'iri' AS o_kind, cast(NULL AS string) AS datatype, cast(NULL AS string) AS lang"
    given = spark.range(300).selectExpr(*columns.split(", "))
    merged = triples.merge_graphs([given, given], "data", 600)
    assert merged.count() == 150
    assert merged.rdd.getNumPartitions() == 60
    assert session.spread(given, 9, "s") is given


def test_tasks_of_part_triples_follow_the_parts(spark, monkeypatch):
    """However few files the parts lie in, one task holds only the triples of some of them."""
    from weftline import session
    from weftline.plans import graphs
    from weftline.plans.tables import Tables

    monkeypatch.setattr(session, "TASK_ROWS", 100)
    t = Tables(spark, "/root/testdata/sf0.001")
    made = graphs.part_triples(t)
    assert made.rdd.getNumPartitions() == -(-graphs.PART_TRIPLES * t.part.count() // 100) > 1
    assert graphs.note_graph(t).rdd.getNumPartitions() == -(-graphs.note_rows(t) // 100)


def test_class_checks_in_more_tasks_find_the_same(spark, monkeypatch):
    from weftline import session
    from weftline.plans import graphs
    from weftline.plans import shapes as plans
    from weftline.plans.tables import Tables

    monkeypatch.setattr(session, "TASK_ROWS", 2000)
    t = Tables(spark, "/root/testdata/sf0.001")
    few, many = (shapes.class_violations(plans.data_graph(t), plans.note_shapes(t, "class"), n).collect() for n in (0, graphs.note_rows(t)))
    assert sorted(few) == sorted(many) and few


def test_relaxation_writes_matches_once_a_search(spark, monkeypatch):
    """Requests that ask the same share their matches, and components are raised only to those asked for."""
    kept = []
    monkeypatch.setattr(search, "written", lambda df, label: kept.append((label, df.localCheckpoint())) or kept[-1][1])
    notes = spark.range(40).selectExpr("id AS note", "lpad(id, 3, '0') AS note_number", "'t' AS title", "5 AS min_sp", "9 AS max_sp")
    components = spark.range(40).selectExpr("id AS note", "'S' || id % 2 AS component_code")
    parents = spark.createDataFrame([("S0", "N"), ("S1", "N"), ("N", "R"), ("S9", "N")], "component_code string, parent_code string")
    asked = spark.range(300).selectExpr("id AS request_id", "if(id < 200, 'S0', 'S9') AS component_code", "if(id % 2 = 0, 7, 3) AS support_package")
    result = search.relax_search(asked, search.NoteGraph(notes=notes, components=components, parents=parents))
    assert [df.count() for label, df in kept if label == "found"] == [40, 25]
    assert sorted(r["ancestor"] for label, df in kept if label == "ancestors" for r in df.select("ancestor").distinct().collect()) == ["N", "S0", "S9"]
    assert result.attempts.groupBy("step").count().orderBy("step").collect() == [(0, 300), (1, 200), (2, 100)]
    assert (result.strict.count(), result.relaxed.count()) == (100 * 20, 100 * 20 + 100 * 25)


def test_rings_are_followed_one_way(spark, monkeypatch):
    sizes, follow = [], reach.follow
    monkeypatch.setattr(reach, "follow", lambda pointers: sizes.append(pointers.count()) or follow(pointers))
    ring = spark.range(50).selectExpr("id AS src", "(id + 1) % 50 AS dst")
    assert reach.strong_components(ring).groupBy("component").count().collect() == [(49, 50)]
    assert sum(sizes) == 50


def test_truncation_reads_its_lines_once(spark):
    """Edges are written before they are read as edges and for the seeds."""
    from weftline.plans import registry

    made = registry.queries()["j02_truncation"](spark, "/root/testdata/sf0.001")
    assert "parquet" not in made._jdf.queryExecution().optimizedPlan().toString().lower()


def test_tasks_of_a_crosswalk_follow_its_matches(spark, rows, monkeypatch):
    """Matched classes are dealt once, and move no more on the way to their labels."""
    from weftline import session

    monkeypatch.setattr(session, "TASK_ROWS", 10)
    data = spark.createDataFrame(
        [iri(f"c{i}", "match", f"k{i % 7}") for i in range(100)] + [iri(f"k{i}", "broader", "top") for i in range(6)] + [text("top", "alt", "T"), text("k1", "alt", "K")], TRIPLE
    )
    few, many = (shapes.crosswalk(data, "match", "broader", "alt", n) for n in (0, 100))
    assert rows(few) == rows(many) and len(rows(many)) == 100 + sum(i % 7 < 6 for i in range(100))
    assert many.rdd.getNumPartitions() == 10


def test_only_requests_that_share_an_identifier_move_to_each_other(spark, rows, monkeypatch):
    """Counts of shared identifiers, null ones too, are summed; of 1,000 other requests none goes through a window."""
    kept = {}
    monkeypatch.setattr(search, "written", lambda df, label: kept.setdefault((label, len(kept)), df.localCheckpoint()))
    notes = spark.range(3).selectExpr("id AS note", "string(id) AS note_number", "'t' AS title")
    components = spark.createDataFrame([(0, "A"), (1, "A"), (2, "B")], "note bigint, component_code string")
    made = [(n, "B") for n in range(10, 1010)] + [(1, "A"), (1, "B"), (2, "C"), (None, "A"), (None, "C")]
    asked = spark.createDataFrame(made, "request_id int, component_code string")
    result = search.relax_search(asked, search.NoteGraph(notes=notes, components=components), budget=0)
    found = result.attempts.where("request_id < 10 OR request_id IS NULL")
    assert rows(found, "request_id", "bindings") == [(1, 3), (1, 3), (2, 0), (None, 2), (None, 2)]
    repeated, counted = (next(df for (name, _), df in kept.items() if name == label) for label in ("repeated", "counted"))
    assert (repeated.count(), counted.where("_again").count(), counted.count()) == (2, 4, 1005)


def test_lines_move_once_to_their_order(spark, tmp_path):
    """The last line's supplier is found where the order's lines meet, without a second pass over the lines."""
    from weftline.plans.search import order_requests
    from weftline.plans.tables import Tables

    plan = order_requests(Tables(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") == 1 and plan.count("hashpartitioning(l_orderkey") == 1
