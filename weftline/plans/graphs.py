"""Triples built from parts, suppliers, nations and regions; patterns, paths and closures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators import closure as reach
from weftline.operators import blank_nodes, evaluate, filters, graph, search
from weftline.plans.conforming import SQL_TREE
from weftline.plans.registry import register
from weftline.plans.tables import SQL_EDGES, Tables, with_tables
from weftline.session import cut_lineage, scratch_path, spread
from weftline.sources import digests, triples
from weftline.sources.triples import RDFS_LABEL, XSD, XSD_STRING

NS = "urn:wl:"
NOTE, COMPONENT = NS + "Note", NS + "Component"
NUMBER, TITLE, PRIORITY, AFFECTS = NS + "noteNumber", NS + "title", NS + "priority", NS + "affects"
CODE, PARENT, MIN_SP = NS + "componentCode", NS + "parent", NS + "minPackage"
# The most triples of one part.
PART_TRIPLES = 6
_COLUMNS = ("s", "p", "o", "o_kind", "datatype", "lang")


def _iri(kind: str, key: str):
    return F.concat(F.lit(f"{NS}{kind}/"), F.col(key).cast("string"))


def part_triples(t: Tables) -> DataFrame:
    """Parts as notes. Half of them have no label; brands stand for priorities."""
    part = spread(t.part, PART_TRIPLES * t.rows("part"), "p_partkey")
    rows = part.select(
        _iri("part", "p_partkey").alias("node"),
        F.col("p_partkey").alias("number"), F.col("p_name").alias("title"), F.col("p_brand").alias("priority"),
        (F.col("p_size") % 10).alias("min_sp"),
        F.when(F.col("p_size") > 25, F.col("p_type")).alias("label"),
    )
    return triples.to_triples(
        rows, F.col("node"), NOTE,
        {
            "number": (NUMBER, XSD_STRING), "title": (TITLE, "@en"), "priority": (PRIORITY, XSD_STRING),
            "min_sp": (MIN_SP, XSD + "integer"), "label": (RDFS_LABEL, "@en"),
        },
    )


def component_triples(t: Tables) -> DataFrame:
    """Suppliers, nations and regions as components, each under the next."""
    suppliers = t.supplier.select(_iri("supplier", "s_suppkey").alias("node"), F.col("s_name").alias("code"), _iri("nation", "s_nationkey").alias("parent"))
    nations = t.nation.select(_iri("nation", "n_nationkey").alias("node"), F.col("n_name").alias("code"), _iri("region", "n_regionkey").alias("parent"))
    regions = t.region.select(_iri("region", "r_regionkey").alias("node"), F.col("r_name").alias("code"), F.lit(None).cast("string").alias("parent"))
    rows = suppliers.union(nations).union(regions)
    return triples.to_triples(rows, F.col("node"), COMPONENT, {"code": (CODE, XSD_STRING), "parent": (PARENT, "iri")})


def affects_triples(t: Tables) -> DataFrame:
    none = F.lit(None).cast("string")
    return t.note_components().select(
        F.lit("data").alias("graph"), _iri("part", "note").alias("s"), F.lit(AFFECTS).alias("p"),
        _iri("supplier", "component").alias("o"), F.lit("iri").alias("o_kind"), none.alias("datatype"), none.alias("lang"),
    )


def note_graph(t: Tables) -> DataFrame:
    """The triples of parts, components and what parts affect, as a set.

    Affected pairs are made distinct as numbers and have a predicate of their own, so they are a set before they are triples.
    """
    described = triples.merge_graphs([part_triples(t), component_triples(t)], "data", described_rows(t))
    return described.unionByName(affects_triples(t))


def described_rows(t: Tables) -> int:
    """The most triples of parts and components; nations and regions are few."""
    return PART_TRIPLES * t.rows("part") + 3 * t.rows("supplier")


def note_rows(t: Tables) -> int:
    """The most triples the note graph may have."""
    return described_rows(t) + t.rows("lineitem")


def _plain(df: DataFrame) -> DataFrame:
    """Triples without nulls, for comparison."""
    return df.select("s", "p", "o", "o_kind", *[F.coalesce(c, F.lit("-")).alias(c) for c in ("datatype", "lang")])


_T = "'http://www.w3.org/1999/02/22-rdf-syntax-ns#type'"
_L = "'http://www.w3.org/2000/01/rdf-schema#label'"
_XS = "'http://www.w3.org/2001/XMLSchema#string'"
_LS = "'http://www.w3.org/1999/02/22-rdf-syntax-ns#langString'"
SQL_PART_T = f"""part_t AS (
  SELECT 'urn:wl:part/' || p_partkey AS s, {_T} AS p, 'urn:wl:Note' AS o, 'iri' AS o_kind, '-' AS datatype, '-' AS lang FROM part
  UNION ALL SELECT 'urn:wl:part/' || p_partkey, 'urn:wl:noteNumber', CAST(p_partkey AS VARCHAR), 'literal', {_XS}, '-' FROM part
  UNION ALL SELECT 'urn:wl:part/' || p_partkey, 'urn:wl:title', p_name, 'literal', {_LS}, 'en' FROM part
  UNION ALL SELECT 'urn:wl:part/' || p_partkey, 'urn:wl:priority', p_brand, 'literal', {_XS}, '-' FROM part
  UNION ALL SELECT 'urn:wl:part/' || p_partkey, 'urn:wl:minPackage', CAST(p_size % 10 AS VARCHAR), 'literal', 'http://www.w3.org/2001/XMLSchema#integer', '-' FROM part
  UNION ALL SELECT 'urn:wl:part/' || p_partkey, {_L}, p_type, 'literal', {_LS}, 'en' FROM part WHERE p_size > 25)"""
SQL_COMP_T = f"""comp AS (SELECT 'urn:wl:supplier/' || s_suppkey AS s, s_name AS code, 'urn:wl:nation/' || s_nationkey AS parent FROM supplier
  UNION ALL SELECT 'urn:wl:nation/' || n_nationkey, n_name, 'urn:wl:region/' || n_regionkey FROM nation
  UNION ALL SELECT 'urn:wl:region/' || r_regionkey, r_name, NULL FROM region),
 comp_t AS (SELECT s, {_T} AS p, 'urn:wl:Component' AS o, 'iri' AS o_kind, '-' AS datatype, '-' AS lang FROM comp
  UNION ALL SELECT s, 'urn:wl:componentCode', code, 'literal', {_XS}, '-' FROM comp
  UNION ALL SELECT s, 'urn:wl:parent', parent, 'iri', '-', '-' FROM comp WHERE parent IS NOT NULL)"""
SQL_AFFECTS_T = """aff AS (SELECT DISTINCT 'urn:wl:part/' || l_partkey AS note, 'urn:wl:supplier/' || l_suppkey AS comp FROM lineitem),
 aff_t AS (SELECT note AS s, 'urn:wl:affects' AS p, comp AS o, 'iri' AS o_kind, '-' AS datatype, '-' AS lang FROM aff)"""
SQL_GRAPH = with_tables(SQL_PART_T, SQL_COMP_T, SQL_AFFECTS_T)
_SQL_LINE = """'<' || s || '> <' || p || '> ' || CASE WHEN o_kind = 'iri' THEN '<' || o || '>' WHEN lang <> '-' THEN '"' || o || '"@' || lang
  WHEN datatype LIKE '%#string' THEN '"' || o || '"' ELSE '"' || o || '"^^<' || datatype || '>' END || ' .'"""


@register("a03_read_ntriples", with_tables(SQL_PART_T) + "SELECT DISTINCT * FROM part_t")
def a03(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "triples")
    triples.write_ntriples(part_triples(t), path, PART_TRIPLES * t.rows("part"))
    return _plain(triples.read_ntriples(t.spark, path, "data"))



@register(
    "a03_literal_round_trip",
    "SELECT 'urn:wl:document/' || doc_id AS s, sha256(text) AS digest, strlen(text)::BIGINT AS bytes FROM documents",
)
def a03_round_trip(t: Tables) -> DataFrame:
    """Whole document texts as literals, escaped to lines and read back."""
    path = scratch_path(t.spark, "literals")
    rows = t.documents.select(_iri("document", "doc_id").alias("node"), "text")
    written = triples.to_triples(rows, F.col("node"), NS + "Document", {"text": (NS + "text", XSD_STRING)})
    triples.write_ntriples(written, path)
    read = triples.read_ntriples(t.spark, path, "data").where(F.col("p") == NS + "text")
    return read.select("s", F.sha2("o", 256).alias("digest"), F.octet_length("o").cast("bigint").alias("bytes"))


@register("a04_table_to_triples", with_tables(SQL_PART_T) + "SELECT * FROM part_t")
def a04(t: Tables) -> DataFrame:
    return _plain(part_triples(t))


@register(
    "a05_label_completion",
    with_tables(SQL_PART_T) + f"""SELECT * FROM part_t UNION ALL
SELECT 'urn:wl:part/' || p_partkey, {_L}, p_name, 'literal', {_LS}, 'en' FROM part WHERE p_size <= 25""",
)
def a05(t: Tables) -> DataFrame:
    return _plain(triples.complete_labels(part_triples(t), {NOTE: TITLE}))


@register(
    "a06_scope",
    SQL_GRAPH + """SELECT * FROM (SELECT * FROM part_t UNION ALL SELECT * FROM comp_t UNION ALL SELECT * FROM aff_t)
WHERE starts_with(s, 'urn:wl:part/') AND (starts_with(p, 'urn:wl:no') OR starts_with(p, 'urn:wl:a') OR starts_with(p, 'http://www.w3.org/'))
  AND (o_kind = 'literal' OR starts_with(o, 'urn:wl:N') OR starts_with(o, 'urn:wl:supplier/1'))""",
)
def a06(t: Tables) -> DataFrame:
    scoped = triples.scope(note_graph(t), [NS + "part/", NS + "no", NS + "a", NS + "N", NS + "supplier/1"])
    return _plain(scoped)


@register(
    "a07_graph_merge",
    SQL_GRAPH + "SELECT * FROM part_t UNION SELECT * FROM comp_t UNION SELECT * FROM aff_t",
)
def a07(t: Tables) -> DataFrame:
    return _plain(triples.merge_graphs([note_graph(t), part_triples(t), component_triples(t)], "data", 2 * note_rows(t)))


@register(
    "a08_typed_bindings",
    "SELECT 'urn:wl:part/' || p_partkey AS note, CAST(p_partkey AS BIGINT) AS number, CAST(p_size % 10 AS INTEGER) AS package FROM part",
)
def a08(t: Tables) -> DataFrame:
    found = graph.bgp(part_triples(t), [("?note", NUMBER, "?number"), ("?note", MIN_SP, "?package")])
    return triples.typed_bindings(found, {"number": "bigint", "package": "int"})


@register("a12_write_ntriples", with_tables(SQL_PART_T) + f"SELECT DISTINCT {_SQL_LINE} AS value FROM part_t ORDER BY value")
def a12(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "lines")
    triples.write_ntriples(part_triples(t), path, PART_TRIPLES * t.rows("part"))
    return t.spark.read.text(path)


@register(
    "c02_basic_graph_pattern",
    """SELECT DISTINCT 'urn:wl:part/' || p_partkey AS note, CAST(p_partkey AS VARCHAR) AS number, s_name AS code
FROM part JOIN lineitem ON l_partkey = p_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE p_brand = 'Brand#7'""",
)
def c02(t: Tables) -> DataFrame:
    found = graph.bgp(
        note_graph(t),
        [
            ("?note", triples.RDF_TYPE, NOTE), ("?note", NUMBER, "?number"), ("?note", AFFECTS, "?comp"),
            ("?comp", CODE, "?code"), ("?note", PRIORITY, graph.Literal("Brand#7")), ("?note", NUMBER, "?number"),
        ],
    )
    return found.select("note", "number", "code")


@register(
    "c03_optional_pattern",
    "SELECT 'urn:wl:part/' || p_partkey AS note, p_name AS title, CASE WHEN p_size > 25 THEN p_type ELSE '-' END AS label FROM part",
)
def c03(t: Tables) -> DataFrame:
    base = graph.bgp(part_triples(t), [("?note", TITLE, "?title")])
    found = graph.optional(base, part_triples(t), [("?note", RDFS_LABEL, "?label")])
    return found.withColumn("label", F.coalesce("label", F.lit("-")))


@register(
    "c04_sequence_path",
    """SELECT DISTINCT 'urn:wl:part/' || l_partkey AS src, 'urn:wl:nation/' || s_nationkey AS dst
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey""",
)
def c04(t: Tables) -> DataFrame:
    graph_of = note_graph(t)
    return graph.sequence_path(graph.edges(graph_of, AFFECTS), graph.edges(graph_of, PARENT))


@register(
    "c05_alternative_path",
    with_tables(SQL_COMP_T, SQL_AFFECTS_T) + "SELECT note AS src, comp AS dst FROM aff UNION SELECT s, parent FROM comp WHERE parent IS NOT NULL",
)
def c05(t: Tables) -> DataFrame:
    graph_of = note_graph(t)
    return graph.alternative_path(graph.edges(graph_of, AFFECTS), graph.edges(graph_of, PARENT))


@register(
    "c06_zero_or_more_path",
    with_tables(SQL_COMP_T) + """SELECT a.s AS src, b.s AS dst FROM comp a JOIN comp b ON b.s = a.s OR b.s = a.parent
   OR b.s = (SELECT c.parent FROM comp c WHERE c.s = a.parent)""",
)
def c06(t: Tables) -> DataFrame:
    return graph.zero_or_more_path(graph.edges(component_triples(t), PARENT))


@register(
    "c08_existence",
    "SELECT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_discount > 0.05)",
)
def c08(t: Tables) -> DataFrame:
    matches = t.lineitem.where("l_returnflag = 'R' AND l_discount > 0.05").select(F.col("l_partkey").alias("p_partkey"))
    return graph.exists_per_request(t.part.select("p_partkey"), matches, ["p_partkey"])


@register(
    "c09_not_found",
    "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_discount > 0.05)",
)
def c09(t: Tables) -> DataFrame:
    matches = t.lineitem.where("l_returnflag = 'R' AND l_discount > 0.05").select(F.col("l_partkey").alias("p_partkey"))
    return graph.missing_per_request(t.part.select("p_partkey"), matches, ["p_partkey"])


@register(
    "c02_node_table",
    "SELECT 'urn:wl:part/' || p_partkey AS node, p_name AS title, CASE WHEN p_size > 25 THEN p_type ELSE '-' END AS label FROM part",
)
def c02_nodes(t: Tables) -> DataFrame:
    rows = graph.node_table(note_graph(t), NOTE, {"title": TITLE, "label": RDFS_LABEL})
    return rows.withColumn("label", F.coalesce("label", F.lit("-")))


_SQL_REACH = with_tables(SQL_EDGES).replace("WITH ", "WITH RECURSIVE ", 1) + """, r AS (
  SELECT src AS seed, dst AS node, 1 AS distance FROM edges
  UNION ALL SELECT r.seed, e.dst, r.distance + 1 FROM r JOIN edges e ON r.node = e.src)
"""


@register("j01_bounded_closure", _SQL_REACH + "SELECT seed, node, distance FROM r WHERE distance <= 4")
def j01(t: Tables) -> DataFrame:
    return reach.all_pairs(t.prerequisite_edges(), max_depth=4).pairs


@register("j01_full_closure", _SQL_REACH + "SELECT seed, node, distance FROM r")
def j01_full(t: Tables) -> DataFrame:
    return reach.all_pairs(t.prerequisite_edges()).pairs


@register(
    "j02_truncation",
    _SQL_REACH + """SELECT seed, max(distance) > 3 AS truncated, CASE WHEN max(distance) > 3 THEN 'EMPTY_RESULT' ELSE 'SUCCESS' END AS status,
  CASE WHEN max(distance) > 3 THEN 'PREREQUISITE_DEPTH_EXCEEDED' ELSE '-' END AS reason FROM r GROUP BY seed""",
)
def j02(t: Tables) -> DataFrame:
    # Read as edges and, twice, for the seeds.
    links = cut_lineage(t.prerequisite_edges())
    seeds = links.select(F.col("src").alias("seed")).distinct()
    status = reach.traversal_status(seeds, reach.closure(links, seeds, 3))
    return status.withColumn("reason", F.coalesce("reason", F.lit("-")))


def part_chain(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Chains of up to twenty parts, and the first and sixth part of each as seeds."""
    near = t.part.select(F.col("p_partkey").alias("src"), (F.col("p_partkey") + 1).alias("dst"))
    known = t.part.select(F.col("p_partkey").alias("dst"))
    links = near.where("dst % 20 <> 0").join(known, "dst", "left_semi").select("src", "dst")
    return links, t.part.where("p_partkey % 20 IN (0, 5)").select(F.col("p_partkey").alias("seed"))


_SQL_CHAIN = """WITH RECURSIVE edges AS (SELECT a.p_partkey AS src, b.p_partkey AS dst FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1
   WHERE b.p_partkey % 20 <> 0),
 r AS (SELECT p_partkey AS seed, dst AS node, 1 AS distance FROM part JOIN edges ON src = p_partkey WHERE p_partkey % 20 IN (0, 5)
   UNION ALL SELECT r.seed, e.dst, r.distance + 1 FROM r JOIN edges e ON r.node = e.src)
"""


@register("j01_chain_closure", _SQL_CHAIN + "SELECT seed, node, distance FROM r WHERE distance <= 16")
def j01_chain(t: Tables) -> DataFrame:
    """Chains of up to nineteen hops, followed for sixteen."""
    links, seeds = part_chain(t)
    return reach.closure(links, seeds).pairs


@register(
    "j02_chain_truncation",
    _SQL_CHAIN + """SELECT p_partkey AS seed, coalesce(max(distance) > 16, false) AS truncated,
  CASE WHEN max(distance) > 16 THEN 'EMPTY_RESULT' ELSE 'SUCCESS' END AS status FROM part LEFT JOIN r ON r.seed = p_partkey
WHERE p_partkey % 20 IN (0, 5) GROUP BY 1""",
)
def j02_chain(t: Tables) -> DataFrame:
    links, seeds = part_chain(t)
    return reach.traversal_status(seeds, reach.closure(links, seeds)).drop("reason")


def ring_edges(t: Tables) -> DataFrame:
    """Lines to the next line number of their order, or back to the order's first line."""
    lines = t.lineitem.select("l_orderkey", "l_linenumber").distinct()
    following = lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.lit(1).alias("step"))
    first = lines.groupBy("l_orderkey").agg(F.min("l_linenumber").alias("first"))
    key = F.col("l_orderkey") * 10
    linked = lines.join(following, ["l_orderkey", "l_linenumber"], "left").join(first, "l_orderkey")
    target = F.when(F.col("step") == 1, F.col("l_linenumber") + 1).otherwise(F.col("first"))
    return linked.select((key + F.col("l_linenumber")).alias("src"), (key + target).alias("dst"))


_SQL_RING = """WITH RECURSIVE lines AS (SELECT DISTINCT l_orderkey AS o, l_linenumber AS n FROM lineitem),
 f AS (SELECT o, min(n) AS first FROM lines GROUP BY o),
 edges AS (SELECT a.o * 10 + a.n AS src, a.o * 10 + coalesce(b.n, f.first) AS dst
   FROM lines a LEFT JOIN lines b ON a.o = b.o AND b.n = a.n + 1 JOIN f ON f.o = a.o),
 r AS (SELECT src AS seed, dst AS node FROM edges UNION SELECT r.seed, e.dst FROM r JOIN edges e ON r.node = e.src)
"""


@register(
    "j03_cycle_edges",
    _SQL_RING + """SELECT s.seed, e.src, e.dst FROM (SELECT seed, node FROM r UNION SELECT src, src FROM edges) s
JOIN edges e ON e.src = s.node WHERE EXISTS (SELECT 1 FROM r b WHERE b.seed = e.dst AND b.node = e.src) OR e.src = e.dst""",
)
def j03(t: Tables) -> DataFrame:
    ring = cut_lineage(ring_edges(t))
    return reach.cycle_edges(ring, ring.select(F.col("src").alias("seed")).distinct())


@register(
    "j04_prerequisite_search",
    _SQL_REACH + """SELECT seed, node AS note, lpad(CAST(node AS VARCHAR), 9, '0') AS note_number, title, distance FROM (
  SELECT r.seed, r.node, t.title, r.distance, row_number() OVER (PARTITION BY seed ORDER BY node) AS rn FROM r
  JOIN (SELECT l_orderkey * 10 + l_linenumber AS node, min(p_name) AS title FROM lineitem JOIN part ON l_partkey = p_partkey
    WHERE p_size > 10 GROUP BY 1) t USING (node) WHERE r.distance <= 16) WHERE rn <= 2""",
)
def j04(t: Tables) -> DataFrame:
    """Lines as notes, titled by a part; lines whose parts are all small have no title."""
    links = t.prerequisite_edges()
    key = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("note")
    parts = t.part.where("p_size > 10").select("p_partkey", "p_name")
    titles = t.lineitem.select(key, "l_partkey").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    notes = titles.groupBy("note").agg(F.min("p_name").alias("title")).withColumn("note_number", F.lpad(F.col("note").cast("string"), 9, "0"))
    found, _ = search.prerequisite_search(links.select(F.col("src").alias("seed")), links, notes, top=2)
    return found.drop("rank")


@register("b11_exclude_target", "SELECT DISTINCT l_partkey AS node, l_suppkey AS target FROM lineitem WHERE l_partkey <> l_suppkey")
def b11(t: Tables) -> DataFrame:
    pairs = t.note_components().select(F.col("note").alias("node"), F.col("component").alias("target"))
    return graph.exclude_target(pairs, "node", "target")


@register(
    "e02_top_notes",
    """SELECT DISTINCT p_partkey AS note, lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS note_number, p_name AS title
FROM part JOIN lineitem ON p_partkey = l_partkey WHERE p_type = 'PROMO' ORDER BY note_number DESC LIMIT 25""",
)
def e02(t: Tables) -> DataFrame:
    notes = t.part.where(filters.slot_values("p_type", ["PROMO"])).select(
        F.col("p_partkey").alias("note"), F.lpad(F.col("p_partkey").cast("string"), 7, "0").alias("note_number"), F.col("p_name").alias("title")
    )
    used = notes.join(t.lineitem.select(F.col("l_partkey").alias("note")), "note")
    return used.distinct().orderBy(F.col("note_number").desc()).limit(search.TOP_NOTES)


@register(
    "e02_top_notes_per_request",
    """SELECT request_id, note FROM (SELECT l_suppkey AS request_id, l_partkey AS note,
  row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey DESC) AS rn FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)) WHERE rn <= 25""",
)
def e02_batch(t: Tables) -> DataFrame:
    """Per supplier, its 25 highest-numbered parts; the cut starts before the shuffle."""
    from pyspark.sql.window import Window

    newest = Window.partitionBy("component").orderBy(F.col("note").desc())
    ranked = t.note_components().withColumn("rank", F.row_number().over(newest))
    return ranked.where(F.col("rank") <= search.TOP_NOTES).select(F.col("component").alias("request_id"), "note")


@register(
    "f02_graph_difference",
    with_tables(SQL_PART_T) + """, other AS (SELECT s, p, CASE WHEN p = 'urn:wl:title' AND o LIKE 'red%' THEN upper(o) ELSE o END AS o, o_kind, datatype, lang
  FROM part_t WHERE p <> 'urn:wl:minPackage' OR o <> '3')
SELECT 'left' AS side, * FROM (SELECT * FROM part_t EXCEPT SELECT * FROM other)
UNION ALL SELECT 'right', * FROM (SELECT * FROM other EXCEPT SELECT * FROM part_t)""",
)
def f02(t: Tables) -> DataFrame:
    left = part_triples(t)
    shouted = (F.col("p") == TITLE) & F.startswith("o", F.lit("red"))
    right = left.where(f"p <> '{MIN_SP}' OR o <> '3'").withColumn("o", F.when(shouted, F.upper("o")).otherwise(F.col("o")))
    found = evaluate.graph_difference(left, right)
    return found.select("side", "s", "p", "o", "o_kind", *[F.coalesce(c, F.lit("-")).alias(c) for c in ("datatype", "lang")])


_ADDRESS, _NATION, _CALLED = "urn:wl:address", "urn:wl:nation", "urn:wl:called"


def address_triples(t: Tables, label: Column, called: Column) -> DataFrame:
    """Each customer's address as a blank node with a nation and a name."""
    rows = t.customer.select("*", label.alias("label"), called.alias("called"))
    whose = F.concat(F.lit("urn:wl:customer/"), F.col("c_custkey").cast("string"))
    nation = F.concat(F.lit("urn:wl:nation/"), F.col("c_nationkey").cast("string"))

    def fact(s: Column, p: str, o: Column, kind: str) -> Column:
        return F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"))

    node = F.col("label")
    facts = F.array(fact(whose, _ADDRESS, node, "bnode"), fact(node, _NATION, nation, "iri"), fact(node, _CALLED, F.col("called"), "literal"))
    none = F.lit(None).cast("string")
    return rows.select(F.inline(facts)).withColumns({"datatype": none, "lang": none})


@register(
    "f02_blank_node_difference",
    f"""WITH sides AS (SELECT 'left' AS side, c_name AS called, * FROM customer WHERE c_mktsegment = 'BUILDING'
  UNION ALL SELECT 'right', c_name || '!', * FROM customer WHERE c_mktsegment = 'BUILDING')
SELECT side, 1::BIGINT AS copies, 'urn:wl:customer/' || c_custkey AS s, '{_ADDRESS}' AS p, '_' AS o FROM sides
UNION ALL SELECT side, 1, '_', '{_NATION}', 'urn:wl:nation/' || c_nationkey FROM sides
UNION ALL SELECT side, 1, '_', '{_CALLED}', called FROM sides""",
)
def f02_blank(t: Tables) -> DataFrame:
    """The same addresses under other labels; those of one market segment are called differently."""
    key, name = F.col("c_custkey").cast("long"), F.col("c_name")
    changed = F.when(F.col("c_mktsegment") == "BUILDING", F.concat(name, F.lit("!"))).otherwise(name)
    left = address_triples(t, F.concat(F.lit("_:a"), key.cast("string")), name)
    right = address_triples(t, F.concat(F.lit("_:b"), (1_000_000_007 - key * 7).cast("string")), changed)
    found = blank_nodes.graph_difference(left, right)
    shown = lambda c: F.when(F.startswith(c, F.lit("_:")), F.lit("_")).otherwise(F.col(c)).alias(c)
    return found.select("side", F.col("copies").cast("long").alias("copies"), shown("s"), "p", shown("o"))


@register("f03_blank_node_digest", "SELECT 'relabelled' AS copy, true AS same UNION ALL SELECT 'changed', false")
def f03_blank(t: Tables) -> DataFrame:
    """Whether a relabelled and a changed copy of all addresses have the digest of the first."""
    key, name = F.col("c_custkey").cast("string"), F.col("c_name")
    last = F.col("c_custkey") == t.customer.agg(F.max("c_custkey").alias("m")).first()["m"]
    copies = {
        "first": address_triples(t, F.concat(F.lit("_:a"), key), name),
        "relabelled": address_triples(t, F.concat(F.lit("_:b"), F.reverse(key), F.lit("x"), key), name),
        "changed": address_triples(t, F.concat(F.lit("_:a"), key), F.when(last, F.lit("other")).otherwise(name)),
    }
    made = {n: blank_nodes.graph_digest(g).select(F.lit(n).alias("copy"), "digest") for n, g in copies.items()}
    others = made["relabelled"].unionByName(made["changed"])
    same = others.join(made["first"].select("digest", F.lit(True).alias("same")), "digest", "left")
    return same.select("copy", F.coalesce("same", F.lit(False)).alias("same"))


@register(
    "f03_graph_digest",
    SQL_GRAPH + f", lines AS (SELECT DISTINCT {_SQL_LINE} AS line FROM (SELECT * FROM part_t UNION ALL SELECT * FROM comp_t UNION ALL SELECT * FROM aff_t))"
    + SQL_TREE,
)
def f03(t: Tables) -> DataFrame:
    return digests.tree_digest(note_graph(t).select(triples.ntriples_line().alias("line")), "line")
