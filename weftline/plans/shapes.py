"""Entailment and shape validation over the note graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators import shapes
from weftline.plans.graphs import (
    AFFECTS,
    CODE,
    COMPONENT,
    MIN_SP,
    NOTE,
    NS,
    NUMBER,
    PARENT,
    PRIORITY,
    SQL_AFFECTS_T,
    SQL_COMP_T,
    SQL_PART_T,
    TITLE,
    component_triples,
    note_graph,
    note_rows,
)
from weftline.plans.registry import register
from weftline.plans.tables import Tables, with_tables
from weftline.session import literal_rows
from weftline.sources.triples import LANG_STRING, RDF_TYPE, RDFS, RDFS_LABEL, SKOS, XSD, XSD_STRING

_AXIOMS = [
    (NOTE, "subClassOf", NS + "Document"), (NS + "Document", "subClassOf", NS + "Thing"),
    (AFFECTS, "subPropertyOf", NS + "relatesTo"), (NS + "relatesTo", "domain", NS + "Linked"),
    (AFFECTS, "range", COMPONENT), (PARENT, "domain", NS + "Part"),
]


def ontology(t: Tables) -> DataFrame:
    rows = [("ontology", s, RDFS + p, o, "iri", None, None) for s, p, o in _AXIOMS]
    return literal_rows(t.spark, rows, "graph string, s string, p string, o string, o_kind string, datatype string, lang string")


def data_graph(t: Tables) -> DataFrame:
    """The note graph, in which suppliers in debt are not declared components."""
    poor = t.supplier.where("s_acctbal < 3000").select(
        F.concat(F.lit(NS + "supplier/"), F.col("s_suppkey").cast("string")).alias("s"), F.lit(RDF_TYPE).alias("p")
    )
    return note_graph(t).join(poor, ["s", "p"], "left_anti")


_BRANDS = [(f"Brand#{n}", XSD_STRING) for n in range(1, 21)]
_NOTE_SHAPE = [
    ("NoteShape", NOTE, RDFS_LABEL, "minCount", 1, "a note has a label"),
    ("NoteShape", NOTE, RDFS_LABEL, "datatype", LANG_STRING, "a label is tagged text"),
    ("NoteShape", NOTE, RDFS_LABEL, "languageIn", ["en"], "a label is English"),
    ("NoteShape", NOTE, NUMBER, "minCount", 1, "a note has a number"),
    ("NoteShape", NOTE, NUMBER, "maxCount", 1, "a note has one number"),
    ("NoteShape", NOTE, NUMBER, "datatype", XSD + "integer", "a number is an integer"),
    ("NoteShape", NOTE, TITLE, "languageIn", ["de", "fr"], "a title is German or French"),
    ("NoteShape", NOTE, PRIORITY, "in", _BRANDS, "a priority is listed"),
    ("NoteShape", NOTE, AFFECTS, "class", COMPONENT, "a note affects a component"),
    ("NoteShape", NOTE, AFFECTS, "maxCount", 30, "a note affects few components"),
    ("NoteShape", NOTE, MIN_SP, "minInclusive", 3, "a package is at least 3"),
]


def note_shapes(t: Tables, *kinds: str) -> DataFrame:
    return shapes.shape_table(t.spark, [row for row in _NOTE_SHAPE if not kinds or row[3] in kinds])


_N = "'urn:wl:part/' || p_partkey"
_LABEL = "'http://www.w3.org/2000/01/rdf-schema#label'"
_SQL_KIND = {
    "minCount": f"SELECT {_N} AS focus, {_LABEL} AS path, 'minCount' AS \"constraint\", '-' AS value FROM part WHERE p_size <= 25",
    "maxCount": f"""SELECT 'urn:wl:part/' || l_partkey AS focus, 'urn:wl:affects' AS path, 'maxCount' AS "constraint", '-' AS value
  FROM lineitem GROUP BY l_partkey HAVING COUNT(DISTINCT l_suppkey) > 30""",
    "datatype": f"SELECT {_N} AS focus, 'urn:wl:noteNumber' AS path, 'datatype' AS \"constraint\", CAST(p_partkey AS VARCHAR) AS value FROM part",
    "languageIn": f"SELECT {_N} AS focus, 'urn:wl:title' AS path, 'languageIn' AS \"constraint\", p_name AS value FROM part",
    "in": f"""SELECT {_N} AS focus, 'urn:wl:priority' AS path, 'in' AS "constraint", p_brand AS value FROM part
  WHERE p_brand NOT IN ({', '.join(repr(b) for b, _ in _BRANDS)})""",
    "class": """SELECT DISTINCT 'urn:wl:part/' || l_partkey AS focus, 'urn:wl:affects' AS path, 'class' AS "constraint", 'urn:wl:supplier/' || l_suppkey AS value
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_acctbal < 3000""",
    "minInclusive": f"""SELECT {_N} AS focus, 'urn:wl:minPackage' AS path, 'minInclusive' AS "constraint", CAST(p_size % 10 AS VARCHAR) AS value
  FROM part WHERE p_size % 10 < 3""",
}


def _shown(violations: DataFrame) -> DataFrame:
    return violations.select("focus", "path", "constraint", F.coalesce("value", F.lit("-")).alias("value"))


def _register_kind(key: str, kind: str, check) -> None:
    @register(key, _SQL_KIND[kind])
    def _(t: Tables) -> DataFrame:
        sized = {"rows": note_rows(t)} if kind == "class" else {}
        return _shown(check(data_graph(t), note_shapes(t, kind), **sized))


_register_kind("j10_min_count", "minCount", shapes.count_violations)
_register_kind("j11_max_count", "maxCount", shapes.count_violations)
_register_kind("j12_datatype", "datatype", shapes.value_violations)
_register_kind("j13_language", "languageIn", shapes.value_violations)
_register_kind("j14_in", "in", shapes.value_violations)
_register_kind("j15_class", "class", shapes.class_violations)
_register_kind("j16_min_inclusive", "minInclusive", shapes.value_violations)

_SQL_ALL = " UNION ALL ".join(_SQL_KIND.values())


@register("j09_validate", _SQL_ALL)
def j09(t: Tables) -> DataFrame:
    """Without the ontology: only stated types count."""
    return _shown(shapes.validate(data_graph(t), note_shapes(t), entail=False, rows=note_rows(t)))


@register("j09_validate_with_ontology", " UNION ALL ".join(sql for kind, sql in _SQL_KIND.items() if kind != "class"))
def j09_ontology(t: Tables) -> DataFrame:
    """The range axiom makes every affected node a component."""
    return _shown(shapes.validate(data_graph(t), note_shapes(t), ontology(t), rows=note_rows(t)))


@register(
    "j08_rdfs_entailment",
    with_tables(SQL_PART_T, SQL_COMP_T, SQL_AFFECTS_T) + """, base AS (SELECT * FROM part_t UNION SELECT * FROM comp_t UNION SELECT * FROM aff_t),
 ty AS (SELECT DISTINCT s, c FROM (
   SELECT s, unnest(['urn:wl:Document', 'urn:wl:Thing']) AS c FROM base WHERE o = 'urn:wl:Note' AND o_kind = 'iri'
   UNION ALL SELECT note, 'urn:wl:Linked' FROM aff UNION ALL SELECT comp, 'urn:wl:Component' FROM aff
   UNION ALL SELECT s, 'urn:wl:Part' FROM comp WHERE parent IS NOT NULL))
SELECT * FROM base UNION SELECT note, 'urn:wl:relatesTo', comp, 'iri', '-', '-' FROM aff
UNION SELECT s, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', c, 'iri', '-', '-' FROM ty""",
)
def j08(t: Tables) -> DataFrame:
    entailed = shapes.rdfs_entail(note_graph(t), ontology(t), is_set=True)
    return entailed.select("s", "p", "o", "o_kind", *[F.coalesce(c, F.lit("-")).alias(c) for c in ("datatype", "lang")])


@register(
    "j17_validation_matrix",
    f"""WITH v AS ({_SQL_ALL}), c AS (
  SELECT 'NUMBER_COUNT' AS check_id, true AS expected, 0 AS n
  UNION ALL SELECT 'ALL_SHAPES', false, (SELECT COUNT(*) FROM v)
  UNION ALL SELECT 'COMPONENT_CLASS', true, (SELECT COUNT(*) FROM v WHERE "constraint" = 'class'))
SELECT check_id, expected AS expected_conforms, n = 0 AS observed_conforms, CAST(n AS BIGINT) AS violations,
  CASE WHEN expected <> (n = 0) THEN 'FAIL' WHEN expected THEN 'PASS' ELSE 'EXPECTED_NONCONFORMANT' END AS result FROM c""",
)
def j17(t: Tables) -> DataFrame:
    """Three checks as shapes of one validation."""
    checks = {
        "NUMBER_COUNT": [row for row in _NOTE_SHAPE if row[2] == NUMBER and row[3] != "datatype"],
        "ALL_SHAPES": _NOTE_SHAPE,
        "COMPONENT_CLASS": [row for row in _NOTE_SHAPE if row[3] == "class"],
    }
    table = shapes.shape_table(t.spark, [(name, *row[1:]) for name, rows in checks.items() for row in rows])
    expected = [("NUMBER_COUNT", True), ("ALL_SHAPES", False), ("COMPONENT_CLASS", True)]
    violations = shapes.validate(data_graph(t), table, entail=False, rows=note_rows(t))
    return shapes.conformance_by_shape(violations, literal_rows(t.spark, expected, "shape string, expected_conforms boolean"))


@register(
    "j18_crosswalk",
    """WITH m AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem),
 c AS (SELECT l_partkey, s_name AS code, 'urn:wl:supplier/' || s_suppkey AS concept, 'match' AS relation FROM m JOIN supplier ON s_suppkey = l_suppkey
   UNION SELECT l_partkey, n_name, 'urn:wl:nation/' || n_nationkey, 'broader' FROM m JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey
   UNION SELECT l_partkey, '-', 'urn:wl:region/' || n_regionkey, 'broader' FROM m JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey)
SELECT 'urn:wl:part/' || l_partkey AS class_iri, concept, relation, code AS label FROM c""",
)
def j18(t: Tables) -> DataFrame:
    """Parts matched to suppliers, below nations and regions; regions have no other label."""
    region_code = F.startswith("s", F.lit(NS + "region/")) & (F.col("p") == CODE)
    taxonomy = note_graph(t).where(~region_code)
    names = {AFFECTS: SKOS + "exactMatch", PARENT: SKOS + "broader", CODE: SKOS + "altLabel"}
    renamed = F.col("p")
    for old, new in names.items():
        renamed = F.when(F.col("p") == old, new).otherwise(renamed)
    found = shapes.crosswalk(taxonomy.withColumn("p", renamed), SKOS + "exactMatch", SKOS + "broader", SKOS + "altLabel", t.rows("lineitem"))
    return found.withColumn("label", F.coalesce("label", F.lit("-")))


@register(
    "j19_dataset_label",
    "SELECT string_agg(DISTINCT source, '+' ORDER BY source) AS dataset_id FROM documents",
)
def j19(t: Tables) -> DataFrame:
    none = F.lit(None).cast("string")
    named = t.documents.select(
        F.lit("data").alias("graph"), F.col("doc_id").cast("string").alias("s"), F.lit(NS + "datasetId").alias("p"),
        F.col("source").alias("o"), F.lit("literal").alias("o_kind"), F.lit(XSD_STRING).alias("datatype"), none.alias("lang"),
    )
    return shapes.dataset_label(named, NS + "datasetId")
