"""Grounding and scanning of whole texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators import grounding, scans
from weftline.plans.conforming import _SQL_TERM
from weftline.plans.quality import SQL_NUMBER, line_number
from weftline.plans.registry import register
from weftline.plans.tables import Tables, with_tables
from weftline.session import literal_rows

_CONCEPTS = [
    ("t:Article", "Of The", ["de-la", "in  the"]),
    ("t:Negation", "nicht", ["onble###", "no"]),
    ("t:Entry", "entry", ["thing", "es"]),
    ("t:Place", "dans les", ["para", "tion of the"]),
]
_LOCAL = [("t:Article", "UND_DIE", 1), ("t:Entry", "le", 2), ("t:Unknown", "the", 3)]


def _terms(t: Tables) -> DataFrame:
    concepts = literal_rows(t.spark, _CONCEPTS, "id string, name string, synonyms array<string>")
    local = literal_rows(t.spark, _LOCAL, "canonical_value string, local_value string, ordinal bigint")
    return grounding.vocabulary(concepts, local)


_TERM_ROWS = [
    ("t:Article", "of the", 0), ("t:Article", "of thes", 1), ("t:Article", "de la", 2), ("t:Article", "de las", 3),
    ("t:Article", "in the", 4), ("t:Article", "in thes", 5), ("t:Article", "und die", 100),
    ("t:Negation", "nicht", 0), ("t:Negation", "nichts", 1), ("t:Negation", "onble###", 2), ("t:Negation", "onble###s", 3),
    ("t:Negation", "no", 4), ("t:Negation", "nos", 5),
    ("t:Entry", "entry", 0), ("t:Entry", "entries", 1), ("t:Entry", "thing", 2), ("t:Entry", "things", 3), ("t:Entry", "es", 4),
    ("t:Entry", "le", 100),
    ("t:Place", "dans les", 0), ("t:Place", "para", 2), ("t:Place", "paras", 3), ("t:Place", "tion of the", 4), ("t:Place", "tion of thes", 5),
]


def _sql_grounding(table: str, key: str) -> str:
    """One branch per term, so that its pattern is compiled once."""
    hits = " UNION ALL ".join(
        f"""SELECT {key}, '{concept}' AS concept_id, '{term}' AS term, {place} AS ord FROM norm
  WHERE contains(t, '{term}') AND regexp_matches(t, '(^|[^\\p{{L}}\\p{{N}}_]){term}([^\\p{{L}}\\p{{N}}_]|$)')"""
        for concept, term, place in _TERM_ROWS
    )
    return f"""WITH norm AS MATERIALIZED (SELECT {key}, {_SQL_TERM.format(c='text')} AS t FROM {table}), hits AS ({hits})
SELECT {key}, concept_id, arg_min(term, ord) AS term FROM hits GROUP BY ALL"""


@register("k01_term_grounding", _sql_grounding("documents", "doc_id"))
def k01(t: Tables) -> DataFrame:
    return grounding.ground_terms(t.documents, _terms(t))


@register(
    "k01_conversation_grounding",
    _sql_grounding("(SELECT conv_id || '/' || turn AS turn_id, text FROM conversations)", "turn_id"),
)
def k01_conversations(t: Tables) -> DataFrame:
    turns = t.conversations.select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("turn_id"), "text")
    return grounding.ground_terms(turns, _terms(t), key="turn_id")


_VERSIONS = [("S/4HANA 2021", "V2021"), ("S/4HANA 2023", "V2023"), ("S/4HANA 2025", "V2025"), ("NetWeaver 7.50", "NW750")]


def _lexicon(t: Tables) -> DataFrame:
    """Types are alerts, suppliers components and brands software, straight from the tables."""
    fixed = grounding.lexicon(t.spark, versions=_VERSIONS)

    def family(name: str, values: DataFrame) -> DataFrame:
        return values.toDF("surface").distinct().select(F.lit(name).alias("family"), "surface", F.col("surface").alias("canonical"))

    suppliers = t.supplier.select(F.concat(F.lit("S-"), F.col("s_suppkey").cast("string")))
    return (
        fixed.unionByName(family("alert_code", t.part.select(F.concat(F.lit("ALERT_"), "p_type"))))
        .unionByName(family("component_code", suppliers))
        .unionByName(family("software_component", t.part.select("p_brand")))
    )


def order_lines(t: Tables) -> DataFrame:
    return t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))


def request_texts(t: Tables, lines: DataFrame | None = None, key: Column | None = None) -> DataFrame:
    """One request text per order line, worded by the order's status and priority."""
    lines = order_lines(t) if lines is None else lines
    part = t.part.select("p_partkey", F.concat(F.lit("ALERT_"), "p_type").alias("p_type"), "p_name")
    rows = (
        lines.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            (line_number() if key is None else key).alias("doc_id"), "p_type", "p_name", F.col("o_orderstatus").alias("st"), F.col("o_orderpriority").alias("pri"),
            F.col("l_linenumber").alias("line"), F.col("l_suppkey").cast("string").alias("supp"),
            F.lpad(F.col("p_partkey").cast("string"), 7, "0").alias("note"),
        )
    )

    def say(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    st, pri = F.col("st"), F.col("pri")
    text = (
        F.when(
            st == "O",
            say("Find notes for alert ", F.col("p_type"), " in component s-", F.col("supp"), " on S/4HANA ", (F.col("line") + 2018).cast("string"),
                " SP0", F.col("line").cast("string"), ", priority ", F.lower(F.substring("pri", 3, 20)), "."),
        )
        .when((st == "F") & (pri == "1-URGENT"), F.lit("Find notes for S/4HANA 2021"))
        .when((st == "F") & (pri == "2-HIGH"), say("find SP0", F.col("line").cast("string")))
        .when((st == "F") & (pri == "3-MEDIUM"), F.lit("what prerequisites"))
        .when((st == "F") & (pri == "5-LOW"), F.lit("what is required"))
        .when(st == "F", say("What are the prerequisite notes required for note ", F.col("note"), "?"))
        .when(pri == "5-LOW", say("Which note resolves the ", F.col("p_name"), "?"))
        .when(pri == "3-MEDIUM", say("Find notes for alert ", F.col("p_type"), " and alert ALERT_PROMO"))
        .when(pri == "2-HIGH", F.col("note"))
        .when(pri == "1-URGENT", say("Explain alert ", F.col("p_type")))
        .otherwise(say("Retrieve the title and details for note ", F.col("note")))
    )
    return rows.select("doc_id", text.alias("text"))


SQL_REQUESTS = f"""req AS (SELECT {SQL_NUMBER} AS doc_id, p_type, o_orderstatus AS st, o_orderpriority AS pri, l_linenumber AS line, l_suppkey AS supp,
   lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS note, l_linenumber IN (3, 5, 7) AS known_version, o_orderpriority IN ('2-HIGH', '3-MEDIUM', '5-LOW') AS known_priority
   FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey)"""


@register(
    "k02_entity_extraction",
    with_tables(SQL_REQUESTS) + """SELECT doc_id, 'alert_code' AS family, 'ALERT_' || p_type AS value FROM req WHERE st = 'O' OR (st = 'P' AND pri IN ('3-MEDIUM', '1-URGENT'))
UNION SELECT doc_id, 'alert_code', 'ALERT_PROMO' FROM req WHERE st = 'P' AND pri = '3-MEDIUM'
UNION SELECT doc_id, 'component_code', 'S-' || supp FROM req WHERE st = 'O'
UNION SELECT doc_id, 'product_version', 'V' || (2018 + line) FROM req WHERE st = 'O' AND known_version
UNION SELECT doc_id, 'product_version', 'V2021' FROM req WHERE st = 'F' AND pri = '1-URGENT'
UNION SELECT doc_id, 'support_package', CAST(line AS VARCHAR) FROM req WHERE st = 'O' OR (st = 'F' AND pri = '2-HIGH')
UNION SELECT doc_id, 'priority', CASE pri WHEN '2-HIGH' THEN 'High' WHEN '3-MEDIUM' THEN 'Medium' ELSE 'Low' END FROM req WHERE st = 'O' AND known_priority
UNION SELECT doc_id, 'note_number', note FROM req WHERE (st = 'F' AND pri = '4-NOT SPECIFIED')
  OR (st = 'P' AND pri IN ('2-HIGH', '4-NOT SPECIFIED'))""",
)
def k02(t: Tables) -> DataFrame:
    return grounding.entity_slots(request_texts(t), _lexicon(t)).select("doc_id", "family", "value")


_SQL_DIAGNOSIS = """diag AS (SELECT *, CASE WHEN st = 'O' AND NOT (known_version AND known_priority) THEN 'UNKNOWN_ENTITY' WHEN st = 'O' THEN 'NONE'
   WHEN st = 'F' THEN CASE pri WHEN '1-URGENT' THEN 'UNKNOWN_TOKEN' WHEN '2-HIGH' THEN 'UNKNOWN_TOKEN' WHEN '3-MEDIUM' THEN 'UNSUPPORTED_INTENT'
     WHEN '5-LOW' THEN 'MISSING_REQUIRED_ENTITY' ELSE 'NONE' END
   WHEN pri = '5-LOW' THEN 'UNKNOWN_TOKEN' WHEN pri = '3-MEDIUM' AND p_type <> 'PROMO' THEN 'AMBIGUOUS_INPUT'
   WHEN pri = '1-URGENT' THEN 'UNSUPPORTED_INTENT' ELSE 'NONE' END AS failure FROM req),
 intents AS (SELECT *, CASE WHEN failure <> 'NONE' THEN 'UNSUPPORTED' WHEN st = 'O' THEN 'VERSION_FILTERED_SEARCH' WHEN st = 'F' THEN 'PREREQUISITE_CLOSURE'
   WHEN pri = '3-MEDIUM' THEN 'ALERT_RESOLUTION' WHEN pri = '2-HIGH' THEN 'GENERAL_SEARCH' ELSE 'NOTE_LOOKUP' END AS intent FROM diag)"""


def diagnosis(t: Tables, lines: DataFrame | None = None, key: Column | None = None) -> DataFrame:
    return grounding.diagnose(request_texts(t, lines, key), _lexicon(t))


@register("k03_extraction_diagnostics", with_tables(SQL_REQUESTS, _SQL_DIAGNOSIS) + "SELECT doc_id, failure FROM diag")
def k03(t: Tables) -> DataFrame:
    return diagnosis(t).select("doc_id", "failure")


@register("k04_request_intent", with_tables(SQL_REQUESTS, _SQL_DIAGNOSIS) + "SELECT doc_id, intent FROM intents")
def k04(t: Tables) -> DataFrame:
    return diagnosis(t).select("doc_id", "intent")


@register(
    "k05_metric_intent",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'UNSUPPORTED' ELSE 'CLAIMS' END WHEN 'F' THEN CASE o_orderpriority WHEN '5-LOW' THEN 'UNSUPPORTED' ELSE 'ACTIVE' END
  ELSE CASE o_orderpriority WHEN '1-URGENT' THEN 'UNSUPPORTED' WHEN '2-HIGH' THEN 'UNSUPPORTED' ELSE 'RATIO' END END AS intent FROM orders""",
)
def k05(t: Tables) -> DataFrame:
    """Claims questions, some without their window or with a second conjunction, and others."""
    st, pri = F.col("o_orderstatus"), F.col("o_orderpriority")
    window = F.when(pri == "1-URGENT", "").when(pri == "2-HIGH", " in Rome and Bonn in the last 12 months").otherwise(" in the last 12 months")
    claims = F.concat(
        F.lit("Find customers with at least three qualifying claims"), window, F.lit(" and total incurred loss above EUR "),
        F.format_number(F.floor("o_totalprice"), 0),
    )
    text = (
        F.when(st == "O", claims)
        .when((st == "F") & (pri == "5-LOW"), "How many have active policies and what is the claims ratio?")
        .when(st == "F", "How many customers have active policies this year?")
        .when(pri == "1-URGENT", "Find customers with more than two qualifying claims.")
        .when(pri == "2-HIGH", "Hello there")
        .otherwise("Show the Cost-Revenue Ratio for customers in the current year.")
    )
    return t.orders.select("o_orderkey", grounding.metric_intent(text).alias("intent"))


_SQL_LINES = """lines AS (SELECT {key} AS id, unnest(regexp_split_to_array({text}, '\\r\\n|[\\n\\r\\x0b\\x0c\\x{{1c}}\\x{{1d}}\\x{{1e}}\\x{{85}}\\x{{2028}}\\x{{2029}}]')) AS l,
   generate_subscripts(regexp_split_to_array({text}, '\\r\\n|[\\n\\r\\x0b\\x0c\\x{{1c}}\\x{{1d}}\\x{{1e}}\\x{{85}}\\x{{2028}}\\x{{2029}}]'), 1) AS line FROM {table})"""


@register(
    "k06_secret_scan",
    with_tables(_SQL_LINES.format(key="doc_id", text="text", table="documents"))
    + """SELECT id AS doc_id, CAST(line AS INTEGER) AS line FROM lines WHERE regexp_matches(l,
 '(?i)(?:api[_-]?key|access[_-]?key|client[_-]?secret|private[_ -]?key|password|passwd|secret|token|credential)\\s*[:=]\\s*[''"]?([A-Za-z0-9_./+=:-]{20,})')
 OR regexp_matches(l, '(?i)\\bbearer\\s+[A-Za-z0-9._~+/=-]{24,}') OR regexp_matches(l, '-----BEGIN [A-Z ]+PRIVATE KEY-----')""",
)
def k06(t: Tables) -> DataFrame:
    return scans.scan_secrets(t.documents)


@register(
    "k07_address_scan",
    with_tables(_SQL_LINES.format(key="page_id", text="html", table="pages WHERE NOT contains(url, 'spam-farm')"))
    + """SELECT id AS page_id, CAST(line AS INTEGER) AS line, f AS family FROM lines JOIN (VALUES ('example.org/'), ('href="/'), ('http://')) AS v(f) ON contains(l, f)""",
)
def k07(t: Tables) -> DataFrame:
    allowed = t.pages.where(F.contains("url", F.lit("spam-farm"))).select("page_id")
    return scans.scan_addresses(t.pages, ["example.org/", 'href="/', "http://"], "page_id", "html", allowed)


@register(
    "k08_marker_scan",
    with_tables(_SQL_LINES.format(key="doc_id", text="replace(replace(text, ' nicht ', ' fixMe '), ' la,', ' TBD,')", table="documents WHERE lang <> 'es'"))
    + "SELECT id AS doc_id, CAST(line AS INTEGER) AS line FROM lines WHERE regexp_matches(l, '(?i)(^|[^\\p{L}\\p{N}_])(TODO|FIXME|TBD|REPLACE_ME|CHANGEME)([^\\p{L}\\p{N}_]|$)')",
)
def k08(t: Tables) -> DataFrame:
    """Two common words replaced by markers, Spanish texts allowed."""
    marked = F.replace(F.replace("text", F.lit(" nicht "), F.lit(" fixMe ")), F.lit(" la,"), F.lit(" TBD,"))
    allowed = t.documents.where("lang = 'es'").select("doc_id")
    return scans.scan_markers(t.documents.select("doc_id", marked.alias("text")), allowed=allowed)
