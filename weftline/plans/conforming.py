"""Readers, writers, normalisation, catalogue lookups and column functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, LongType, StringType, StructField, StructType

from weftline import functions as fn
from weftline.operators import catalog, normalize
from weftline.plans.registry import register
from weftline.plans.tables import SQL_ORDERS, Tables, with_tables
from weftline.schemas import MONEY
from weftline.session import literal_rows, scratch_path
from weftline.sources import digests, tables

_ORDER_CONTRACT = StructType([
    StructField("o_orderkey", LongType()), StructField("o_orderstatus", StringType()),
    StructField("o_orderdate", DateType()), StructField("o_totalprice", MONEY),
])
_SQL_TYPED = """SELECT o_orderkey, o_orderstatus, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS o_orderdate,
  CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS o_totalprice FROM orders"""


def _shown(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {"o_orderdate": F.col("o_orderdate").cast("string"), "o_totalprice": F.col("o_totalprice").cast("double")}
    )


@register("a01_read_typed_csv", _SQL_TYPED)
def a01(t: Tables) -> DataFrame:
    """The orders written as CSV, read back under their contract."""
    path = scratch_path(t.spark, "typed")
    typed = tables.read_table(t.spark, f"{t.folder}/orders.parquet", _ORDER_CONTRACT, "parquet")
    typed.write.options(header=True).csv(path)
    return _shown(tables.read_table(t.spark, path, _ORDER_CONTRACT))


@register(
    "a02_read_raw_numbered",
    """SELECT CAST(row_number() OVER (ORDER BY o_orderkey) + 1 AS BIGINT) AS row_number,
  CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus FROM orders""",
)
def a02(t: Tables) -> DataFrame:
    """Raw lines of the order file, numbered through its parts."""
    path = scratch_path(t.spark, "raw")
    tables.write_sorted(t.orders, path, ["o_orderkey", "o_orderstatus"], ["o_orderkey"])
    return tables.read_raw(t.spark, path)


@register("a11_sorted_write", _SQL_TYPED + " ORDER BY o_orderkey")
def a11(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "sorted")
    typed = tables.cast_to_contract(t.orders, _ORDER_CONTRACT)
    tables.write_sorted(typed, path, _ORDER_CONTRACT.names, ["o_orderkey"], "parquet")
    return _shown(t.spark.read.parquet(path))


def _contents(t: Tables) -> DataFrame:
    return t.documents.select(
        F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content")
    )


_SQL_MANIFEST = """manifest AS (SELECT source || '/' || doc_id AS path, sha256(text) AS sha256,
  CAST(strlen(text) AS BIGINT) AS byte_length FROM documents)"""


@register("a09_content_manifest", with_tables(_SQL_MANIFEST) + "SELECT path, sha256, byte_length FROM manifest")
def a09(t: Tables) -> DataFrame:
    return digests.content_manifest(_contents(t))


# Hashes of lines, then of groups by prefix, two hex digits shorter each time.
SQL_TREE_LEVELS = """
 l4 AS (SELECT substr(h, 1, 8) AS k, sha256(string_agg(h, '' ORDER BY h)) AS h FROM leaves GROUP BY 1),
 l3 AS (SELECT substr(k, 1, 6) AS k, sha256(string_agg(h, '' ORDER BY k)) AS h FROM l4 GROUP BY 1),
 l2 AS (SELECT substr(k, 1, 4) AS k, sha256(string_agg(h, '' ORDER BY k)) AS h FROM l3 GROUP BY 1),
 l1 AS (SELECT substr(k, 1, 2) AS k, sha256(string_agg(h, '' ORDER BY k)) AS h FROM l2 GROUP BY 1)
SELECT sha256(string_agg(h, '' ORDER BY k)) AS digest"""
SQL_TREE = ", leaves AS (SELECT DISTINCT sha256(line) AS h FROM lines)," + SQL_TREE_LEVELS + " FROM l1"


@register(
    "a09_manifest_digest",
    with_tables(_SQL_MANIFEST)
    + ", lines AS (SELECT path || chr(0) || sha256 || chr(0) || byte_length AS line FROM manifest)" + SQL_TREE,
)
def a09_digest(t: Tables) -> DataFrame:
    lines = digests.content_manifest(_contents(t)).select(digests.manifest_line().alias("line"))
    return digests.tree_digest(lines, "line")


@register(
    "a10_manifest_changes",
    """WITH old AS (SELECT source || '/' || doc_id AS path, text FROM documents WHERE lang <> 'es'),
 new AS (SELECT source || '/' || doc_id AS path, CASE WHEN lang = 'de' THEN upper(text) ELSE text END AS text
   FROM documents WHERE lang <> 'fr'),
 j AS (SELECT coalesce(old.path, new.path) AS path, CASE WHEN old.path IS NULL THEN 'added'
   WHEN new.path IS NULL THEN 'removed' WHEN sha256(old.text) <> sha256(new.text) THEN 'changed' END AS change
   FROM old FULL JOIN new ON old.path = new.path)
SELECT path, change FROM j WHERE change IS NOT NULL""",
)
def a10(t: Tables) -> DataFrame:
    named = t.documents.select(
        F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"), "lang"
    )
    edited = F.when(F.col("lang") == "de", F.upper("content")).otherwise(F.col("content"))
    recorded = digests.content_manifest(named.where("lang <> 'es'"))
    current = digests.content_manifest(named.where("lang <> 'fr'").withColumn("content", edited))
    return digests.manifest_changes(recorded, current)


_SEGMENTS = (
    ("erp", "products", "AUTOMOBILE", "ProductAutomotive"), ("erp", "products", "Building\u00a0\t", "ProductCommercial"),
    ("erp", "products", "FURNITURE", "ProductCommercial"), ("erp", "products", "household", "ProductHousehold"),
    ("erp", "statuses", "P", "REVERSED"), ("erp", "order_statuses", "P", "CANCELLED"),
    ("erp", "order_statuses", "O", "RELEASED"), ("erp", "statuses", "O", "POSTED"), ("erp", "statuses", "F", "CLEARED"),
)


def _value_map(t: Tables) -> DataFrame:
    return literal_rows(t.spark, _SEGMENTS, "platform string, kind string, local_value string, canonical_value string")


def _registered(t: Tables) -> DataFrame:
    return literal_rows(t.spark, [("ProductAutomotive",), ("ProductCommercial",)], "id string")


_SQL_SEGMENT = """CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'ProductAutomotive' WHEN 'BUILDING' THEN 'ProductCommercial'
  WHEN 'FURNITURE' THEN 'ProductCommercial' END"""


@register(
    "b01_normalize_values",
    f"SELECT c_custkey, {_SQL_SEGMENT} AS product FROM customer WHERE {_SQL_SEGMENT} IS NOT NULL",
)
def b01(t: Tables) -> DataFrame:
    rows = t.customer.select("c_custkey", F.col("c_mktsegment").alias("product"))
    return normalize.normalize_values(rows, _value_map(t), "products", "product", "ERP", _registered(t))[0]


@register(
    "b01_rejected_values",
    f"""SELECT c_custkey, c_mktsegment AS product,
  CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'UNREGISTERED_TARGET' ELSE 'UNMAPPED_VALUE' END AS reason
FROM customer WHERE {_SQL_SEGMENT} IS NULL""",
)
def b01_rejected(t: Tables) -> DataFrame:
    rows = t.customer.select("c_custkey", F.col("c_mktsegment").alias("product"))
    return normalize.normalize_values(rows, _value_map(t), "products", "product", "ERP", _registered(t))[1]


@register(
    "b01_status_by_kind",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'RELEASED' WHEN 'P' THEN 'CANCELLED' END AS order_status,
  CASE o_orderstatus WHEN 'P' THEN 'REVERSED' WHEN 'O' THEN 'POSTED' ELSE 'CLEARED' END AS posting_status
FROM orders WHERE o_orderstatus IN ('O', 'P')""",
)
def b01_kinds(t: Tables) -> DataFrame:
    """The same local code reads differently as an order and as a posting status."""
    rows = t.orders.select(
        "o_orderkey", F.col("o_orderstatus").alias("order_status"), F.col("o_orderstatus").alias("posting_status")
    )
    ordered, _ = normalize.normalize_values(rows, _value_map(t), "order_statuses", "order_status", "erp")
    return normalize.normalize_values(ordered, _value_map(t), "statuses", "posting_status", "erp")[0]


_CUSTOMER_FIELDS = {"partner_id": "c_custkey", "partner_name": "c_name", "balance": "c_acctbal"}
_SUPPLIER_FIELDS = {"partner_id": "s_suppkey", "partner_name": "s_name", "balance": "s_acctbal"}


@register(
    "b02_conform", "SELECT c_custkey AS partner_id, c_name AS partner_name, c_acctbal AS balance FROM customer"
)
def b02(t: Tables) -> DataFrame:
    return normalize.conform(t.customer, _CUSTOMER_FIELDS)


@register(
    "b03_federated_union",
    """SELECT c_custkey AS partner_id, c_name AS partner_name, c_acctbal AS balance, 'FR' AS country FROM customer
UNION ALL SELECT s_suppkey, s_name, s_acctbal, 'DE' FROM supplier""",
)
def b03(t: Tables) -> DataFrame:
    return normalize.federate({
        "FR": normalize.conform(t.customer, _CUSTOMER_FIELDS), "DE": normalize.conform(t.supplier, _SUPPLIER_FIELDS),
    })


def _field_catalog(t: Tables) -> DataFrame:
    """Customers as mapping fields: one field per customer, PII where the balance is negative."""
    return t.customer.select(
        F.col("c_nationkey").cast("string").alias("location"),
        F.concat(F.lit("field_"), F.col("c_custkey").cast("string")).alias("canonical"),
        F.col("c_mktsegment").alias("concept"),
        (F.col("c_acctbal") < 0).alias("pii"),
        F.lit("customer").alias("source_table"),
        F.col("c_name").alias("physical_name"),
    )


@register(
    "b12_pii_columns",
    """SELECT DISTINCT 'field_' || c_custkey AS "column" FROM customer
WHERE c_acctbal < 0 AND c_nationkey IN (1, 2, 3) AND c_mktsegment IN ('MACHINERY', 'FURNITURE')""",
)
def b12(t: Tables) -> DataFrame:
    projected = literal_rows(t.spark, [("MACHINERY",), ("FURNITURE",)], "concept string")
    return normalize.pii_columns(_field_catalog(t), projected, ["1", "2", "3"])


@register("b13_without_pii", "SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def b13(t: Tables) -> DataFrame:
    return normalize.project_without_pii(t.customer, ["c_name", "email"])


@register(
    "b14_projection_report",
    """WITH j AS (SELECT d.doc_id, d.lang, l.quality FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT 'doc_id' AS "column", true AS required, CAST(COUNT(*) FILTER (doc_id IS NULL) AS BIGINT) AS nulls,
  COUNT(*) FILTER (doc_id IS NULL) = 0 AS complete FROM j
UNION ALL SELECT 'quality', true, COUNT(*) FILTER (quality IS NULL), COUNT(*) FILTER (quality IS NULL) = 0 FROM j
UNION ALL SELECT 'lang', false, COUNT(*) FILTER (lang IS NULL), true FROM j""",
)
def b14(t: Tables) -> DataFrame:
    joined = t.documents.select("doc_id", "lang").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return normalize.projection_report(joined, ["doc_id", "quality"], ["lang"])


@register(
    "b14_complete_rows",
    "SELECT d.doc_id, l.quality FROM documents d JOIN labels l USING (doc_id) WHERE l.quality IS NOT NULL",
)
def b14_rows(t: Tables) -> DataFrame:
    joined = t.documents.select("doc_id").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return normalize.complete_rows(joined, ["doc_id", "quality"])


@register(
    "c11_reference_integrity",
    """SELECT 'event.user' AS reference, CAST(user_id AS VARCHAR) AS value, COUNT(*) AS uses FROM events
WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING') GROUP BY user_id
UNION ALL SELECT 'lineitem.part', CAST(l_partkey AS VARCHAR), COUNT(*) FROM lineitem
WHERE l_partkey NOT IN (SELECT p_partkey FROM part) GROUP BY l_partkey
UNION ALL SELECT 'part.supplier', CAST(p_partkey AS VARCHAR), COUNT(*) FROM part
WHERE p_partkey NOT IN (SELECT s_suppkey FROM supplier) GROUP BY p_partkey""",
)
def c11(t: Tables) -> DataFrame:
    return catalog.dangling([
        catalog.Reference("event.user", t.events, "user_id", t.customer.where("c_mktsegment <> 'BUILDING'"), "c_custkey"),
        catalog.Reference("lineitem.part", t.lineitem, "l_partkey", t.part, "p_partkey"),
        catalog.Reference("part.supplier", t.part, "p_partkey", t.supplier, "s_suppkey"),
    ])


@register(
    "c12_edge_lookup",
    """WITH rel AS (SELECT l_suppkey AS source, l_partkey AS target, arg_min(l_returnflag, l_orderkey * 10 + l_linenumber) AS predicate
  FROM (SELECT l_suppkey, l_partkey, l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY ALL)
  GROUP BY 1, 2),
 req AS (SELECT DISTINCT l_suppkey AS source, l_partkey + 1 AS target FROM lineitem)
SELECT source, target, coalesce(predicate, 'none') AS predicate FROM req LEFT JOIN rel USING (source, target)""",
)
def c12(t: Tables) -> DataFrame:
    relationships = t.lineitem.groupBy(
        F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"),
    ).agg(F.min("l_returnflag").alias("predicate"))
    requests = t.lineitem.select(F.col("l_suppkey").alias("source"), (F.col("l_partkey") + 1).alias("target")).distinct()
    return catalog.edge_lookup(requests, relationships).select(
        "source", "target", F.coalesce("predicate", F.lit("none")).alias("predicate")
    )


def _products(t: Tables) -> DataFrame:
    """Parts as data products that expose their type and brand."""
    return t.part.select(
        F.col("p_partkey").cast("string").alias("id"),
        F.when(F.col("p_size") > 10, "CERTIFIED").otherwise("DRAFT").alias("certification_status"),
        F.when(F.col("p_retailprice") > 950, "CERTIFIED").otherwise("UNSAFE").alias("quality_status"),
        F.concat(F.lit("One row per "), F.col("p_name")).alias("grain"),
        F.array("p_type", "p_brand", "p_name").alias("concepts"),
    )


_SQL_CERTIFIED = "p_size > 10 AND p_retailprice > 950"


@register("c13_certified_products", f"SELECT CAST(p_partkey AS VARCHAR) AS id FROM part WHERE {_SQL_CERTIFIED} AND p_type = 'PROMO'")
def c13(t: Tables) -> DataFrame:
    return catalog.certified_products_for(_products(t), "PROMO").select("id")


@register(
    "c14_product_by_grain",
    f"""WITH c AS (SELECT DISTINCT p_name, p_brand || ' ' || p_name AS cid FROM part),
 k AS (SELECT p_brand || ' ' || p_name AS cid, COUNT(*) AS n, min(CAST(p_partkey AS VARCHAR)) AS product_id
   FROM part WHERE {_SQL_CERTIFIED} GROUP BY 1)
SELECT cid AS concept_id, CASE WHEN n = 1 THEN product_id END AS product_id, coalesce(n, 0) AS candidates,
  CASE WHEN n = 1 THEN 'OK' ELSE 'ERROR' END AS status FROM c LEFT JOIN k USING (cid)""",
)
def c14(t: Tables) -> DataFrame:
    """Concept: a brand's part name; product: a part with that brand and name."""
    own = F.concat_ws(" ", "p_brand", "p_name")
    concepts = t.part.select(own.alias("id"), own.alias("name")).distinct()
    products = _products(t).drop("grain", "concepts").join(
        t.part.select(F.col("p_partkey").cast("string").alias("id"), own.alias("own")), "id"
    )
    products = products.withColumn("grain", F.concat(F.lit("One Row per "), "own")).withColumn("concepts", F.array("own"))
    return catalog.product_for_entity(concepts, products)


@register(
    "c15_request_products",
    """WITH e AS (SELECT l_orderkey AS request_id, l_linenumber AS pos, p_name AS product_id, 0 AS kind, 0 AS pos2
   FROM lineitem JOIN part ON l_partkey = p_partkey),
 m AS (SELECT l_orderkey AS request_id, l_linenumber AS pos, s_name AS product_id, 1 AS kind, s_nationkey AS pos2
   FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
 u AS (SELECT request_id, product_id, min(kind * 1000000 + pos * 1000 + pos2) AS seen FROM (SELECT * FROM e UNION ALL SELECT * FROM m) GROUP BY ALL)
SELECT request_id, product_id, CAST(seen AS BIGINT) AS first_seen FROM u""",
)
def c15(t: Tables) -> DataFrame:
    """Request: an order; entities: its parts, known by name; metrics: its suppliers."""
    lines = t.lineitem.select(F.col("l_orderkey").alias("request_id"), F.col("l_linenumber").alias("pos"), "l_partkey", "l_suppkey")
    found = catalog.products_for_request(
        lines.select("request_id", "pos", F.col("l_partkey").alias("concept_id")),
        lines.select("request_id", "pos", F.col("l_suppkey").alias("metric_id")),
        t.part.select(F.col("p_partkey").alias("concept_id"), F.col("p_name").alias("product_id")),
        t.supplier.select(F.col("s_suppkey").alias("metric_id"), F.col("s_nationkey").alias("pos"), F.col("s_name").alias("product_id")),
    )
    at = F.col("first_seen")
    return found.select(
        "request_id", "product_id", (at[0] * 1_000_000 + at[1] * 1_000 + at[2]).cast("bigint").alias("first_seen")
    )


@register(
    "c16_name_lookup",
    """WITH names AS (SELECT lower(n) AS n, min(p_partkey) AS id FROM (
   SELECT p_partkey, p_name AS n FROM part UNION ALL SELECT p_partkey, p_brand FROM part) GROUP BY 1),
 req AS (SELECT c_custkey AS request_id, CASE c_custkey % 3 WHEN 0 THEN 'SMALL Ring' WHEN 1 THEN 'brand#' || (c_custkey % 40)
   ELSE c_mktsegment END AS name FROM customer),
 ali AS (SELECT request_id, name, CASE WHEN name = 'AUTOMOBILE' THEN 'hot gear' ELSE lower(name) END AS n FROM req)
SELECT request_id, name, coalesce(CAST(id AS VARCHAR), '-') AS id, CASE WHEN id IS NULL THEN 'UNKNOWN' ELSE 'OK' END AS status
FROM ali LEFT JOIN names USING (n)""",
)
def c16(t: Tables) -> DataFrame:
    key = F.col("c_custkey")
    name = (
        F.when(key % 3 == 0, "SMALL Ring")
        .when(key % 3 == 1, F.concat(F.lit("brand#"), (key % 40).cast("string")))
        .otherwise(F.col("c_mktsegment"))
    )
    requests = t.customer.select(key.alias("request_id"), name.alias("name"))
    assets = t.part.select(
        F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"),
        F.array("p_brand").alias("synonyms"), F.col("p_partkey").alias("ordinal"),
    )
    aliases = literal_rows(t.spark, [("Automobile", "Hot Gear")], "alias string, name string")
    found = catalog.name_lookup(requests, assets, aliases)
    return found.withColumn("id", F.coalesce("id", F.lit("-")))


# Column functions, each over a whole table.

_SQL_FOLD = "replace(replace(replace(lower({c}), 'ß', 'ss'), 'ς', 'σ'), 'ſ', 's')"
_SQL_TERM = (
    "trim(regexp_replace(translate(" + _SQL_FOLD + ", '-_/', '   '), '[\\s\\x0b\\x{{1c}}-\\x{{1f}}\\x{{85}}\\x{{a0}}\\x{{1680}}"
    "\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', ' ', 'g'))"
)


@register("g01_normalize_term", f"SELECT page_id, {_SQL_TERM.format(c='url')} AS term FROM pages")
def g01(t: Tables) -> DataFrame:
    return t.pages.select("page_id", fn.normalize_term(F.col("url")).alias("term"))


@register(
    "g01_normalize_text",
    f"SELECT doc_id, sha256({_SQL_TERM.format(c='text')}) AS digest FROM documents",
)
def g01_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.sha2(fn.normalize_term(F.col("text")), 256).alias("digest"))


@register(
    "g02_plural_variants",
    """WITH n AS (SELECT DISTINCT lower(replace(p_name, '-', ' ')) AS b FROM part UNION SELECT DISTINCT lower(c_mktsegment) FROM customer)
SELECT b AS term, CASE WHEN ends_with(b, 'y') THEN b || '|' || left(b, length(b) - 1) || 'ies'
  WHEN ends_with(b, 's') THEN b ELSE b || '|' || b || 's' END AS variants FROM n""",
)
def g02(t: Tables) -> DataFrame:
    names = t.part.select(F.col("p_name").alias("term")).union(t.customer.select("c_mktsegment")).distinct()
    return names.select(
        fn.normalize_term(F.col("term")).alias("term"), F.array_join(fn.plural_variants(F.col("term")), "|").alias("variants")
    )


SQL_TOKENS = (
    "[x FOR x IN string_split(replace(replace(regexp_replace(regexp_replace(" + _SQL_FOLD
    + ", '[\\s\\x0b\\x{{1c}}-\\x{{1f}}\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}},!?;:()\\[\\]{{}}\"'']', ' ', 'g'),"
    " '\\.(\\p{{Nd}})', '\x01\\1', 'g'), '.', ' '), '\x01', '.'), ' ') IF x <> '']"
)


@register(
    "g03_boundary_tokens",
    f"""SELECT doc_id, CAST(len(toks) AS BIGINT) AS n_tokens, sha256(array_to_string(toks, ' ')) AS digest
FROM (SELECT doc_id, {SQL_TOKENS.format(c='text')} AS toks FROM documents)""",
)
def g03(t: Tables) -> DataFrame:
    tokens = fn.boundary_tokens(F.col("text"))
    return t.documents.select("doc_id", tokens.alias("toks")).select(
        "doc_id", F.size("toks").cast("bigint").alias("n_tokens"), F.sha2(F.array_join("toks", " "), 256).alias("digest")
    )


def _questions(t: Tables) -> DataFrame:
    """One claims question per order, with its price and priority as thresholds."""
    words = F.element_at(F.array(*[F.lit(w) for w in ("two", "three", "eleven", "twenty", "dozen")]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    price = F.format_number(F.floor("o_totalprice"), 0)
    text = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("at least "), words, F.lit(" qualifying claims and total loss above\u00a0eur\t"), price))
    text = text.when(
        F.col("o_orderstatus") == "O",
        F.concat(F.lit("over\u2003"), (F.col("o_custkey") % 30).cast("string"), F.lit(" financial postings, loss greater than "), price, F.lit(" eur")),
    ).otherwise(F.concat(F.lit("show all postings near "), price))
    return t.orders.select("o_orderkey", text.alias("question"))


_SQL_QUESTION = """q AS (SELECT o_orderkey, CASE o_orderstatus
  WHEN 'F' THEN 'at least ' || ['two','three','eleven','twenty','dozen'][o_orderkey % 5 + 1] || ' qualifying claims and total loss above' || chr(160) || 'eur' || chr(9) || format('{:,}', CAST(floor(o_totalprice) AS BIGINT))
  WHEN 'O' THEN 'over' || chr(8195) || (o_custkey % 30) || ' financial postings, loss greater than ' || format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) || ' eur'
  ELSE 'show all postings near ' || format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) END AS question,
  o_orderstatus, o_custkey, o_totalprice FROM orders)"""


@register(
    "g04_money_threshold",
    with_tables(_SQL_QUESTION)
    + "SELECT o_orderkey, question, CASE o_orderstatus WHEN 'F' THEN CAST(floor(o_totalprice) AS BIGINT) WHEN 'O' THEN o_custkey % 30 ELSE -1 END AS amount FROM q",
)
def g04(t: Tables) -> DataFrame:
    """The first number after a threshold word: the postings count in "over 12 … greater than 9,000"."""
    return _questions(t).select(
        "o_orderkey", "question", F.coalesce(fn.money_threshold(F.col("question")), F.lit(-1).cast("bigint")).alias("amount")
    )


@register(
    "g05_count_threshold",
    with_tables(_SQL_QUESTION)
    + """SELECT o_orderkey, CAST(CASE o_orderstatus WHEN 'F' THEN [2, 3, 11, 20, -1][o_orderkey % 5 + 1]
  WHEN 'O' THEN o_custkey % 30 ELSE -1 END AS BIGINT) AS postings FROM q""",
)
def g05(t: Tables) -> DataFrame:
    return _questions(t).select(
        "o_orderkey", F.coalesce(fn.count_threshold(F.col("question")), F.lit(-1).cast("bigint")).alias("postings")
    )


_SQL_WORDS = "alter|attach|begin|commit|copy|create|delete|drop|execute|export|import|insert|load|pragma|rollback|select|truncate|union|update|vacuum"
_SQL_BOUND = "(^|[^\\p{{L}}\\p{{N}}_])({w})([^\\p{{L}}\\p{{N}}_]|$)"


@register(
    "g06_sql_shape",
    f"""SELECT doc_id, regexp_matches(lower(text), ';|--|/\\*|\\*/') OR regexp_matches(lower(text), '{_SQL_BOUND.format(w=_SQL_WORDS + "|with")}') AS in_field,
  regexp_matches(lower(text), ';|--|/\\*|\\*/') OR regexp_matches(lower(text), '{_SQL_BOUND.format(w=_SQL_WORDS)}')
  OR regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}_])with\\s+[a-z_][a-z0-9_]*\\s+as\\s*\\(') AS in_prose FROM documents""",
)
def g06(t: Tables) -> DataFrame:
    return t.documents.select(
        "doc_id",
        fn.looks_like_sql(F.col("text")).alias("in_field"),
        fn.looks_like_sql(F.col("text"), natural_language=True).alias("in_prose"),
    )


@register(
    "g07_redact",
    """WITH m AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
  '(?i)(authorization\\s*[:=]\\s*(?:bearer|basic)\\s+)[^\\s,;]+', '\\1[REDACTED]', 'g'),
  '(?i)\\bbasic\\s+[^\\s,;]+', 'Basic [REDACTED]', 'g'), '(?i)\\bbearer\\s+[^\\s,;]+', 'Bearer [REDACTED]', 'g'),
  '(?i)(\\b(?:password|passwd|secret|token|api[_-]?key|credential)\\s*[:=]\\s*)[^\\s,;]+', '\\1[REDACTED]', 'g'),
  '(?i)\\b([a-z][a-z0-9+.-]*://)([^\\s/@:]*):([^\\s/@]+)@', '\\1[REDACTED]@', 'g') AS masked FROM documents)
SELECT doc_id, sha256(masked) AS digest, sha256(left(masked, 512)) AS cut_digest FROM m""",
)
def g07(t: Tables) -> DataFrame:
    """Whole texts masked, and the diagnostic form cut to 512 characters."""
    whole, cut = fn.mask_credentials(F.col("text")), fn.redact(F.col("text"))
    return t.documents.select("doc_id", F.sha2(whole, 256).alias("digest"), F.sha2(cut, 256).alias("cut_digest"))


@register("g08_local_name", "SELECT page_id, regexp_extract(url, '([^/#]*)$', 1) AS name FROM pages")
def g08(t: Tables) -> DataFrame:
    return t.pages.select("page_id", fn.local_name(F.col("url")).alias("name"))


@register(
    "g09_identifier_checks",
    """SELECT p_partkey, regexp_full_match('erp:' || replace(p_name, ' ', '_'), '[a-z][a-z0-9_-]*:[A-Za-z][A-Za-z0-9_-]*') AS canonical,
  regexp_full_match(left(p_type, p_size % 4), '[A-Z]{2}') AS country, regexp_full_match(p_brand, '[A-Za-z][A-Za-z0-9]*') AS product,
  regexp_full_match(p_size || '.0.' || p_partkey, '(0|[1-9][0-9]*)\\.(0|[1-9][0-9]*)\\.(0|[1-9][0-9]*)') AS version FROM part""",
)
def g09(t: Tables) -> DataFrame:
    return t.part.select(
        "p_partkey",
        fn.is_canonical_id(F.concat(F.lit("erp:"), F.translate("p_name", " ", "_"))).alias("canonical"),
        fn.is_country_code(F.left("p_type", F.col("p_size") % 4)).alias("country"),
        fn.is_product_id(F.col("p_brand")).alias("product"),
        fn.is_semantic_version(F.concat_ws(".", F.col("p_size").cast("string"), F.lit("0"), F.col("p_partkey").cast("string"))).alias("version"),
    )


@register(
    "g10_row_digest",
    """SELECT p_partkey, sha256('{"p_brand":"' || p_brand || '","p_name":"' || p_name || '","p_partkey":' || p_partkey || ',"p_size":' || p_size || '}') AS digest FROM part""",
)
def g10(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", fn.row_digest(["p_size", "p_name", "p_partkey", "p_brand"]).alias("digest"))


@register(
    "g11_iso_date",
    with_tables(SQL_ORDERS)
    + """SELECT sales_order_id, CASE sales_order_id % 4 WHEN 0 THEN strftime(effective_date, '%Y-%m-%d') WHEN 1 THEN strftime(effective_date, '%Y-%m-%d')
   ELSE '-' END AS day FROM sales_orders""",
)
def g11(t: Tables) -> DataFrame:
    """Dashed and basic dates are read; a month alone or slashes are not dates."""
    day, key = F.col("effective_date"), F.col("sales_order_id") % 4
    written = (
        F.when(key == 0, F.date_format(day, "yyyy-MM-dd")).when(key == 1, F.date_format(day, "yyyyMMdd"))
        .when(key == 2, F.date_format(day, "yyyy-MM")).otherwise(F.date_format(day, "yyyy/MM/dd"))
    )
    return t.sales_orders().select(
        "sales_order_id", F.coalesce(fn.iso_date(written).cast("string"), F.lit("-")).alias("day")
    )


@register(
    "g12_six_place_ratio",
    """SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'null'
  ELSE printf('%.6f', CAST(round_even(CAST(p_partkey AS DOUBLE) / (p_size % 7), 6) AS DOUBLE)) END AS ratio FROM part""",
)
def g12(t: Tables) -> DataFrame:
    ratio = fn.ratio6(F.col("p_partkey"), F.col("p_size") % 7)
    return t.part.select("p_partkey", F.coalesce(ratio.cast("string"), F.lit("null")).alias("ratio"))


@register(
    "g13_support_package",
    """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN -1 WHEN p_partkey % 100 < 10 THEN p_partkey % 10 ELSE p_partkey % 100 END::BIGINT AS package FROM part""",
)
def g13(t: Tables) -> DataFrame:
    number = (F.col("p_partkey") % 100).cast("string")
    token = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("sp1"), F.lpad(number, 2, "0"))).otherwise(F.concat(F.lit("sp"), number))
    return t.part.select("p_partkey", F.coalesce(fn.support_package(token), F.lit(-1)).cast("bigint").alias("package"))
