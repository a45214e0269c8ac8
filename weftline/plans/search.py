"""Note search and relaxation: parts are notes, suppliers components, orders ask."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.operators import search
from weftline.plans.quality import SQL_NUMBER, line_number
from weftline.plans.registry import register
from weftline.plans.tables import Tables, with_tables
from weftline.session import spread


def part_notes(t: Tables) -> search.NoteGraph:
    """Type is the alert, brand the version, and a range of sizes the packages."""
    part = t.part
    low = F.col("p_size") % 10
    number = F.lpad(F.col("p_partkey").cast("string"), 7, "0")

    def code(prefix: str, key: str):
        return F.concat(F.lit(prefix), F.col(key).cast("string"))

    suppliers = t.supplier.select(code("S", "s_suppkey").alias("component_code"), code("N", "s_nationkey").alias("parent_code"))
    # Pairs move once, to their note, where equal ones go and the note's other columns are met.
    sold = t.lineitem.select(F.col("l_partkey").alias("note"), F.col("l_suppkey").alias("component"))
    nations = t.nation.select(code("N", "n_nationkey").alias("component_code"), code("R", "n_regionkey").alias("parent_code"))
    return search.NoteGraph(
        notes=part.select(
            F.col("p_partkey").alias("note"), number.alias("note_number"), F.col("p_name").alias("title"),
            low.alias("min_sp"), (low + 3).alias("max_sp"),
        ),
        alerts=part.select(F.col("p_partkey").alias("note"), F.col("p_type").alias("alert_code")),
        components=spread(sold, t.rows("lineitem"), "note").select("note", code("S", "component").alias("component_code")),
        versions=part.select(F.col("p_partkey").alias("note"), F.col("p_brand").alias("product_version")),
        parents=suppliers.union(nations),
    )


def order_requests(t: Tables) -> DataFrame:
    """One request per order line: its part, sold by the supplier of the order's last line.

    Lines without a discount name no alert and no component, so no search can start from them.
    """
    order = Window.partitionBy("l_orderkey")
    last = F.max_by("l_suppkey", F.struct("l_linenumber", "l_partkey", "l_suppkey")).over(order)
    lines = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", line_number().alias("request_id"), (F.col("l_discount") > 0).alias("named")
    ).withColumn("supplier", last)
    package = F.when(F.col("l_linenumber") > 6, None).when(F.col("supplier") % 2 == 0, 15).otherwise(5)
    return (
        lines.join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_brand"), "l_partkey")
        .select(
            "request_id",
            F.when(F.col("named"), F.col("p_type")).alias("alert_code"),
            F.col("p_brand").alias("product_version"),
            F.when(F.col("named"), F.concat(F.lit("S"), F.col("supplier").cast("string"))).alias("component_code"),
            package.cast("int").alias("support_package"),
        )
    )


_SQL_SEARCH = with_tables(
    """ends AS (SELECT l_orderkey, max({'n': l_linenumber, 'p': l_partkey, 's': l_suppkey}) AS b FROM lineitem GROUP BY 1)""",
    f"""every AS (SELECT {SQL_NUMBER} AS request_id, p_type, p_brand, 'S' || b.s AS comp, l_discount > 0 AS named,
   CASE WHEN l_linenumber > 6 THEN NULL WHEN b.s % 2 = 0 THEN 15 ELSE 5 END AS pkg
   FROM lineitem JOIN ends USING (l_orderkey) JOIN part ON p_partkey = l_partkey)""",
    "req AS (SELECT * FROM every WHERE named)",
    "nc AS (SELECT DISTINCT l_partkey AS note, l_suppkey AS s FROM lineitem)",
    """up AS (SELECT 'S' || s_suppkey AS code, 'S' || s_suppkey AS anc, s_suppkey AS s FROM supplier
   UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey, s_suppkey FROM supplier
   UNION ALL SELECT 'S' || s_suppkey, 'R' || n_regionkey, s_suppkey FROM supplier JOIN nation ON n_nationkey = s_nationkey)""",
    "nca AS (SELECT DISTINCT note, anc FROM nc JOIN up USING (s))",
    """strict AS (SELECT request_id, p_partkey AS note, row_number() OVER (PARTITION BY request_id ORDER BY p_partkey DESC) AS rank
   FROM req JOIN part USING (p_type, p_brand) JOIN nca ON note = p_partkey AND anc = comp
   WHERE pkg IS NULL OR pkg BETWEEN p_size % 10 AND p_size % 10 + 3)""",
    "e1 AS (SELECT * FROM req WHERE request_id NOT IN (SELECT request_id FROM strict))",
    """dropped AS (SELECT request_id, p_partkey AS note, row_number() OVER (PARTITION BY request_id ORDER BY p_partkey DESC) AS rank
   FROM e1 JOIN part USING (p_type, p_brand) JOIN nca ON note = p_partkey AND anc = comp WHERE pkg IS NOT NULL)""",
    "e2 AS (SELECT e1.*, 'N' || s_nationkey AS par FROM e1 JOIN supplier ON 'S' || s_suppkey = comp WHERE request_id NOT IN (SELECT request_id FROM dropped))",
    """widened AS (SELECT request_id, p_partkey AS note, row_number() OVER (PARTITION BY request_id ORDER BY p_partkey DESC) AS rank
   FROM e2 JOIN part USING (p_type, p_brand) JOIN nca ON note = p_partkey AND anc = par)""",
)


@register(
    "c07_range_join",
    _SQL_SEARCH + """, asked AS (SELECT DISTINCT comp, p_brand, pkg FROM req WHERE pkg IS NOT NULL)
SELECT comp || '/' || asked.p_brand || '/' || pkg AS request_id, note FROM asked JOIN nc ON 'S' || s = comp
JOIN part ON p_partkey = note AND part.p_brand = asked.p_brand WHERE pkg BETWEEN p_size % 10 AND p_size % 10 + 3""",
)
def c07(t: Tables) -> DataFrame:
    """Each distinct component, version and package is searched once."""
    low = F.col("p_size") % 10
    parts = t.part.select(
        F.col("p_partkey").alias("note"), F.col("p_brand").alias("product_version"), low.alias("min_sp"), (low + 3).alias("max_sp")
    )
    notes = parts.join(t.note_components(), "note").withColumn("component_code", F.concat(F.lit("S"), F.col("component").cast("string")))
    keys = ["component_code", "product_version", "support_package"]
    asked = order_requests(t).where("component_code IS NOT NULL AND support_package IS NOT NULL").select(*keys).distinct()
    requests = asked.withColumn("request_id", F.concat_ws("/", *[F.col(k).cast("string") for k in keys]))
    joined = search.range_join(requests, notes, keys[:2], "support_package", "min_sp", "max_sp")
    return joined.select("request_id", "note")


@register(
    "j05_rejected_requests",
    _SQL_SEARCH + "SELECT request_id, 'MISSING_REQUIRED_ENTITY' AS reason FROM every WHERE NOT named",
)
def j05_rejected(t: Tables) -> DataFrame:
    return search.rejected_requests(order_requests(t))


@register(
    "j05_note_search",
    _SQL_SEARCH + """SELECT request_id, note, lpad(CAST(note AS VARCHAR), 7, '0') AS note_number, p_name AS title, CAST(rank AS INTEGER) AS rank
FROM strict JOIN part ON note = p_partkey WHERE rank <= 25""",
)
def j05(t: Tables) -> DataFrame:
    return search.note_search(order_requests(t), part_notes(t))


@register(
    "j05_component_search",
    _SQL_SEARCH + """SELECT code AS request_id, note FROM (SELECT anc AS code, note,
  row_number() OVER (PARTITION BY anc ORDER BY note DESC) AS rn FROM nca) WHERE rn <= 25""",
)
def j05_components(t: Tables) -> DataFrame:
    """Every component asks for itself; a region covers all its suppliers' parts."""
    codes = part_notes(t)
    both = codes.parents.select("component_code").union(codes.parents.select("parent_code")).distinct()
    requests = both.select(F.col("component_code").alias("request_id"), "component_code")
    return search.note_search(requests, codes).select("request_id", "note")


@register(
    "j06_relaxation_outcome",
    _SQL_SEARCH + """, s AS (SELECT request_id, least(count(*), 25) AS n FROM strict GROUP BY 1),
 d AS (SELECT request_id, least(count(*), 25) AS n FROM dropped GROUP BY 1), w AS (SELECT request_id, least(count(*), 25) AS n FROM widened GROUP BY 1)
SELECT request_id, CASE WHEN s.n IS NULL THEN 'EMPTY_RESULT' ELSE 'SUCCESS' END AS status,
 CASE WHEN s.n IS NOT NULL THEN 'strict' WHEN d.n IS NOT NULL OR w.n IS NOT NULL THEN 'relaxed' ELSE 'none' END AS scope,
 CAST(CASE WHEN s.n IS NOT NULL THEN 0 WHEN d.n IS NOT NULL THEN 1 ELSE 2 END AS INTEGER) AS step,
 CASE WHEN s.n IS NOT NULL THEN 'NONE' WHEN d.n IS NOT NULL THEN 'RELAX_SUPPORT_PACKAGE' ELSE 'WIDEN_COMPONENT' END AS reason,
 coalesce(s.n, d.n, w.n, 0) AS bindings
FROM req LEFT JOIN s USING (request_id) LEFT JOIN d USING (request_id) LEFT JOIN w USING (request_id)
UNION ALL SELECT request_id, 'UNSUPPORTED', 'none', 0, 'MISSING_REQUIRED_ENTITY', 0 FROM every WHERE NOT named""",
)
def j06(t: Tables) -> DataFrame:
    result = search.relax_search(order_requests(t), part_notes(t))
    return search.relaxation_outcome(result.searched, result)


@register(
    "j06_relaxed_candidates",
    _SQL_SEARCH + """SELECT request_id, note, CAST(1 AS INTEGER) AS step, 'RELAX_SUPPORT_PACKAGE' AS reason FROM dropped WHERE rank <= 25
UNION ALL SELECT request_id, note, 2, 'WIDEN_COMPONENT' FROM widened WHERE rank <= 25""",
)
def j06_candidates(t: Tables) -> DataFrame:
    return search.relax_search(order_requests(t), part_notes(t)).relaxed.select("request_id", "note", "step", "reason")


@register(
    "j07_attempt_ledger",
    _SQL_SEARCH + """, n AS (SELECT request_id, least(count(*), 25) AS n FROM strict GROUP BY 1),
 d AS (SELECT request_id, least(count(*), 25) AS n FROM dropped GROUP BY 1), w AS (SELECT request_id, least(count(*), 25) AS n FROM widened GROUP BY 1)
SELECT request_id, CAST(0 AS INTEGER) AS step, CASE WHEN n > 0 THEN 'NONE' ELSE 'EMPTY_STRICT_RESULT' END AS reason, '' AS changed,
  coalesce(n, 0) AS bindings FROM req LEFT JOIN n USING (request_id)
UNION ALL SELECT request_id, 1, 'RELAX_SUPPORT_PACKAGE', 'support_package', coalesce(n, 0) FROM e1 LEFT JOIN d USING (request_id) WHERE pkg IS NOT NULL
UNION ALL SELECT request_id, 2, 'WIDEN_COMPONENT', 'component', coalesce(n, 0) FROM e2 LEFT JOIN w USING (request_id)""",
)
def j07(t: Tables) -> DataFrame:
    return search.relax_search(order_requests(t), part_notes(t)).attempts
