"""Metric queries: joins, filters, aggregates and ordered results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators import filters, metrics
from weftline.operators.graph import canonical_order
from weftline.plans.registry import register
from weftline.plans.tables import (
    AS_OF,
    COUNTRY,
    PRODUCT,
    SQL_BILLING,
    SQL_ORDERS,
    SQL_PARTNERS,
    SQL_POSTINGS,
    Tables,
    with_tables,
)

_PARTNER_SIDE = {"country_on": ("partners",), "product_on": ("partners",)}
_QUALIFIED = """posting_status IN ('POSTED', 'CLEARED')
   AND posting_date BETWEEN DATE '2000-06-30' AND DATE '2001-06-30'"""


def flagship(t: Tables) -> DataFrame:
    return metrics.metric_query(
        t.partners(), t.sales_orders(), t.postings(),
        country=COUNTRY, product=PRODUCT, as_of=AS_OF, min_count=3, min_loss=20_000, **_PARTNER_SIDE,
    ).withColumn("total_debit_loss_eur", F.col("total_debit_loss_eur").cast("double"))


@register(
    "d07_metric_query",
    with_tables(SQL_PARTNERS, SQL_ORDERS, SQL_POSTINGS)
    + f"""SELECT partner_id, country, COUNT(DISTINCT journal_entry_id) AS posting_count,
       CAST(SUM(amount) AS DOUBLE) AS total_debit_loss_eur
FROM partners JOIN sales_orders USING (partner_id) JOIN postings USING (sales_order_id)
WHERE {_QUALIFIED} AND country = 1 AND product = 'AUTOMOBILE'
GROUP BY partner_id, country
HAVING COUNT(DISTINCT journal_entry_id) >= 3 AND SUM(amount) > 20000
ORDER BY partner_id""",
)
def d07(t: Tables) -> DataFrame:
    return flagship(t)


def _joined(t: Tables) -> DataFrame:
    """Qualifying postings of the trailing year with their partner."""
    kept = filters.apply_rule(t.postings(), "posting_status", metrics.QUALIFYING_POSTING)
    kept = kept.where(filters.last_12_months("posting_date", AS_OF))
    return metrics.partner_postings(t.partners(), t.sales_orders(), kept)


_SQL_JOINED = with_tables(SQL_PARTNERS, SQL_ORDERS, SQL_POSTINGS) + """, joined AS (
  SELECT partner_id, country, sales_order_id, journal_entry_id, amount
  FROM partners JOIN sales_orders USING (partner_id) JOIN postings USING (sales_order_id)
  WHERE {qualified})
""".format(qualified=_QUALIFIED)


def as_double(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


@register(
    "c01_partner_order_posting",
    with_tables(SQL_PARTNERS, SQL_ORDERS, SQL_POSTINGS)
    + """SELECT partner_id, country, sales_order_id, journal_entry_id, CAST(amount AS DOUBLE) AS amount
FROM partners JOIN sales_orders USING (partner_id) JOIN postings USING (sales_order_id)""",
)
def c01(t: Tables) -> DataFrame:
    joined = metrics.partner_postings(t.partners(), t.sales_orders(), t.postings())
    return joined.select(
        "partner_id", "country", "sales_order_id", "journal_entry_id",
        F.col(metrics.AMOUNT).cast("double").alias("amount"),
    )


@register(
    "b04_rule_subset",
    with_tables(SQL_ORDERS) + "SELECT sales_order_id, partner_id FROM sales_orders WHERE order_status = 'RELEASED'",
)
def b04(t: Tables) -> DataFrame:
    kept = filters.apply_rule(t.sales_orders(), "order_status", metrics.ACTIVE_SALES_ORDER)
    return kept.select("sales_order_id", "partner_id")


@register(
    "b05_trailing_window",
    with_tables(SQL_POSTINGS)
    + """SELECT journal_entry_id, CAST(posting_date AS VARCHAR) AS posting_date FROM postings
WHERE posting_date BETWEEN DATE '2000-06-30' AND DATE '2001-06-30'""",
)
def b05(t: Tables) -> DataFrame:
    kept = t.postings().where(filters.last_12_months("posting_date", AS_OF))
    return kept.select("journal_entry_id", F.col("posting_date").cast("string"))


@register(
    "b06_current_year",
    with_tables(SQL_BILLING)
    + """SELECT billing_doc_id, CAST(billing_date AS VARCHAR) AS billing_date FROM billing
WHERE year(billing_date) = 2001 AND billing_date <= DATE '2001-06-30'""",
)
def b06(t: Tables) -> DataFrame:
    kept = t.billing().where(filters.current_year("billing_date", AS_OF))
    return kept.select("billing_doc_id", F.col("billing_date").cast("string"))


@register(
    "b07_typed_predicates",
    with_tables(SQL_POSTINGS)
    + """SELECT journal_entry_id, CAST(amount AS DOUBLE) AS amount FROM postings
WHERE posting_status IN ('POSTED', 'REVERSED') AND amount > 50000 AND amount <= 80000 AND sales_order_id <> 7""",
)
def b07(t: Tables) -> DataFrame:
    kept = filters.filter_by(
        t.postings(),
        [
            ("posting_status", "IN", ["POSTED", "REVERSED"]),
            (metrics.AMOUNT, ">", 50_000),
            (metrics.AMOUNT, "<=", 80_000),
            ("sales_order_id", "!=", 7),
        ],
    )
    return kept.select("journal_entry_id", F.col(metrics.AMOUNT).cast("double").alias("amount"))


@register(
    "b08_country_scope",
    with_tables(SQL_PARTNERS) + "SELECT partner_id, product FROM partners WHERE country = 1",
)
def b08(t: Tables) -> DataFrame:
    return filters.scope_country(t.partners(), COUNTRY).select("partner_id", "product")


@register(
    "b09_slot_values",
    "SELECT p_partkey, p_type FROM part WHERE p_type IN ('PROMO', 'ECONOMY')",
)
def b09(t: Tables) -> DataFrame:
    return t.part.where(filters.slot_values("p_type", ["PROMO", "ECONOMY", "PROMO"])).select("p_partkey", "p_type")


@register(
    "b10_range_containment",
    "SELECT p_partkey FROM part WHERE p_size % 10 <= 5 AND p_size % 10 + 3 >= 5",
)
def b10(t: Tables) -> DataFrame:
    bounded = t.part.select(
        "p_partkey", (F.col("p_size") % 10).alias("min_sp"), (F.col("p_size") % 10 + 3).alias("max_sp")
    )
    return bounded.where(filters.contains_value("min_sp", "max_sp", 5)).select("p_partkey")


@register(
    "b15_bound_sql",
    """SELECT c_mktsegment, COUNT(*) AS customers, SUM(CAST(c_acctbal AS DECIMAL(18,2)))::DOUBLE AS balance
FROM customer WHERE c_acctbal > 1000 GROUP BY c_mktsegment""",
)
def b15(t: Tables) -> DataFrame:
    result = filters.run_sql(
        t.spark,
        """SELECT c_mktsegment, COUNT(*) AS customers,
                  CAST(SUM(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS balance
           FROM {customer} WHERE c_acctbal > :floor GROUP BY c_mktsegment""",
        {"floor": 1000},
        customer=t.customer,
    )
    return metrics.require_finite(result)


@register(
    "d01_posting_count",
    _SQL_JOINED + "SELECT partner_id, country, COUNT(DISTINCT journal_entry_id) AS posting_count FROM joined GROUP BY ALL",
)
def d01(t: Tables) -> DataFrame:
    return _joined(t).groupBy("partner_id", "country").agg(metrics.posting_count())


@register(
    "d02_total_debit_loss",
    _SQL_JOINED
    + "SELECT partner_id, country, CAST(SUM(amount) AS DOUBLE) AS total_debit_loss_eur FROM joined GROUP BY ALL",
)
def d02(t: Tables) -> DataFrame:
    totals = _joined(t).groupBy("partner_id", "country").agg(metrics.total_loss())
    return as_double(totals, "total_debit_loss_eur")


@register(
    "d03_average_posting_amount",
    _SQL_JOINED
    + """SELECT partner_id, round(CAST(SUM(amount) AS DOUBLE) / NULLIF(COUNT(DISTINCT journal_entry_id), 0), 4)
  AS average_posting_amount_eur FROM joined GROUP BY partner_id""",
)
def d03(t: Tables) -> DataFrame:
    averages = _joined(t).groupBy("partner_id").agg(metrics.average_posting())
    return averages.withColumn("average_posting_amount_eur", F.round("average_posting_amount_eur", 4))


@register(
    "d04_active_sales_orders",
    with_tables(SQL_PARTNERS, SQL_ORDERS)
    + """SELECT partner_id, COUNT(DISTINCT CASE WHEN order_status = 'RELEASED' THEN sales_order_id END)
  AS active_sales_order_count FROM partners JOIN sales_orders USING (partner_id) GROUP BY partner_id""",
)
def d04(t: Tables) -> DataFrame:
    joined = t.partners().select("partner_id").join(t.sales_orders(), "partner_id")
    return joined.groupBy("partner_id").agg(metrics.active_order_count())


def _facts(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Postings and billing documents with the aligned dimensions."""
    partner = t.partners().select("partner_id", "country", "product")
    orders = t.sales_orders().select("sales_order_id", "partner_id")
    postings = t.postings().join(orders, "sales_order_id").join(partner, "partner_id")
    return postings, t.billing().join(partner, "partner_id")


_SQL_FACTS = with_tables(SQL_PARTNERS, SQL_ORDERS, SQL_POSTINGS, SQL_BILLING) + """, loss AS (
  SELECT partner_id, country, product, SUM(amount) AS loss_total
  FROM postings JOIN sales_orders USING (sales_order_id) JOIN partners USING (partner_id)
  WHERE {qualified} GROUP BY ALL),
revenue AS (
  SELECT partner_id, country, product, SUM(billed_amount_eur) AS billed_total
  FROM billing JOIN partners USING (partner_id)
  WHERE billing_date BETWEEN DATE '2000-06-30' AND DATE '2001-06-30' GROUP BY ALL)
""".format(qualified=_QUALIFIED)


@register(
    "d05_cost_revenue_ratio",
    _SQL_FACTS
    + """SELECT partner_id, country, product, CAST(loss_total AS DOUBLE) AS total_debit_loss_eur,
  CAST(billed_total AS DOUBLE) AS total_billed_amount_eur,
  round(CAST(loss_total AS DOUBLE) / NULLIF(CAST(billed_total AS DOUBLE), 0), 6) AS cost_revenue_ratio
FROM loss JOIN revenue USING (partner_id, country, product)""",
)
def d05(t: Tables) -> DataFrame:
    ratio = metrics.cost_revenue_ratio(*_facts(t), as_of=AS_OF)
    return as_double(ratio, "total_debit_loss_eur", "total_billed_amount_eur").withColumn(
        "cost_revenue_ratio", F.round("cost_revenue_ratio", 6)
    )


@register(
    "c10_aligned_aggregates",
    with_tables(SQL_PARTNERS, SQL_ORDERS, SQL_POSTINGS, SQL_BILLING)
    + """, l AS (SELECT country, product, SUM(amount) AS x FROM postings JOIN sales_orders USING (sales_order_id)
          JOIN partners USING (partner_id) GROUP BY ALL),
 r AS (SELECT country, product, SUM(billed_amount_eur) AS y FROM billing JOIN partners USING (partner_id) GROUP BY ALL)
SELECT country, product, CAST(x AS DOUBLE) AS left_total, CAST(y AS DOUBLE) AS right_total
FROM l JOIN r USING (country, product)""",
)
def c10(t: Tables) -> DataFrame:
    postings, billing = _facts(t)
    joined = metrics.aligned_aggregates(
        postings, billing, ["country", "product"], metrics.AMOUNT, "billed_amount_eur"
    )
    return as_double(joined, "left_total", "right_total")


@register(
    "d06_metric_predicate",
    _SQL_JOINED
    + """SELECT partner_id, COUNT(DISTINCT journal_entry_id) AS posting_count,
  CAST(SUM(amount) AS DOUBLE) AS total_debit_loss_eur FROM joined GROUP BY partner_id
HAVING COUNT(DISTINCT journal_entry_id) > 5 AND SUM(amount) <= 400000 AND COUNT(DISTINCT journal_entry_id) <> 7""",
)
def d06(t: Tables) -> DataFrame:
    grouped = _joined(t).groupBy("partner_id").agg(metrics.posting_count(), metrics.total_loss())
    kept = grouped.where(
        metrics.metric_predicates([
            ("posting_count", ">", 5), ("total_debit_loss_eur", "<=", 400_000), ("posting_count", "!=", 7),
        ])
    )
    return as_double(kept, "total_debit_loss_eur")


@register(
    "d08_finite_report",
    """WITH v AS (SELECT event_id, CASE WHEN event_type = 'error' THEN 'NaN' ELSE event_type END AS event_type,
  CASE WHEN user_id = 3 THEN CAST('NaN' AS DOUBLE) WHEN value > 40 THEN CAST('Infinity' AS DOUBLE) ELSE value END AS value
  FROM events)
SELECT 'value' AS "column", CAST(COUNT(*) FILTER (isnan(value) OR isinf(value)) AS BIGINT) AS violations FROM v
UNION ALL SELECT 'event_type', CAST(COUNT(*) FILTER (event_type IN ('None','NaN','Infinity','-Infinity')) AS BIGINT) FROM v""",
)
def d08(t: Tables) -> DataFrame:
    value = F.when(F.col("user_id") == 3, float("nan")).when(F.col("value") > 40, float("inf")).otherwise(F.col("value"))
    kind = F.when(F.col("event_type") == "error", "NaN").otherwise(F.col("event_type"))
    return metrics.finite_report(t.events.select("event_id", kind.alias("event_type"), value.alias("value")))


@register(
    "e01_ordered_result",
    _SQL_JOINED
    + "SELECT partner_id, COUNT(DISTINCT sales_order_id) AS orders FROM joined GROUP BY partner_id ORDER BY partner_id",
)
def e01(t: Tables) -> DataFrame:
    return _joined(t).groupBy("partner_id").agg(F.count_distinct("sales_order_id").alias("orders")).sort("partner_id")


@register(
    "e03_canonical_order",
    """SELECT CAST(p_partkey AS VARCHAR) AS note_number, p_name AS note, p_brand AS brand FROM part
ORDER BY note_number, note""",
)
def e03(t: Tables) -> DataFrame:
    bindings = t.part.select(
        F.col("p_partkey").cast("string").alias("note_number"), F.col("p_name").alias("note"), F.col("p_brand").alias("brand")
    )
    return canonical_order(bindings)


@register("f01_distinct_projection", "SELECT DISTINCT l_partkey, l_suppkey, l_returnflag FROM lineitem")
def f01(t: Tables) -> DataFrame:
    return t.lineitem.select("l_partkey", "l_suppkey", "l_returnflag").distinct()
