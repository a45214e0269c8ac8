"""Governed business metrics over partner, order, posting and billing tables."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.filters import apply_rule, compare, last_12_months
from weftline.schemas import ACTIVE_SALES_ORDER, MONEY, QUALIFYING_POSTING

AMOUNT = "amount_in_company_currency_eur"


def posting_count() -> Column:
    return F.count_distinct("journal_entry_id").alias("posting_count")


def total_loss() -> Column:
    return F.sum(F.col(AMOUNT).cast(MONEY)).alias("total_debit_loss_eur")


def average_posting() -> Column:
    """Summed amount per distinct posting; null where there is none."""
    return F.try_divide(
        F.sum(F.col(AMOUNT).cast(MONEY)).cast("double"), F.count_distinct("journal_entry_id")
    ).alias("average_posting_amount_eur")


def active_order_count() -> Column:
    active = F.when(F.col("order_status").isin(*ACTIVE_SALES_ORDER), F.col("sales_order_id"))
    return F.count_distinct(active).alias("active_sales_order_count")


def partner_postings(partners: DataFrame, orders: DataFrame, postings: DataFrame) -> DataFrame:
    """Partner ⋈ order ⋈ posting on partner_id, then sales_order_id.

    Each side keeps only what the joins and metrics need, so a posting's own partner_id
    plays no part. Partner and order are joined first: they are the smaller pair, and a hot
    order or partner is split by adaptive execution because no key repeats on that side.
    """
    order_side = orders.select("sales_order_id", "partner_id")
    posting_side = postings.select("sales_order_id", "journal_entry_id", AMOUNT)
    return (
        partners.select("partner_id", "country")
        .join(order_side, "partner_id")
        .join(posting_side, "sales_order_id")
    )


def metric_query(
    partners: DataFrame,
    orders: DataFrame,
    postings: DataFrame,
    *,
    country: str | int,
    product: str,
    as_of: date,
    min_count: int = 3,
    count_op: str = ">=",
    min_loss: float = 20_000,
    statuses: Sequence[str] = QUALIFYING_POSTING,
    country_on: Sequence[str] = ("partners", "orders", "postings"),
    product_on: Sequence[str] = ("orders", "postings"),
) -> DataFrame:
    """Partners with enough qualifying postings and loss in the trailing year.

    Every table that carries a country or product is restricted on its own, before any join.
    """
    if count_op not in (">=", ">"):
        raise ValueError("the posting count is compared with >= or >")
    sides = {
        "partners": partners,
        "orders": orders,
        "postings": apply_rule(postings, "posting_status", statuses).where(
            last_12_months("posting_date", as_of)
        ),
    }
    for name in country_on:
        sides[name] = sides[name].where(F.col("country") == country)
    for name in product_on:
        sides[name] = sides[name].where(F.col("product") == product)
    return (
        partner_postings(**sides)
        .groupBy("partner_id", "country")
        .agg(posting_count(), total_loss())
        .where(metric_predicates([("posting_count", count_op, min_count), ("total_debit_loss_eur", ">", min_loss)]))
        .sort("partner_id")
    )


def scoped_metric(
    partners: DataFrame,
    orders: DataFrame,
    postings: DataFrame,
    scopes: DataFrame,
    *,
    as_of: date,
    min_count: int = 3,
    min_loss: float = 20_000,
    statuses: Sequence[str] = QUALIFYING_POSTING,
) -> DataFrame:
    """metric_query for every distinct scope (country, product) at once: one aggregate with the scope as key.

    Partners carry the country, orders country and product, postings country and product; each
    side is reduced to the scopes on its own, and rows meet only within one scope. Only the
    partner's identifier is returned.
    """
    scopes = scopes.select("country", "product").distinct()
    both = ["country", "product"]
    recent = apply_rule(postings, "posting_status", statuses).where(last_12_months("posting_date", as_of))
    partner_side = partners.select("partner_id", "country").join(scopes.select("country").distinct(), "country", "left_semi")
    order_side = orders.select("sales_order_id", "partner_id", *both).join(scopes, both, "left_semi")
    posting_side = recent.select("sales_order_id", "journal_entry_id", AMOUNT, *both).join(scopes, both, "left_semi")
    joined = partner_side.join(order_side, ["partner_id", "country"]).join(posting_side, ["sales_order_id", *both])
    return (
        joined.groupBy("country", "product", "partner_id")
        .agg(posting_count(), total_loss())
        .where(metric_predicates([("posting_count", ">=", min_count), ("total_debit_loss_eur", ">", min_loss)]))
    )


def metric_predicates(predicates: Sequence[tuple[str, str, float]]) -> Column:
    """Conjunction of metric comparisons, applied after aggregation."""
    kept = F.lit(True)
    for metric, op, bound in predicates:
        kept = kept & compare(F.col(metric), op, bound)
    return kept


def aligned_aggregates(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_sum: str, right_sum: str
) -> DataFrame:
    """Aggregate each fact on the shared keys, then join one row to one row."""
    keys = list(keys)
    left_side = left.groupBy(*keys).agg(F.sum(F.col(left_sum).cast(MONEY)).alias("left_total"))
    right_side = right.groupBy(*keys).agg(F.sum(F.col(right_sum).cast(MONEY)).alias("right_total"))
    return left_side.join(right_side, keys)


def cost_revenue_ratio(
    postings: DataFrame,
    billing: DataFrame,
    *,
    as_of: date,
    statuses: Sequence[str] = QUALIFYING_POSTING,
    keys: Sequence[str] = ("partner_id", "country", "product"),
) -> DataFrame:
    """Qualifying loss over billed revenue per aligned key, each on its own date window."""
    loss = apply_rule(postings, "posting_status", statuses).where(
        last_12_months("posting_date", as_of)
    )
    revenue = billing.where(last_12_months("billing_date", as_of))
    joined = aligned_aggregates(loss, revenue, keys, AMOUNT, "billed_amount_eur")
    return joined.select(
        *keys,
        F.col("left_total").alias("total_debit_loss_eur"),
        F.col("right_total").alias("total_billed_amount_eur"),
        F.try_divide(F.col("left_total").cast("double"), F.col("right_total").cast("double")).alias(
            "cost_revenue_ratio"
        ),
    )


# Texts that stand for a missing or non-finite number.
SENTINELS = ("None", "NaN", "Infinity", "-Infinity")


def _not_finite(df: DataFrame, column: str) -> Column | None:
    kind = dict(df.dtypes)[column]
    value = F.col(column)
    if kind in ("double", "float"):
        return F.isnan(value) | (F.abs(value) == float("inf"))
    if kind == "string":
        return value.isin(*SENTINELS)
    return None


def finite_report(df: DataFrame) -> DataFrame:
    """Per number or text column, how many values are not finite or only stand for that."""
    checks = {c: check for c in df.columns if (check := _not_finite(df, c)) is not None}
    if not checks:
        raise ValueError("no number or text column to check")
    counts = df.agg(*[F.count_if(check).alias(c) for c, check in checks.items()])
    rows = [F.struct(F.lit(c).alias("column"), F.col(c).alias("violations")) for c in checks]
    return counts.select(F.inline(F.array(*rows)))


def require_finite(df: DataFrame) -> DataFrame:
    """The same rows; reading one with a non-finite value fails the job."""
    bad = F.lit(False)
    for column in df.columns:
        check = _not_finite(df, column)
        if check is not None:
            bad = bad | F.coalesce(check, F.lit(False))
    return df.where(
        F.when(bad, F.raise_error(F.lit("non-finite value in result")).cast("boolean")).otherwise(True)
    )
