from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from weftline.operators import filters, metrics
from weftline.schemas import BILLING, ORDERS, PARTNERS, POSTINGS

AS_OF = date(2026, 8, 28)
AUTO = "erp:ProductAutomotive"


def _order(key, partner, country="FR", product=AUTO, status="RELEASED"):
    return (key, partner, country, product, status, date(2026, 1, 1), date(2027, 1, 1), Decimal(100))


def _posting(key, order, amount, day=date(2026, 6, 1), status="POSTED", country="FR", partner="X"):
    return (key, order, partner, country, AUTO, status, day, Decimal(amount))


@pytest.fixture(scope="module")
def business(spark):
    partners = spark.createDataFrame(
        [("FR_001", "a", "FR", "e"), ("FR_002", "b", "FR", "e"), ("FR_003", "c", "FR", "e"), ("DE_001", "d", "DE", "e")], PARTNERS.struct
    )
    orders = spark.createDataFrame(
        [_order("O1", "FR_001"), _order("O2", "FR_002"), _order("O3", "FR_003"), _order("O4", "DE_001", "DE")], ORDERS.struct
    )
    postings = spark.createDataFrame(
        [
            _posting("P1", "O1", 8000), _posting("P2", "O1", 8000, status="CLEARED"), _posting("P3", "O1", 8000, day=date(2025, 8, 28)),
            _posting("P4", "O1", 90000, status="REVERSED"), _posting("P5", "O1", 90000, status="DUPLICATE"),
            _posting("P6", "O1", 90000, day=date(2025, 8, 27), status="CLEARED"),
            _posting("P7", "O2", 5000), _posting("P8", "O2", 10000, day=AS_OF), _posting("P9", "O2", 10000),
            _posting("P10", "O3", 90000), _posting("P11", "O3", 90000),
            *[_posting(f"P2{n}", "O4", 50000, country="DE") for n in range(4)],
        ],
        POSTINGS.struct,
    )
    return partners, orders, postings


def test_golden_rows(business, rows):
    found = metrics.metric_query(*business, country="FR", product=AUTO, as_of=AS_OF, min_count=3, min_loss=20_000)
    assert rows(found) == [("FR_001", "FR", 3, Decimal("24000.00")), ("FR_002", "FR", 3, Decimal("25000.00"))]


def test_strict_count_and_country_scope(business, rows):
    assert rows(metrics.metric_query(*business, country="FR", product=AUTO, as_of=AS_OF, count_op=">")) == []
    german = metrics.metric_query(*business, country="DE", product=AUTO, as_of=AS_OF)
    assert rows(german, "partner_id") == [("DE_001",)]
    with pytest.raises(ValueError):
        metrics.metric_query(*business, country="FR", product=AUTO, as_of=AS_OF, count_op="<")


def test_a_posting_is_joined_by_order_not_by_its_own_partner(business, rows):
    joined = metrics.partner_postings(*business)
    assert rows(joined.where("partner_id = 'FR_002'"), "journal_entry_id") == [("P7",), ("P8",), ("P9",)]


def test_leap_day_window_clamps(spark, rows):
    days = spark.createDataFrame([(date(2023, 2, 27),), (date(2023, 2, 28),), (date(2024, 2, 29),)], "d date")
    assert rows(days.where(filters.last_12_months("d", date(2024, 2, 29)))) == [(date(2023, 2, 28),), (date(2024, 2, 29),)]


def test_ratio_has_no_fan_out(spark, rows):
    """Two postings and two bills of one key: a row join would double both sums."""
    postings = spark.createDataFrame([_posting("A", "O1", 10, partner="p"), _posting("B", "O1", 20, partner="p")], POSTINGS.struct)
    bill = ("O1", "p", "FR", AUTO, date(2026, 5, 1), Decimal(60))
    billing = spark.createDataFrame([("B1", *bill), ("B2", *bill)], BILLING.struct)
    ratio = metrics.cost_revenue_ratio(postings, billing, as_of=AS_OF)
    assert rows(ratio, "total_debit_loss_eur", "total_billed_amount_eur", "cost_revenue_ratio") == [(Decimal("30.00"), Decimal("120.00"), 0.25)]


def test_rule_in_force(spark, rows):
    orders = spark.createDataFrame([_order("O1", "p"), _order("O2", "p", status="CLOSED")], ORDERS.struct)
    assert rows(filters.apply_rule(orders, "order_status", ["RELEASED"], date(2026, 5, 5)), "sales_order_id") == [("O1",)]
    assert rows(filters.apply_rule(orders, "order_status", ["RELEASED"], date(2028, 5, 5)), "sales_order_id") == []


def test_non_finite_values_are_refused(spark, rows):
    df = spark.createDataFrame([(1.0, "ok"), (float("nan"), "NaN")], "x double, s string")
    assert rows(metrics.finite_report(df)) == [("s", 1), ("x", 1)]
    with pytest.raises(Exception, match="non-finite"):
        metrics.require_finite(df).collect()
    assert metrics.require_finite(df.where("s = 'ok'")).count() == 1


def test_bound_sql_never_pastes_values(spark, rows):
    df = spark.createDataFrame([("a' OR 'x'='x",), ("b",)], "v string")
    found = filters.run_sql(spark, "SELECT v FROM {t} WHERE v = :v", {"v": "a' OR 'x'='x"}, t=df)
    assert rows(found) == [("a' OR 'x'='x",)]


def test_unknown_operator(spark):
    with pytest.raises(ValueError):
        filters.filter_by(spark.range(1), [("id", "LIKE", 1)])
    assert filters.filter_by(spark.range(5), [("id", ">=", 1), ("id", "IN", [1, 2, 9])]).count() == 2


def test_active_orders(spark, rows):
    orders = spark.createDataFrame([_order("O1", "p"), _order("O1", "p"), _order("O2", "p", status="CANCELLED")], ORDERS.struct)
    assert rows(orders.groupBy("partner_id").agg(metrics.active_order_count())) == [("p", 1)]
    none = spark.createDataFrame([], POSTINGS.struct).agg(metrics.average_posting())
    assert none.select(F.col("average_posting_amount_eur").isNull()).first()[0]
