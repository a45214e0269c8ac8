from datetime import date

import pytest

from weftline.operators import normalize, quality
from weftline.schemas import BILLING, CONTRACTS, ORDERS, PARTNERS, POSTINGS

AS_OF = date(2026, 8, 28)
GOOD = {
    "business_partners": {"partner_id": "P1", "partner_name": "n", "country": "FR", "email": "e"},
    "sales_orders": {
        "sales_order_id": "O1", "partner_id": "P1", "country": "FR", "product": "auto", "order_status": "RELEASED",
        "effective_date": "2026-01-01", "expiry_date": "2027-01-01", "net_value_eur": "10.5",
    },
    "acdoca_financials": {
        "journal_entry_id": "J1", "sales_order_id": "O1", "partner_id": "P1", "country": "FR", "product": "auto",
        "posting_status": "POSTED", "posting_date": "2026-08-28", "amount_in_company_currency_eur": "0",
    },
    "billing_documents": {
        "billing_doc_id": "B1", "sales_order_id": "O1", "partner_id": "P1", "country": "FR", "product": "auto",
        "billing_date": "2026-01-01", "billed_amount_eur": "1e3",
    },
}


@pytest.fixture(scope="module")
def mappings(spark):
    return spark.createDataFrame(
        [("FranceMap", "1.0.0", "FR"), ("DupA", "1.0.0", "GB"), ("DupB", "1.0.0", "GB")], "mapping_id string, version string, location string"
    )


@pytest.fixture(scope="module")
def products(spark):
    return spark.createDataFrame([("FR", "auto")], "location string, canonical_value string")


def table(spark, contract, *records):
    names = list(contract.columns)
    data = [(n + 2, *[r.get(c) for c in names]) for n, r in enumerate(records)]
    return spark.createDataFrame(data, "row_number bigint, " + ", ".join(f"{c} string" for c in names))


def codes(spark, contract, mappings, products, rows, *changes):
    records = [{**GOOD[contract.name], **change} for change in changes]
    found = quality.table_issues(table(spark, contract, *records), contract, mappings, products, AS_OF)
    return rows(found, "code", "row_number", "field")


def test_clean_tables_pass(spark, mappings, products, rows):
    given = {c.name: table(spark, c, GOOD[c.name]) for c in CONTRACTS}
    report = quality.quality_report(given, mappings, products, AS_OF)
    assert rows(report) == []
    assert rows(quality.quality_score(report)) == [(0, 100, "PASS")]


@pytest.mark.parametrize("value", ["", " ", "null", "None", None])
@pytest.mark.parametrize("contract", CONTRACTS, ids=lambda c: c.name)
def test_missing_keys(spark, mappings, products, rows, contract, value):
    found = codes(spark, contract, mappings, products, rows, {k: value for k in contract.join_keys})
    assert found == sorted((("MISSING_ID", 2, k) for k in contract.join_keys), key=repr)


def test_row_codes(spark, mappings, products, rows):
    found = codes(
        spark, POSTINGS, mappings, products, rows,
        {}, {"journal_entry_id": "J2", "posting_status": "posted"}, {"journal_entry_id": "J3", "posting_date": "2026-08-29"},
        {"journal_entry_id": "J4", "posting_date": "2026-13-01", "amount_in_company_currency_eur": "abc"},
        {"journal_entry_id": "J5", "amount_in_company_currency_eur": "-0.01"}, {"journal_entry_id": "J6", "amount_in_company_currency_eur": "inf"},
        {"journal_entry_id": "J7", "country": "GB"}, {"journal_entry_id": "J8", "product": "old:auto"}, {"journal_entry_id": "J9", "country": None},
    )
    assert found == sorted(
        [
            ("INVALID_STATUS", 3, "posting_status"), ("FUTURE_DATE", 4, "posting_date"), ("INVALID_DATE", 5, "posting_date"),
            ("INVALID_NUMBER", 5, "amount_in_company_currency_eur"), ("NEGATIVE_LOSS", 6, "amount_in_company_currency_eur"),
            ("NONFINITE_VALUE", 7, "amount_in_company_currency_eur"), ("INVALID_COUNTRY", 8, "country"), ("INVALID_PRODUCT_MAPPING", 8, "product"),
            ("INVALID_PRODUCT_MAPPING", 9, "product"), ("INVALID_COUNTRY", 10, "country"), ("INVALID_PRODUCT_MAPPING", 10, "product"),
        ],
        key=repr,
    )


def test_first_duplicate_passes(spark, mappings, products, rows):
    found = codes(spark, ORDERS, mappings, products, rows, {}, {"sales_order_id": " O1 "}, {"sales_order_id": "O2"}, {})
    assert found == [("DUPLICATE_ID", 3, "sales_order_id"), ("DUPLICATE_ID", 5, "sales_order_id")]


def test_duplicates_of_hot_and_colliding_keys(spark, rows):
    """A key on a third of all rows, blanks around keys, missing ones; and keys seen once are not shuffled."""
    given = [(i, "hot") for i in range(400)] + [(1000 + i, f" k{i % 500}\u00a0") for i in range(700)] + [(5000 + i, [None, "", "NULL", " none "][i % 4]) for i in range(40)]
    frame = spark.createDataFrame(given, "row_number long, id string").repartition(5)
    found = quality.duplicate_rows(frame, "id")
    expected = [("hot", i) for i in range(1, 400)] + [(f"k{i}", 1500 + i) for i in range(200)]
    assert rows(found, "id", "row_number") == sorted(expected, key=repr)
    assert quality.duplicate_rows(frame.limit(0), "id").count() == 0
    once = spark.createDataFrame([(i, f"only{i}") for i in range(300)], "row_number long, id string")
    assert quality.duplicate_rows(once, "id").count() == 0


def test_rows_of_an_identifier_that_share_a_number(spark, rows):
    """One of the rows in the first place passes, wherever the others are."""
    given = [(7, "a"), (7, "a"), (7, "a"), (9, "a"), (3, "b"), (4, "b"), (4, "b"), (5, "c")]
    frame = spark.createDataFrame(given, "row_number long, id string").repartition(3)
    assert rows(quality.duplicate_rows(frame, "id"), "id", "row_number") == [("a", 7), ("a", 7), ("a", 9), ("b", 4), ("b", 4)]


def test_identifiers_that_share_a_digest(spark, rows, monkeypatch):
    monkeypatch.setattr(quality.F, "xxhash64", lambda *c: quality.F.length(c[0]).cast("long"))
    frame = spark.createDataFrame([(1, "ab"), (2, "cd"), (3, "ab"), (4, "efg")], "row_number long, id string")
    assert rows(quality.duplicate_rows(frame, "id"), "id", "row_number") == [("ab", 3)]


def test_structure(spark, mappings, products, rows):
    given = {
        "business_partners": table(spark, PARTNERS).where("false"), "sales_orders": table(spark, ORDERS, GOOD["sales_orders"]).drop("order_status"),
        "billing_documents": table(spark, BILLING, GOOD["billing_documents"]),
    }
    report = quality.quality_report(given, mappings, products, AS_OF)
    assert rows(report, "code", "file", "row_number", "field") == sorted(
        [
            ("MISSING_EXPECTED_DATASET", "acdoca_financials", 0, "path"), ("MISSING_SCHEMA_FIELD", "sales_orders", 1, "order_status"),
            ("EMPTY_EXPECTED_DATASET", "business_partners", 1, "path"), ("INVALID_STATUS", "sales_orders", 2, "order_status"),
        ],
        key=repr,
    )
    assert rows(quality.quality_score(report)) == [(4, 96, "FAIL")]


def test_curate_keeps_reasons(spark, mappings, products, rows):
    raw = table(spark, ORDERS, GOOD["sales_orders"], {**GOOD["sales_orders"], "sales_order_id": "O2", "net_value_eur": "-1"})
    report = quality.quality_report({"sales_orders": raw}, mappings, products, AS_OF, contracts=(ORDERS,))
    curated, quarantined = quality.curate(raw, report, "sales_orders")
    assert rows(curated, "sales_order_id") == [("O1",)]
    assert rows(quarantined, "sales_order_id", "reasons") == [("O2", ["NEGATIVE_LOSS:net_value_eur"])]


def test_value_lookup_fails_closed(spark, rows):
    value_map = spark.createDataFrame(
        [("Fabric", "statuses", "STORNIERT", "REVERSED"), ("Fabric", "order_statuses", "STORNIERT", "CANCELLED"), ("Fabric", "statuses", "X", "a"), ("Fabric", "statuses", "x ", "b")],
        "platform string, kind string, local_value string, canonical_value string",
    )
    data = spark.createDataFrame([(1, " storniert"), (2, "UNKNOWN"), (3, None), (4, "X")], "id int, v string")
    ok, rejected = normalize.normalize_values(data, value_map, "statuses", "v", " FABRIC ")
    assert rows(ok) == [(1, "REVERSED")]
    assert rows(rejected, "id", "reason") == [(2, "UNMAPPED_VALUE"), (3, "UNMAPPED_VALUE"), (4, "AMBIGUOUS_VALUE")]
    assert rows(normalize.normalize_values(data, value_map, "order_statuses", "v", "fabric")[0]) == [(1, "CANCELLED")]


def test_pii(spark, rows):
    fields = spark.createDataFrame(
        [("FR", "email", "c:Partner", True), ("DE", "phone", "c:Partner", True), ("FR", "amount", "c:Loss", False)],
        "location string, canonical string, concept string, pii boolean",
    )
    projected = spark.createDataFrame([("c:Partner",), ("c:Loss",)], "concept string")
    assert rows(normalize.pii_columns(fields, projected, ["FR"])) == [("email",)]
    assert rows(normalize.pii_columns(fields, projected)) == [("email",), ("phone",)]
    frame = spark.createDataFrame([("x", 1)], "email string, amount int")
    assert normalize.project_without_pii(frame, ["email", "phone"]).columns == ["amount"]
    with pytest.raises(PermissionError):
        normalize.project_without_pii(frame, ["email"], refuse=True)


def test_structure_compares_no_identifier(spark, rows, monkeypatch):
    """Missing and empty tables show without a look for repeated identifiers."""
    from weftline.plans import registry

    def refused(*_, **__):
        raise AssertionError("identifiers compared")

    monkeypatch.setattr(quality, "duplicate_rows", refused)
    found = rows(registry.queries()["h01_structure"](spark, "/root/testdata/sf0.001"), "code", "file")
    assert ("EMPTY_EXPECTED_DATASET", "business_partners") in found and len(found) == 5
