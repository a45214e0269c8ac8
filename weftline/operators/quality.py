"""Row-level quality gates, the issue report and the curated / quarantined split."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.text import fold_case, iso_date, strip
from weftline.schemas import CONTRACTS, COUNTRIES, TableContract
from weftline.session import literal_rows, written

# Identifier texts that count as missing.
MISSING_IDENTIFIERS = ("", "null", "none")

# How a number may be written.
_DIGITS = r"\d+(?:_\d+)*"
NUMBER = rf"(?i)\A[+-]?(?:(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:e[+-]?{_DIGITS})?|inf|infinity|nan)\z"

# Issue messages.
MESSAGES = {
    "MISSING_EXPECTED_DATASET": "required table is missing",
    "MISSING_SCHEMA_FIELD": "required column is missing",
    "EMPTY_EXPECTED_DATASET": "table has no rows",
    "MISSING_ID": "identifier is required",
    "DUPLICATE_ID": "identifier is duplicate",
    "INVALID_COUNTRY": "unknown country",
    "INVALID_PRODUCT_MAPPING": "product is not mapped for the row's country",
    "INVALID_STATUS": "unknown status",
    "INVALID_DATE": "date must be ISO-8601",
    "FUTURE_DATE": "date is after the as-of date",
    "INVALID_NUMBER": "value is not numeric",
    "NONFINITE_VALUE": "value must be finite",
    "NEGATIVE_LOSS": "value is negative",
}
ISSUE_SCHEMA = "code string, file string, row_number bigint, field string, message string"


def is_missing(value: Column) -> Column:
    stripped = strip(F.coalesce(value, F.lit("")))
    # No longer text folds to one of these.
    longest = max(map(len, MISSING_IDENTIFIERS))
    return (F.length(stripped) <= longest) & fold_case(stripped).isin(*MISSING_IDENTIFIERS)


def _issue(code: str, field: str, condition: Column) -> Column:
    return F.when(
        condition,
        F.struct(
            F.lit(code).alias("code"), F.lit(field).alias("field"), F.lit(MESSAGES[code]).alias("message")
        ),
    )


def identifier_issues(contract: TableContract) -> list[Column]:
    return [_issue("MISSING_ID", c, is_missing(F.col(c))) for c in contract.join_keys]


def status_issues(contract: TableContract) -> list[Column]:
    if contract.status is None:
        return []
    column, domain = contract.status
    return [_issue("INVALID_STATUS", column, ~F.coalesce(F.col(column).isin(*domain), F.lit(False)))]


def _once(value: Column, use) -> Column:
    """use(value) with the value computed once per row."""
    return F.transform(F.array(value), use)[0]


def date_issue(column: str, as_of: date) -> Column:
    def judge(day: Column) -> Column:
        return F.coalesce(
            _issue("INVALID_DATE", column, day.isNull()), _issue("FUTURE_DATE", column, day > F.lit(as_of))
        )

    return _once(iso_date(F.coalesce(F.col(column), F.lit(""))), judge)


def number_issue(column: str) -> Column:
    """Not a number, not finite or negative: the first that holds."""

    def judge(number: Column) -> Column:
        return F.coalesce(
            _issue("INVALID_NUMBER", column, number.isNull()),
            _issue("NONFINITE_VALUE", column, F.isnan(number) | (F.abs(number) == float("inf"))),
            _issue("NEGATIVE_LOSS", column, number < 0),
        )

    written = strip(F.coalesce(F.col(column), F.lit("")))
    return _once(F.when(F.rlike(written, F.lit(NUMBER)), F.replace(written, F.lit("_"), F.lit("")).try_cast("double")), judge)


def country_issues(has_product: bool) -> list[Column]:
    """Needs mapping_evidence and _product_ok from attach_mapping."""
    bad_country = F.col("mapping_evidence").isNull()
    issues = [_issue("INVALID_COUNTRY", "country", bad_country)]
    if has_product:
        no_product = F.col("product").isNotNull() & (
            bad_country | ~F.coalesce(F.col("_product_ok"), F.lit(False))
        )
        issues.append(_issue("INVALID_PRODUCT_MAPPING", "product", no_product))
    return issues


def attach_mapping(
    rows: DataFrame,
    mappings: DataFrame,
    product_map: DataFrame,
    countries: Sequence[str] = COUNTRIES,
) -> DataFrame:
    """Add mapping_evidence (id@version) and whether the product is mapped for the country.

    mappings has mapping_id, version, location; a country with several mappings has none.
    product_map has location and canonical_value, registered targets only.
    """
    unique = (
        mappings.where(F.col("location").isin(*countries))
        .groupBy(F.col("location").alias("country"))
        .agg(
            F.count(F.lit(1)).alias("_mappings"),
            F.min(F.concat_ws("@", "mapping_id", "version")).alias("mapping_evidence"),
        )
        .where("_mappings = 1")
        .drop("_mappings")
    )
    tagged = rows.join(unique, "country", "left")
    if "product" not in rows.columns:
        return tagged
    known = product_map.select(
        F.col("location").alias("country"), F.col("canonical_value").alias("product")
    ).distinct()
    known = known.withColumn("_product_ok", F.lit(True))
    return tagged.join(known, ["country", "product"], "left")


def row_issues(contract: TableContract, as_of: date, has_product: bool = True) -> Column:
    """The issues of one row as an array; every check runs and none stops the rest."""
    checks = [
        *identifier_issues(contract),
        *country_issues(has_product),
        *status_issues(contract),
        *[date_issue(c, as_of) for c in contract.dates],
        *[number_issue(c) for c in contract.amounts],
    ]
    return F.array_compact(F.array(*checks))


def duplicate_rows(rows: DataFrame, key: str, order: str = "row_number") -> DataFrame:
    """Second and later rows of an identifier (key, order); the first row passes, and of several that share the first place one does.

    Identifiers seen once never leave their task: only eight-byte digests, counted in the task before, are
    shuffled. Rows whose digest repeats are written, which runs jobs, and compared by the identifier itself, so two
    identifiers with one digest are told apart. Both sides of the last join are bare shuffles of
    written rows, so that a key on a third of the rows is split over tasks.
    """
    digest = F.xxhash64(strip(F.coalesce(F.col(key), F.lit(""))))
    counted = rows.groupBy(digest.alias("_digest")).agg(
        F.count(F.lit(1)).alias("_seen"), F.min(is_missing(F.col(key)).cast("int")).alias("_missing")
    )
    seen = counted.where("_seen > 1 AND _missing = 0").select("_digest")
    digested = rows.select(strip(F.col(key)).alias(key), F.col(order).alias(order), digest.alias("_digest"))
    repeated = digested.join(written(seen, "digests"), "_digest", "left_semi").select(key, order)
    candidates = written(repeated.withColumn("_at", F.monotonically_increasing_id()), "repeated")
    candidates = candidates.where(~is_missing(F.col(key)))
    first = candidates.groupBy(F.col(key).alias("_key")).agg(F.min_by("_at", order).alias("_first"), F.count(F.lit(1)).alias("_rows"))
    first = written(first.where("_rows > 1").select("_key", "_first"), "first")
    joined = candidates.join(first, F.col(key) == F.col("_key"))
    return joined.where(~F.col("_at").eqNullSafe(F.col("_first"))).select(key, order)


def structure_issues(tables: Mapping[str, DataFrame], contracts: Sequence[TableContract] = CONTRACTS):
    """Missing tables and columns, from names alone: (code, file, row_number, field) tuples."""
    issues = []
    for contract in contracts:
        if contract.name not in tables:
            issues.append(("MISSING_EXPECTED_DATASET", contract.name, 0, "path"))
            continue
        for column in sorted(set(contract.columns) - set(tables[contract.name].columns)):
            issues.append(("MISSING_SCHEMA_FIELD", contract.name, 1, column))
    return issues


def _labelled(code: str, name: str, row_number: Column, field: str) -> list[Column]:
    return [
        F.lit(code).alias("code"), F.lit(name).alias("file"),
        row_number.cast("bigint").alias("row_number"), F.lit(field).alias("field"),
        F.lit(MESSAGES[code]).alias("message"),
    ]


def row_level_issues(
    rows: DataFrame,
    contract: TableContract,
    mappings: DataFrame,
    product_map: DataFrame,
    as_of: date,
    countries: Sequence[str] = COUNTRIES,
) -> DataFrame:
    """Issues that each raw row shows on its own; works on streaming rows as well."""
    tagged = attach_mapping(_with_contract_columns(rows, contract), mappings, product_map, countries)
    return tagged.select(
        F.lit(contract.name).alias("file"),
        F.col("row_number").cast("bigint").alias("row_number"),
        F.inline(row_issues(contract, as_of, "product" in rows.columns)),
    ).select("code", "file", "row_number", "field", "message")


def _with_contract_columns(rows: DataFrame, contract: TableContract) -> DataFrame:
    """The rows with every checked column; an absent one is null and fails its checks."""
    absent = [c for c in contract.columns if c not in rows.columns and c != "product"]
    return rows.withColumns({c: F.lit(None).cast("string") for c in absent})


def table_issues(
    rows: DataFrame,
    contract: TableContract,
    mappings: DataFrame,
    product_map: DataFrame,
    as_of: date,
    countries: Sequence[str] = COUNTRIES,
) -> DataFrame:
    """Issues of the rows of one raw table (all texts, with row_number).

    Repeated identifiers are found first, from their rows alone; every other issue shows in one read of the
    rows, which are not shuffled.
    """
    present = _with_contract_columns(rows, contract)
    found = row_level_issues(rows, contract, mappings, product_map, as_of, countries)
    again = duplicate_rows(present, contract.key).select(
        *_labelled("DUPLICATE_ID", contract.name, F.col("row_number"), contract.key)
    )
    return found.unionByName(again)


def empty_issues(rows: DataFrame, contract: TableContract) -> DataFrame:
    """One issue if the table has no row."""
    none = rows.select(F.lit(1)).limit(1).agg(F.count(F.lit(1)).alias("n")).where("n = 0")
    return none.select(*_labelled("EMPTY_EXPECTED_DATASET", contract.name, F.lit(1), "path"))


def structure_report(
    spark: SparkSession, tables: Mapping[str, DataFrame], contracts: Sequence[TableContract] = CONTRACTS
) -> DataFrame:
    """The issues of tables as such: missing ones, missing columns and empty ones.

    Values are not looked at: no identifier is compared and no row written.
    """
    structural = [
        (code, name, row, field, MESSAGES[code])
        for code, name, row, field in structure_issues(tables, contracts)
    ]
    report = literal_rows(spark, structural, ISSUE_SCHEMA)
    for contract in contracts:
        if contract.name in tables:
            report = report.unionByName(empty_issues(tables[contract.name], contract))
    return report


def quality_report(
    tables: Mapping[str, DataFrame],
    mappings: DataFrame,
    product_map: DataFrame,
    as_of: date,
    contracts: Sequence[TableContract] = CONTRACTS,
    countries: Sequence[str] = COUNTRIES,
) -> DataFrame:
    """All issues of all expected tables: (code, file, row_number, field, message)."""
    report = structure_report(mappings.sparkSession, tables, contracts)
    for contract in contracts:
        if contract.name in tables:
            report = report.unionByName(
                table_issues(tables[contract.name], contract, mappings, product_map, as_of, countries)
            )
    return report


def quality_score(report: DataFrame) -> DataFrame:
    """One row: issue count, score of at least zero and PASS only without issues."""
    return report.agg(F.count(F.lit(1)).alias("issues")).select(
        "issues",
        F.greatest(F.lit(0).cast("bigint"), F.lit(100) - F.col("issues")).alias("score"),
        F.when(F.col("issues") == 0, "PASS").otherwise("FAIL").alias("status"),
    )


def curate(rows: DataFrame, report: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Split a raw table into rows without issues and quarantined rows with their reasons."""
    issues = report.where(F.col("file") == name).select("row_number", "code", "field")
    reasons = issues.groupBy("row_number").agg(
        F.array_sort(F.collect_set(F.concat_ws(":", "code", "field"))).alias("reasons")
    )
    curated = rows.join(reasons, "row_number", "left_anti")
    return curated, rows.join(reasons, "row_number")


def mapping_evidence(
    rows: DataFrame, mappings: DataFrame, name: str, countries: Sequence[str] = COUNTRIES
) -> DataFrame:
    """Per row with a valid country, the mapping id and version it was checked against."""
    tagged = attach_mapping(rows.select("row_number", "country"), mappings, mappings, countries)
    return tagged.where(F.col("mapping_evidence").isNotNull()).select(
        F.lit(name).alias("file"), "row_number", "mapping_evidence"
    )
