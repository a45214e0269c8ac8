"""Conforming source tables: value lookup, renaming, stacking, PII and projection checks."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import fold_case, strip


def _lookup_key(value: Column) -> Column:
    return fold_case(strip(value))


def normalize_values(
    df: DataFrame,
    value_map: DataFrame,
    kind: str,
    column: str,
    platform: str | Column,
    registered: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Replace local codes by canonical values; returns (ok, rejected).

    value_map has platform, kind, local_value, canonical_value. A code without an entry, or
    whose canonical value is not among the registered ones (column "id"), is rejected with a
    reason and keeps its local value.
    """
    marked = mark_values(df, value_map, kind, column, platform, registered)
    ok = marked.where(F.col("reason").isNull()).withColumn(column, F.col("canonical_value"))
    rejected = marked.where(F.col("reason").isNotNull())
    return ok.drop("canonical_value", "reason"), rejected.drop("canonical_value")


def mark_values(
    df: DataFrame,
    value_map: DataFrame,
    kind: str,
    column: str,
    platform: str | Column,
    registered: DataFrame | None = None,
) -> DataFrame:
    """The rows with canonical_value and, where the lookup fails, a reason. Row-local."""
    entries = value_map.where(F.col("kind") == kind).select(
        _lookup_key(F.col("platform")).alias("_platform"),
        _lookup_key(F.col("local_value")).alias("_local"),
        F.col("canonical_value").alias("_canonical"),
    )
    entries = entries.groupBy("_platform", "_local").agg(
        F.min("_canonical").alias("_canonical"), F.count_distinct("_canonical").alias("_targets")
    )
    if registered is not None:
        known = registered.select(F.col("id").alias("_canonical"), F.lit(True).alias("_known"))
        entries = entries.join(known.distinct(), "_canonical", "left")
    else:
        entries = entries.withColumn("_known", F.lit(True))
    wanted = F.lit(platform) if isinstance(platform, str) else platform
    keyed = df.withColumn("_platform", _lookup_key(wanted)).withColumn(
        "_local", _lookup_key(F.col(column))
    )
    reason = (
        F.when(F.col("_canonical").isNull(), "UNMAPPED_VALUE")
        .when(F.col("_targets") > 1, "AMBIGUOUS_VALUE")
        .when(F.col("_known").isNull(), "UNREGISTERED_TARGET")
    )
    joined = keyed.join(entries, ["_platform", "_local"], "left")
    return joined.select(
        *df.columns, F.when(reason.isNull(), F.col("_canonical")).alias("canonical_value"),
        reason.alias("reason"),
    )


def conform(df: DataFrame, renames: Mapping[str, str]) -> DataFrame:
    """Select the mapped physical columns under their canonical names ({canonical: physical})."""
    missing = sorted(set(renames.values()) - set(df.columns))
    if missing:
        raise ValueError(f"mapped columns are missing: {missing}")
    return df.select(*[F.col(physical).alias(name) for name, physical in renames.items()])


def federate(sources: Mapping[str, DataFrame]) -> DataFrame:
    """Stack conformed sources, tagging each row with its country."""
    stacked: DataFrame | None = None
    for country, df in sources.items():
        tagged = df.withColumn("country", F.lit(country))
        stacked = tagged if stacked is None else stacked.unionByName(tagged)
    if stacked is None:
        raise ValueError("no sources to stack")
    return stacked


def pii_columns(
    mapping_fields: DataFrame, projected: DataFrame, countries: Sequence[str] | None = None
) -> DataFrame:
    """Canonical columns marked as PII whose concept is projected, in the given countries.

    mapping_fields has location, canonical, concept, pii; projected has concept. Without
    countries every mapping counts.
    """
    fields = mapping_fields.where("pii")
    if countries:
        fields = fields.where(F.col("location").isin(*countries))
    return fields.join(projected.select("concept"), "concept", "left_semi").select(
        F.col("canonical").alias("column")
    ).distinct()


def project_without_pii(df: DataFrame, pii: Iterable[str], refuse: bool = False) -> DataFrame:
    """Drop the PII columns, or refuse a frame that carries any."""
    present = sorted(set(pii) & set(df.columns))
    if present and refuse:
        raise PermissionError(f"PII columns may not be read: {present}")
    return df.drop(*present)


def projection_report(df: DataFrame, required: Sequence[str], optional: Sequence[str]) -> DataFrame:
    """Per output column: whether it is required, its null count and whether it passes."""
    nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in (*required, *optional)])
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(c in required).alias("required"),
            F.col(c).alias("nulls"),
            ((F.col(c) == 0) | F.lit(c not in required)).alias("complete"),
        )
        for c in (*required, *optional)
    ]
    return nulls.select(F.inline(F.array(*rows)))


def complete_rows(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Rows whose required columns are all bound."""
    return df.na.drop(subset=list(required))
