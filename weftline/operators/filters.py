"""Filters: rules, time windows, typed predicates and bound-parameter SQL."""

from __future__ import annotations

import operator
from collections.abc import Mapping, Sequence
from datetime import date
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_COMPARE = {
    "=": operator.eq, "!=": operator.ne, ">": operator.gt,
    ">=": operator.ge, "<": operator.lt, "<=": operator.le,
}


def apply_rule(
    df: DataFrame, column: str, include: Sequence[str], in_force_on: date | None = None
) -> DataFrame:
    """Rows whose status is included; optionally also in force on a date."""
    if not include:
        raise ValueError("a rule must include at least one status")
    kept = df.where(F.col(column).isin(*include))
    if in_force_on is not None:
        day = F.lit(in_force_on)
        kept = kept.where(
            (F.col("effective_date") <= day)
            & (F.col("expiry_date").isNull() | (F.col("expiry_date") >= day))
        )
    return kept


def last_12_months(column: str, as_of: date) -> Column:
    """From the same day one year earlier up to as_of, both included."""
    return F.col(column).between(F.add_months(F.lit(as_of), -12), F.lit(as_of))


def current_year(column: str, as_of: date) -> Column:
    """From January 1 of as_of's year up to as_of; a range, so that it reaches the scan."""
    return F.col(column).between(F.lit(date(as_of.year, 1, 1)), F.lit(as_of))


def compare(value: Column, op: str, bound: Any) -> Column:
    if op == "IN":
        if not isinstance(bound, (list, tuple, set)) or not bound:
            raise ValueError("IN needs a list of values")
        return value.isin(*bound)
    if op not in _COMPARE:
        raise ValueError(f"unknown operator: {op}")
    return _COMPARE[op](value, F.lit(bound))


def filter_by(df: DataFrame, predicates: Sequence[tuple[str, str, Any]]) -> DataFrame:
    """Rows that meet every (column, operator, value)."""
    conditions = [compare(F.col(name), op, bound) for name, op, bound in predicates]
    return df.where(reduce(operator.and_, conditions)) if conditions else df


def scope_country(df: DataFrame, country: str) -> DataFrame:
    return df.where(F.col("country") == country)


def slot_values(column: str, values: Sequence[str]) -> Column:
    """Membership in the sorted distinct values of one slot."""
    return F.col(column).isin(*sorted(set(values)))


def contains_value(low: str, high: str, value: int) -> Column:
    return F.lit(value).between(F.col(low), F.col(high))


def run_sql(
    spark: SparkSession, sql: str, args: Mapping[str, Any], **frames: DataFrame
) -> DataFrame:
    """Caller SQL over named frames ({name} in the text); values are bound, never pasted in."""
    return spark.sql(sql, args=dict(args), **frames)
