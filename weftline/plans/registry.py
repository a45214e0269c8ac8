"""The register of queries and their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.plans.tables import Tables

Plan = Callable[[Tables], DataFrame]

_PLANS: dict[str, Plan] = {}
_SQL: dict[str, str] = {}
_MODULES = ("business", "conforming", "quality", "graphs", "search", "shapes", "texts", "governance", "evaluation")


def register(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    """Register a query under its operator key; without SQL only its rows are checked."""

    def add(plan: Plan) -> Plan:
        if name in _PLANS:
            raise ValueError(f"registered twice: {name}")
        _PLANS[name] = plan
        if sql is not None:
            _SQL[name] = sql
        return plan

    return add


def _load() -> None:
    for module in _MODULES:
        importlib.import_module(f"weftline.plans.{module}")


def _bind(plan: Plan) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: plan(Tables(spark, folder))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {name: _bind(plan) for name, plan in sorted(_PLANS.items())}


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(sorted(_SQL.items()))
