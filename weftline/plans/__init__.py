"""Registered queries over the given tables, each beside the SQL that checks it."""

from weftline.plans.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
