"""All core queries by name, with their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rolloutlake.plans import advantages, building, extra, frames, messaging, samples, similarities, texts, tokens_plan, voting

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

for _module in (advantages, frames, samples, voting, tokens_plan, texts, similarities, building, messaging, extra):
    for _name, (_query, _sql) in _module.CATALOG.items():
        if _name in QUERIES:
            raise ValueError(f"query {_name} is registered twice")
        QUERIES[_name] = _query
        if _sql is not None:
            ORACLE[_name] = _sql
