"""All registered queries of the engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loamstone.plans import governance_queries, job_queries, memory_queries
from loamstone.plans.bridge import duck

FLAGSHIP = "planned_packs"
_MODULES = (memory_queries, governance_queries, job_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: duck(s) for m in _MODULES for k, s in m.SQL.items()}
