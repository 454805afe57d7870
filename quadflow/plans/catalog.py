"""Registry of named queries: a Spark plan and (where expressible) its SQL oracle.

Each entry takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
whole test tables. The oracle SQL is written independently against the
campus CTEs of ``quadflow.plans.domain_sql`` and run by DuckDB.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quadflow.plans.domain_sql import with_domain
from quadflow.sources.domain import Campus
from quadflow.sources.requests import Requests

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[QueryFn, str | None]] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[Campus, Requests], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            campus = Campus(spark, sf_dir)
            return fn(campus, Requests(campus))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        REGISTRY[name] = (run, sql)
        return fn
    return register


def queries() -> dict[str, QueryFn]:
    _load()
    return {name: fn for name, (fn, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {name: with_domain(sql) for name, (_, sql) in REGISTRY.items() if sql is not None}


def _load() -> None:
    # Importing the modules registers their queries.
    from quadflow.plans import q_lists, q_quality, q_reports, q_transitions  # noqa: F401
