"""Named queries over the driver's tables, each with its DuckDB twin where SQL has one."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from sparkfen.plans.bindings import Bound, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
PARTS = ("membership", "timeline", "relational", "measures", "statistics", "graphs", "sketches", "extras")


def query(name: str, body: str | None = None, *inputs: str) -> Callable:
    """Registers a function of Bound as a query; body and inputs make its SQL."""

    def add(f: Callable[[Bound], DataFrame]) -> Callable[[Bound], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = lambda spark, sf_dir: f(Bound(spark, sf_dir))
        if body:
            ORACLES[name] = sql(body, *inputs)
        return f

    return add


def _load() -> None:
    for part in PARTS:
        import_module(f"sparkfen.plans.{part}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All queries by name."""
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    """The SQL of those that have it."""
    _load()
    return dict(ORACLES)
