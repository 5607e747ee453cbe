"""A small filter language: column, operator, value."""

from __future__ import annotations

import logging
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPERATORS = ("!=", ">=", "<=", "=", ">", "<")


def parse(text: str) -> tuple[str, str, str | float] | None:
    """(column, operator, value), the value a number where it reads as one; None for a text without operator."""
    for op in OPERATORS:
        name, found, value = text.partition(op)
        if found:
            value = value.strip()
            try:
                return name.strip(), op, float(value)
            except ValueError:
                return name.strip(), op, value
    return None


def predicate(df: DataFrame, filters: Sequence[str]) -> Column:
    """All filters together. Unknown columns, and order comparisons with a text, are skipped with a warning; != keeps nulls."""
    tests = [F.lit(True)]
    for text in filters:
        got = parse(text)
        if not got or got[0] not in df.columns or (got[1] in (">", "<", ">=", "<=") and isinstance(got[2], str)):
            logging.getLogger(__name__).warning("filter skipped: %s", text)
            continue
        name, op, value = got
        c = F.col(f"`{name}`")
        c = c.try_cast("double") if isinstance(value, float) else c.cast("string")
        tests.append({"=": c == value, "!=": ~c.eqNullSafe(F.lit(value)), ">": c > value, "<": c < value, ">=": c >= value, "<=": c <= value}[op])
    return reduce(lambda a, b: a & b, tests)


def select_samples(meta: DataFrame, least: dict[str, float] | None = None, where: str | None = None, names: Sequence[str] | None = None, column: str = "organism") -> DataFrame:
    """Quality thresholds on the columns that exist, a trusted SQL condition, and a case-blind list of names."""
    for c, v in (least or {}).items():
        if c in meta.columns:
            meta = meta.filter(F.col(c) >= v)
    if where:
        meta = meta.filter(F.expr(where))
    if names is not None:
        wanted = meta.sparkSession.createDataFrame([(n,) for n in sorted({n.lower() for n in names})], "__name string")
        meta = meta.join(wanted, F.lower(column) == F.col("__name"), "left_semi")
    return meta
