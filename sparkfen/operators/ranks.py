"""Ranks, running sums and percentiles that no single task computes.

A plain window over one key, or over none, sorts all its rows in one task. Here rows are first dealt into ranges of the
ordering value, whose sums give each range its start; only rows of one range meet in a task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkfen.session import cut

#: Least and most ranges of the ordering value, and the rows for which one more is made. Each range has about the same number of rows.
PARTS, MOST_PARTS, ROWS_A_PART = 256, 16_384, 2_000_000


def parts_for(rows: int) -> int:
    """How many ranges so many rows are dealt into: the number grows with the data."""
    return max(PARTS, min(MOST_PARTS, rows // ROWS_A_PART))


def joined(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """The two frames joined on the columns `by`, in which a null equals a null; without any, right is one row."""
    if not by:
        return left.crossJoin(F.broadcast(right))
    renamed = right.withColumnsRenamed({k: f"__right_{k}" for k in by})
    same = [F.col(k).eqNullSafe(F.col(f"__right_{k}")) for k in by]
    return left.join(renamed, same, how).drop(*[f"__right_{k}" for k in by])


def ranged(df: DataFrame, x: str, name: str, parts: int = PARTS) -> DataFrame:
    """df with the number of the range of x, in ascending order, that each row is in (-1 for a null). Equal values share one."""
    kind = dict(df.dtypes)[x]
    if kind == "string" or kind.startswith(("struct", "array", "map")):
        raise ValueError("the ordering value must be a number or a date")
    shares = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    edges = df.agg(F.array_distinct(F.percentile_approx(x, shares, F.lit(max(10_000, 20 * parts)))).alias("__edges"))
    # A binary search for the number of edges below x; beyond the last edge get() is null, so nothing is added.
    steps = F.array(*[F.lit(1 << i) for i in reversed(range((parts - 1).bit_length()))])
    at = F.aggregate(steps, F.lit(0), lambda n, step: F.when(F.get("__edges", n + step - 1) < F.col(x), n + step).otherwise(n))
    return df.crossJoin(F.broadcast(edges)).withColumn(name, F.when(F.col(x).isNull(), -1).otherwise(F.coalesce(at, F.lit(0)))).drop("__edges")


def value_counts(df: DataFrame, by: Sequence[str], x: str, extra: Sequence[Column] = (), parts: int | None = None) -> DataFrame:
    """(by..., x, c, extra..., below): how often each value occurs in its group, and how many smaller ones there are (nulls left out)."""
    counts = cut(df.filter(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count("*").alias("c"), *extra))
    placed = ranged(counts, x, "__part", parts or parts_for(counts.count()))
    sums = placed.groupBy(*by, "__part").agg(F.sum("c").alias("__pc"))
    before = sums.withColumn("__base", F.sum("__pc").over(W.partitionBy(*by).orderBy("__part")) - F.col("__pc")).drop("__pc")
    inside = F.sum("c").over(W.partitionBy(*by, "__part").orderBy(x)) - F.col("c")
    ranked = joined(placed.withColumn("__inside", inside), before, [*by, "__part"])
    return ranked.withColumn("below", F.col("__base") + F.col("__inside")).drop("__part", "__base", "__inside")


def least_above(df: DataFrame, by: Sequence[str], x: str, value: str, name: str, parts: int | None = None) -> DataFrame:
    """df with the least `value` among the rows of its group whose x is that of the row or larger (x is never null).

    A running minimum from above: in each range of x, and over the minima of the ranges after it.
    """
    df = cut(df)
    placed = ranged(df, x, "__part", parts or parts_for(df.count()))
    least = placed.groupBy(*by, "__part").agg(F.min(value).alias("__least"))
    later = W.partitionBy(*by).orderBy(F.desc("__part")).rowsBetween(W.unboundedPreceding, -1)
    after = least.withColumn("__after", F.min("__least").over(later)).drop("__least")
    inside = F.min(value).over(W.partitionBy(*by, "__part").orderBy(F.desc(x)))
    out = joined(placed.withColumn("__inside", inside), after, [*by, "__part"])
    return out.withColumn(name, F.least("__inside", "__after")).drop("__part", "__inside", "__after")


def at_positions(df: DataFrame, by: Sequence[str], x: str, positions: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """(by..., n, names...): the values at positions (from 0) of each group in ascending order; a position is a function of its n."""
    v = cut(value_counts(df, by, x))
    rows = joined(v, v.groupBy(*by).agg(F.sum("c").alias("n")), by)
    low, high, n = F.col("below"), F.col("below") + F.col("c") - 1, F.col("n")
    return rows.groupBy(*by).agg(F.max("n").alias("n"), *[F.max(F.when((low <= at(n)) & (at(n) <= high), F.col(x))).alias(k) for k, at in positions.items()])


def percentiles(df: DataFrame, by: Sequence[str], x: str, shares: Sequence[float]) -> DataFrame:
    """(by..., n, q0, q1...): exact percentiles of each group, interpolated between neighbours, from counts by value."""
    return percentiles_of(cut(value_counts(df, by, x)), by, x, shares)


def percentiles_of(v: DataFrame, by: Sequence[str], x: str, shares: Sequence[float]) -> DataFrame:
    """percentiles() from a written table of value_counts()."""
    totals = v.groupBy(*by).agg(F.sum("c").alias("n"))
    rows = joined(v, totals, by)
    last, low, high = F.col("n") - 1, F.col("below"), F.col("below") + F.col("c") - 1
    aggs = []
    for i, q in enumerate(shares):
        at = last * F.lit(float(q))
        lo, hi = F.floor(at), F.ceil(at)
        value = lambda k: F.max(F.when((low <= k) & (k <= high), F.col(x).cast("double")))
        aggs += [value(lo).alias(f"__lo{i}"), value(hi).alias(f"__hi{i}"), F.max(at - lo).alias(f"__w{i}")]
    a = rows.groupBy(*by).agg(F.max("n").alias("n"), *aggs)
    mixed = lambda i: F.when((F.col(f"__w{i}") == 0) | (F.col(f"__lo{i}") == F.col(f"__hi{i}")), F.col(f"__lo{i}")).otherwise(F.col(f"__lo{i}") * (1 - F.col(f"__w{i}")) + F.col(f"__hi{i}") * F.col(f"__w{i}"))
    return a.select(*by, "n", *[mixed(i).alias(f"q{i}") for i in range(len(shares))])


def mid_ranks(df: DataFrame, by: Sequence[str], x: str, name: str) -> DataFrame:
    """df with the rank of x in its group, ties at their mean; null for a null."""
    v = value_counts(df, by, x)
    ranks = v.select(*by, x, (F.col("below") + (F.col("c") + 1) / 2).alias(name))
    return joined(df, ranks, [*by, x], "left")


def ordinal(df: DataFrame, by: Sequence[str], key: str, name: str, weight: Column | None = None, then: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    """df with the position (from 1) of each row in its group by a numeric key, ties by the columns `then`; or, with a weight, the
    sum of the weights up to and with the row. Rows of one key value meet in a task."""
    w = F.lit(1).cast("long") if weight is None else weight
    placed = ranged(df.withColumn("__w", w), key, "__part", parts or parts_for(df.count()))
    sums = placed.groupBy(*by, "__part").agg(F.sum("__w").alias("__pw"))
    before = sums.withColumn("__base", F.sum("__pw").over(W.partitionBy(*by).orderBy("__part")) - F.col("__pw")).drop("__pw")
    inside = F.sum("__w").over(W.partitionBy(*by, "__part").orderBy(key, *then).rowsBetween(W.unboundedPreceding, 0))
    out = joined(placed.withColumn("__inside", inside), before, [*by, "__part"])
    return out.withColumn(name, F.col("__base") + F.col("__inside")).drop("__w", "__part", "__base", "__inside")
