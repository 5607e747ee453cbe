"""Richness, diversity, robust means, percentiles, modes, entropy and collapses of rare categories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkfen.operators.ranks import joined, percentiles_of, value_counts
from sparkfen.session import cut


def richness(profiles: DataFrame, cov: int) -> DataFrame:
    """(sample_id, alpha_diversity) at a coverage: the larger of the distinct organisms and taxa."""
    rows = profiles.filter(F.col("cov") >= cov)
    return rows.groupBy("sample_id").agg(F.greatest(F.countDistinct("organism_id"), F.countDistinct("tax_id")).alias("alpha_diversity"))


def richness_by_coverage(profiles: DataFrame, levels: Sequence[int]) -> DataFrame:
    """(sample_id, taxa_coverage_{level}...): distinct taxa at or above each coverage.

    A taxon counts at every level up to its best coverage, so one maximum by (sample, taxon) stands for all levels.
    """
    best = profiles.groupBy("sample_id", "tax_id").agg(F.max("cov").alias("cov"))
    return best.groupBy("sample_id").agg(*[F.count_if(F.col("cov") >= v).alias(f"taxa_coverage_{v}") for v in levels])


def diversity(ko: DataFrame) -> DataFrame:
    """Seven indices of each sample's positive abundances; evenness is null for a single kind."""
    rows = ko.filter("abundance > 0")
    total = rows.groupBy("sample_id").agg(F.sum("abundance").alias("t"))
    p = rows.join(total, "sample_id").withColumn("p", F.col("abundance") / F.col("t"))
    a = p.groupBy("sample_id").agg(F.count("*").alias("richness"), (-F.sum(F.col("p") * F.log("p"))).alias("shannon"), F.sum(F.col("p") * F.col("p")).alias("simpson"), F.max("p").alias("berger_parker"))
    return a.select("sample_id", "richness", "shannon", "simpson", (1 - F.col("simpson")).alias("gini_simpson"), (1 / F.col("simpson")).alias("hill_2"), "berger_parker", F.when(F.col("richness") > 1, F.col("shannon") / F.log(F.col("richness"))).alias("pielou"))


def robust_means(df: DataFrame, by: Sequence[str], x: str, p: float = 0.1) -> DataFrame:
    """By group: n, mean, median, geometric (positive values), trimmed and winsorised mean, sd, sem, iqr and ci95.

    k = floor(p * n) values go at each end; sd, sem and ci95 are null below two values.
    """
    rows = df.filter(F.col(x).isNotNull()).select(*by, F.col(x).cast("double").alias("x"))
    sums = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.exp(F.avg(F.when(F.col("x") > 0, F.log("x")))).alias("geometric"), F.stddev_samp("x").alias("sd"))
    v = cut(value_counts(rows, by, "x"))
    # Of the c equal values at places below + 1 to below + c, those after place k and up to place n - k are inside.
    cells = joined(v, v.groupBy(*by).agg(F.sum("c").alias("n")), by).withColumn("k", F.floor(F.col("n") * p))
    last = F.col("n") - F.col("k")
    held = F.greatest(F.least(F.col("below") + F.col("c"), last) - F.greatest("below", "k"), F.lit(0))
    holds = lambda place: (F.col("below") < place) & (place <= F.col("below") + F.col("c"))
    inner = cells.groupBy(*by).agg(
        F.sum(F.col("x") * held).alias("s"), F.sum(held).alias("m"), F.max("k").alias("k"), F.max("n").alias("n"),
        F.max(F.when(holds(F.col("k") + 1), F.col("x"))).alias("lo"), F.max(F.when(holds(last), F.col("x"))).alias("hi"),
    )
    means = inner.select(*by, F.when(F.col("m") > 0, F.col("s") / F.col("m")).alias("trimmed"), ((F.col("s") + F.col("k") * (F.col("lo") + F.col("hi"))) / F.col("n")).alias("winsorised"))
    q = percentiles_of(v, by, "x", (0.25, 0.5, 0.75)).select(*by, F.col("q1").alias("median"), (F.col("q2") - F.col("q0")).alias("iqr"))
    a = joined(joined(sums, means, by), q, by)
    sem = F.col("sd") / F.sqrt("n")
    return a.withColumns({"sem": sem, "ci95": 1.96 * sem})


def top_counts(df: DataFrame, column: str, n: int) -> DataFrame:
    """The n most frequent values, ties by value."""
    return df.groupBy(column).count().withColumnRenamed("count", "n").orderBy(F.desc("n"), F.asc_nulls_last(column)).limit(n)


def other_below(df: DataFrame, column: str, least: int) -> DataFrame:
    """Counts by value, values with fewer than `least` rows as Other."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    return counts.groupBy(F.when(F.col("n") >= least, F.col(column)).otherwise("Other").alias(column)).agg(F.sum("n").alias("n"))


def top_or_other(df: DataFrame, column: str, n: int, other: str = "other") -> DataFrame:
    """df with values outside the n most frequent replaced. The list of n values is what is joined."""
    top = top_counts(df.filter(F.col(column).isNotNull()), column, n).select(F.col(column).alias("__top"))
    return df.join(top, df[column] == F.col("__top"), "left").withColumn(column, F.coalesce("__top", F.lit(other))).drop("__top")


def modes(df: DataFrame, by: str, column: str) -> DataFrame:
    """(by, value, n_mode, n, mode_frequency) of non-null values: the most frequent, ties by value."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(by, F.col(column).alias("value")).agg(F.count("*").alias("c"))
    best = F.min_by("value", F.struct(-F.col("c"), F.col("value")))
    return counts.groupBy(by).agg(best.alias("value"), F.max("c").alias("n_mode"), F.sum("c").alias("n")).withColumn("mode_frequency", F.col("n_mode") / F.col("n"))


def entropy(df: DataFrame, by: str, column: str) -> DataFrame:
    """(by, n, n_values, entropy): Shannon entropy in bits of the non-null values in each group."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(by, column).agg(F.count("*").alias("c"))
    a = counts.groupBy(by).agg(F.sum("c").alias("n"), F.count("*").alias("n_values"), F.sum(F.col("c") * F.log2("c")).alias("s"))
    return a.select(by, "n", "n_values", F.greatest(F.log2("n") - F.col("s") / F.col("n"), F.lit(0.0)).alias("entropy"))


def histogram(df: DataFrame, x: str, lo: float, hi: float, bins: int) -> DataFrame:
    """(bin, n): equal widths, the last bin closed; values outside are left out."""
    at = F.least(F.floor((F.col(x) - lo) / ((hi - lo) / bins)), F.lit(bins - 1))
    return df.filter(F.col(x).between(lo, hi)).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def density_grid(df: DataFrame, x: str, y: str, wx: float, wy: float) -> DataFrame:
    """(gx, gy, n, log_n): counts on a rectangular grid of non-empty cells."""
    g = df.groupBy(F.floor(F.col(x) / wx).alias("gx"), F.floor(F.col(y) / wy).alias("gy")).agg(F.count("*").alias("n"))
    return g.withColumn("log_n", F.log10("n"))


def listed(by: Sequence[str], df: DataFrame, column: str, most: int = 5) -> DataFrame:
    """(by..., text): 'v(n), v2(n2)' of the most frequent values, then '(+k more)'.

    The counts are ranked by group and only the `most` first are gathered.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(*by, F.col(column).cast("string").alias("v")).agg(F.count("*").alias("c"))
    ranked = counts.withColumns({"i": F.row_number().over(W.partitionBy(*by).orderBy(F.desc("c"), "v")), "m": F.count("*").over(W.partitionBy(*by))}).filter(F.col("i") <= most)
    parts = F.transform(F.sort_array(F.collect_list(F.struct("i", F.concat("v", F.lit("("), F.col("c").cast("string"), F.lit(")")).alias("s")))), lambda s: s["s"])
    more = F.max("m") - most
    return ranked.groupBy(*by).agg(F.concat(F.array_join(parts, ", "), F.when(more > 0, F.concat(F.lit(" (+"), more.cast("string"), F.lit(" more)"))).otherwise("")).alias("text"))
