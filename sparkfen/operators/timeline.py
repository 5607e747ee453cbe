"""First and last sightings of hashes, novelty of samples and survival."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkfen.operators.membership import ratio
from sparkfen.operators.ranks import joined, percentiles
from sparkfen.session import cut


def hash_life(sig: DataFrame, years: DataFrame) -> DataFrame:
    """(min_hash, birth_year, death_year) over samples with a year (acc, release_year)."""
    dated = sig.join(years.select(F.col("acc").alias("sample_id"), "release_year"), "sample_id")
    return dated.groupBy("min_hash").agg(F.min("release_year").alias("birth_year"), F.max("release_year").alias("death_year"))


def sample_novelty(sig: DataFrame, years: DataFrame, life: DataFrame) -> DataFrame:
    """(sample_id, release_year, total_hashes, new_hashes, fraction_new): new if first seen in the sample's own year."""
    dated = sig.join(years.select(F.col("acc").alias("sample_id"), "release_year"), "sample_id").join(life.select("min_hash", "birth_year"), "min_hash")
    return _novelty(dated)


def own_novelty(lines: DataFrame, years: DataFrame, rows: int, rows_a_part: int = 500_000) -> DataFrame:
    """sample_novelty() with the life that the hashes have in these samples.

    lines: (sample_id, min_hash), repeated rows count once. Its `rows` are dealt into parts of about `rows_a_part`, by sample and then by
    hash, so that what a task holds does not grow with the input; numbers of partitions that are given are not reduced.
    """
    parts = max(lines.sparkSession.sparkContext.defaultParallelism, -(-rows // rows_a_part))
    sig = lines.select("sample_id", "min_hash").filter("min_hash is not null").repartition(parts, "sample_id").distinct()
    dated = sig.join(years.select(F.col("acc").alias("sample_id"), "release_year").repartition(parts, "sample_id"), "sample_id")
    return _novelty(dated.repartition(parts, "min_hash").withColumn("birth_year", F.min("release_year").over(W.partitionBy("min_hash"))))


def _novelty(dated: DataFrame) -> DataFrame:
    new = F.count_if(F.col("birth_year") == F.col("release_year"))
    return dated.groupBy("sample_id", "release_year").agg(F.count("*").alias("total_hashes"), new.alias("new_hashes"), ratio(new, F.count("*")).alias("fraction_new"))


def cumulative_by_year(life: DataFrame) -> DataFrame:
    """(year, new_hashes, cumulative_hashes). The running sum sees one row a year."""
    yearly = life.groupBy(F.col("birth_year").alias("year")).agg(F.count("*").alias("new_hashes"))
    return yearly.withColumn("cumulative_hashes", F.sum("new_hashes").over(W.orderBy("year").rowsBetween(W.unboundedPreceding, 0)))


def yearly_novelty(stats: DataFrame) -> DataFrame:
    """By year: n_samples, averages and exact percentiles of new_hashes and fraction_new, and both pooled ratios."""
    by, stats = ["release_year"], cut(stats)
    sums = stats.groupBy(*by).agg(
        F.count("*").alias("n_samples"), F.avg("total_hashes").alias("avg_total"), F.avg("new_hashes").alias("avg_new"),
        F.avg("fraction_new").alias("mean_of_ratios"), ratio(F.sum("new_hashes"), F.sum("total_hashes")).alias("ratio_of_sums"),
    )
    new = percentiles(stats, by, "new_hashes", (0.25, 0.5, 0.75)).drop("n").withColumnsRenamed({"q0": "p25_new", "q1": "p50_new", "q2": "p75_new"})
    fraction = percentiles(stats, by, "fraction_new", (0.25, 0.5, 0.75, 0.95)).drop("n").withColumnsRenamed({"q0": "p25_fraction", "q1": "p50_fraction", "q2": "p75_fraction", "q3": "p95_fraction"})
    return joined(joined(sums, new, by, "left"), fraction, by, "left")


def life_counts(life: DataFrame) -> DataFrame:
    """(birth_year, death_year, n_hashes, duration)."""
    return life.groupBy("birth_year", "death_year").agg(F.count("*").alias("n_hashes")).withColumn("duration", F.col("death_year") - F.col("birth_year"))


def survival(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., duration, at_risk, events, survival): Kaplan-Meier from life counts.

    A hash still seen in the last year of all is censored. Everything is computed on the few (birth, death) rows.
    """
    last = counts.agg(F.max("death_year").alias("last"))
    rows = counts.crossJoin(F.broadcast(last)).withColumn("gone", F.when(F.col("death_year") < F.col("last"), F.col("n_hashes")).otherwise(0))
    step = rows.groupBy(*by, "duration").agg(F.sum("n_hashes").alias("exits"), F.sum("gone").alias("events"))
    later = W.partitionBy(*by).orderBy("duration").rowsBetween(0, W.unboundedFollowing)
    before = W.partitionBy(*by).orderBy("duration").rowsBetween(W.unboundedPreceding, 0)
    step = step.withColumn("at_risk", F.sum("exits").over(later))
    ended = F.max((F.col("events") == F.col("at_risk")).cast("int")).over(before) == 1
    log = F.sum(F.when(F.col("events") < F.col("at_risk"), F.log(1 - F.col("events") / F.col("at_risk"))).otherwise(0.0)).over(before)
    return step.select(*by, "duration", "at_risk", "events", F.when(ended, 0.0).otherwise(F.exp(log)).alias("survival"))


def transience(counts: DataFrame) -> DataFrame:
    """One row: totals and shares of hashes of a single year, of several, and of those that reach the last year."""
    last = counts.agg(F.max("death_year").alias("last"))
    rows = counts.crossJoin(F.broadcast(last))
    n, part = F.sum("n_hashes"), lambda c: F.sum(F.when(c, F.col("n_hashes")).otherwise(0))
    single, multi, stay = part(F.col("duration") == 0), part(F.col("duration") > 0), part(F.col("death_year") == F.col("last"))
    return rows.agg(n.alias("n_hashes"), single.alias("n_single_year"), multi.alias("n_multi_year"), stay.alias("n_persisting"), ratio(single, n).alias("single_share"), ratio(stay, n).alias("persisting_share"))


def birth_death_grid(counts: DataFrame) -> DataFrame:
    """(birth_year, death_year, log_n): log10(n + 1), the cells of a heat map."""
    return counts.select("birth_year", "death_year", F.log10(F.col("n_hashes") + 1).alias("log_n"))


def merge_life(old: DataFrame, new: DataFrame) -> DataFrame:
    """hash_life of two disjoint or overlapping parts of the samples, from the two results."""
    return old.unionByName(new).groupBy("min_hash").agg(F.min("birth_year").alias("birth_year"), F.max("death_year").alias("death_year"))
