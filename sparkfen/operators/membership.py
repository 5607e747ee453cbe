"""Set membership of sample hashes: mapped and unmapped shares, host removal, unions and overlaps.

A sample is a set of hashes in long form: sig(sample_id, min_hash). Reference and host sets have one column, hash.
Sets are deduplicated before each join, so a join never multiplies rows; Spark chooses broadcast or shuffle by size.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(n: Column, d: Column) -> Column:
    """n / d as a double, null where d is not positive."""
    return F.when(d > 0, n.cast("double") / d.cast("double"))


def flagged(sig: DataFrame, hashes: DataFrame, flag: str) -> DataFrame:
    """sig with a boolean: whether min_hash is in the set. A null hash is in no set."""
    marked = hashes.select(F.col("hash").alias("min_hash")).filter("min_hash is not null").distinct().withColumn(flag, F.lit(True))
    return sig.join(marked, "min_hash", "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def unmapped_index(sig: DataFrame, ref: DataFrame) -> DataFrame:
    """(accession, total_hashes, unmapped_hashes, mapped_hashes, dmi) of each sample: the share of hashes in no reference."""
    n, mapped = F.count("*"), F.count_if(F.col("in_ref"))
    return flagged(sig, ref, "in_ref").groupBy(F.col("sample_id").alias("accession")).agg(
        n.alias("total_hashes"), (n - mapped).alias("unmapped_hashes"), mapped.alias("mapped_hashes"), ratio(n - mapped, n).alias("dmi"),
    )


def host_filtered_index(sig: DataFrame, ref: DataFrame, host: DataFrame) -> DataFrame:
    """Nine measures of each sample with host hashes taken out before the index."""
    rows = flagged(flagged(sig, host, "in_host"), ref, "in_ref")
    n, h = F.count("*"), F.count_if(F.col("in_host"))
    mapped = F.count_if(~F.col("in_host") & F.col("in_ref"))
    return rows.groupBy(F.col("sample_id").alias("accession")).agg(
        n.alias("total_hashes_original"), h.alias("host_hashes"), ratio(h, n).alias("host_fraction"), (n - h).alias("total_hashes_host_filtered"),
        (n - h - mapped).alias("unmapped_hashes_host_filtered"), mapped.alias("mapped_hashes_host_filtered"), ratio(n - h - mapped, n - h).alias("dmi_host_filtered"),
        ratio(mapped, n - h).alias("mapped_fraction_host_filtered"), F.count_if(F.col("in_host") & F.col("in_ref")).alias("host_in_reference"),
    )


def per_megabase(df: DataFrame, columns: Sequence[str], mbases: str = "mbases") -> DataFrame:
    """df with {column}_per_mb; null where the megabases are missing or not positive."""
    return df.withColumns({f"{c}_per_mb": ratio(F.col(c), F.col(mbases)) for c in columns})


def export_hashes(sig: DataFrame, ref: DataFrame, host: DataFrame) -> DataFrame:
    """(sample_id, min_hash, is_dark) of the hashes that are not the host's."""
    kept = sig.join(host.select(F.col("hash").alias("min_hash")).distinct(), "min_hash", "left_anti")
    return flagged(kept, ref, "in_ref").select("sample_id", "min_hash", (~F.col("in_ref")).alias("is_dark"))


def union_of(sets: Sequence[DataFrame]) -> DataFrame:
    """The distinct hashes of several sets; one shuffle however many there are."""
    return reduce(DataFrame.union, [s.select("hash") for s in sets]).distinct()


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: n_a, n_b, n_both, n_only_a, n_only_b, n_union of two sets of hashes, in one shuffle."""
    tagged = a.select("hash", F.lit(1).alias("s")).union(b.select("hash", F.lit(2).alias("s"))).groupBy("hash").agg(F.bit_or("s").alias("s"))
    n = lambda *v: F.count_if(F.col("s").isin(*v))
    return tagged.agg(n(1, 3).alias("n_a"), n(2, 3).alias("n_b"), n(3).alias("n_both"), n(1).alias("n_only_a"), n(2).alias("n_only_b"), n(1, 2, 3).alias("n_union"))


def global_distinct(sig: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """n_samples and n_distinct over all samples, or those of a table with sample_id."""
    rows = sig if samples is None else sig.join(samples.select("sample_id").distinct(), "sample_id", "left_semi")
    return rows.agg(F.countDistinct("sample_id").alias("n_samples"), F.countDistinct("min_hash").alias("n_distinct"))


def overlap_rate(sig: DataFrame, other: DataFrame) -> DataFrame:
    """(sample_id, n, n_in, rate): the share of each sample's hashes that another set holds."""
    return flagged(sig, other, "in_other").groupBy("sample_id").agg(F.count("*").alias("n"), F.count_if(F.col("in_other")).alias("n_in"), ratio(F.count_if(F.col("in_other")), F.count("*")).alias("rate"))


def reconciled(found: DataFrame, expected: DataFrame, key: str, value: str) -> DataFrame:
    """Rows whose counts differ between two tables, a missing row counting as 0."""
    both = found.select(key, F.col(value).alias("found")).join(expected.select(key, F.col(value).alias("expected")), key, "full")
    zero = both.select(key, F.coalesce("found", F.lit(0)).alias("found"), F.coalesce("expected", F.lit(0)).alias("expected"))
    return zero.filter("found <> expected")
