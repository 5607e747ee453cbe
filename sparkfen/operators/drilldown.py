"""What the metadata of components holds, field by field, and how components differ in it."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SALTS = 64


def field_counts(members: DataFrame, by: str, fields: Sequence[str]) -> DataFrame:
    """(by, field, value, n): how often each value of each field is in a group, values as strings; nulls are left out. One shuffle for
    all fields, combined before it."""
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").cast("string").alias("value")) for f in fields))
    return members.select(F.col(by).alias(by), F.explode(pairs).alias("p")).select(by, "p.*").filter("value is not null").groupBy(by, "field", "value").agg(F.count("*").alias("n"))


def placed(counts: DataFrame, by: str, top: int) -> DataFrame:
    """The `top` commonest values of each field in a group with their place, ties by value.

    First by salt, so that a group with very many values (an identifier) is not ranked in one task."""
    salt = F.pmod(F.xxhash64("value"), F.lit(SALTS))
    order = (F.desc("n"), F.asc("value"))
    some = counts.withColumn("__salt", salt).withColumn("place", F.row_number().over(W.partitionBy(by, "field", "__salt").orderBy(*order))).filter(F.col("place") <= top)
    return some.drop("__salt").withColumn("place", F.row_number().over(W.partitionBy(by, "field").orderBy(*order))).filter(F.col("place") <= top)


def distributions(members: DataFrame, by: str, fields: Sequence[str], top: int = 10) -> DataFrame:
    """(by, field, size, n_filled, coverage, n_values, place, value, n, share) of the commonest values of each field in every group.

    size counts a group's rows, n_filled those with a value, n_values the unlike ones; share is of those with a value. A field without any
    value in a group has no row there.
    """
    counts = field_counts(members, by, fields)
    size = members.groupBy(by).agg(F.count("*").alias("size"))
    filled = counts.groupBy(by, "field").agg(F.sum("n").alias("n_filled"), F.count("*").alias("n_values"))
    out = placed(counts, by, top).join(filled, [by, "field"]).join(size, by)
    return out.select(by, "field", "size", "n_filled", (F.col("n_filled") / F.col("size")).alias("coverage"), "n_values", "place", "value", "n", (F.col("n") / F.col("n_filled")).alias("share"))


def compared(members: DataFrame, by: str, fields: Sequence[str], one: Any, top: int = 5) -> DataFrame:
    """(by, field, value, n, share, n_one, share_one, common) of each other group against the group `one`: the values that are among the `top`
    commonest of a field in either, with their shares of all rows of the two; common is the overlap of the two distributions (the
    sum of the lesser shares over all values). No pairs of groups are made: each has its own counts beside those of `one`, of which
    only the `top` values of each field come to the driver. A group `one` that is not there has no rows: all its numbers are 0.
    """
    counts = field_counts(members, by, fields)
    size = members.groupBy(by).agg(F.count("*").alias("size"))
    here, others = F.col(by) == F.lit(one), F.col(by) != F.lit(one)
    of_one = counts.filter(here).select("field", "value", F.col("n").alias("n_one"))
    size_one = members.filter(here).count()
    share, share_one = F.col("n") / F.col("size"), F.col("n_one") / F.lit(max(size_one, 1))
    both = counts.filter(others).join(of_one, ["field", "value"], "left").fillna(0, "n_one").join(size, by)
    common = both.groupBy(by, "field").agg(F.sum(F.least(share, share_one)).alias("common"))
    groups = size.filter(others)
    keys = placed(counts.filter(others), by, top).select(by, "field", "value")
    theirs = placed(counts.filter(here), by, top).select("field", "value").collect()  # `top` for each field at most
    if theirs:
        literals = F.array(*(F.struct(F.lit(r.field).alias("field"), F.lit(r.value).alias("value")) for r in theirs))
        keys = keys.union(groups.select(by, F.explode(literals).alias("p")).select(by, "p.*")).distinct()
    out = keys.join(counts, [by, "field", "value"], "left").fillna(0, "n").join(of_one, ["field", "value"], "left").fillna(0, "n_one")
    out = out.join(groups, by).join(common, [by, "field"], "left").fillna(0.0, "common")
    return out.select(by, "field", "value", "n", share.alias("share"), "n_one", share_one.alias("share_one"), "common")


def years(members: DataFrame, by: str, dates: Sequence[str], first: int = 2000, last: int = 2030) -> DataFrame:
    """(by, first_year, last_year, span, n_dates) from the first four characters of all date fields that are a year from first to last."""
    found = members.select(by, F.explode(F.array(*(F.substring(F.col(f"`{d}`").cast("string"), 1, 4).try_cast("int") for d in dates))).alias("y")).filter(F.col("y").between(first, last))
    return found.groupBy(by).agg(F.min("y").alias("first_year"), F.max("y").alias("last_year"), (F.max("y") - F.min("y")).alias("span"), F.count("*").alias("n_dates"))
