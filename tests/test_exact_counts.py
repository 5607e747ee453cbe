"""Queries that agree with their SQL also on tables larger, or with other values, than the smallest ones."""

import os

import pytest
from pyspark.sql import functions as F

from sparkfen.plans import catalog
from sparkfen.operators import sketches
from tests.differential import compare


@pytest.fixture(scope="module")
def many_hashes(spark, tmp_path_factory):
    """Three years with more distinct hashes than a sketch of 2**20 holds."""
    at = str(tmp_path_factory.mktemp("years"))
    # 1,200,000 hashes a year, of which half are those of the year before.
    lines = spark.range(3_600_000).select((F.col("id") % 3).alias("l_orderkey"), (F.col("id") % 3 * 600_000 + F.expr("id div 3")).alias("l_partkey"), F.lit(7).cast("long").alias("l_suppkey"), F.lit("R").alias("l_returnflag"))
    orders = spark.range(3).select(F.col("id").alias("o_orderkey"), F.make_date(F.lit(1995) + F.col("id").cast("int"), F.lit(1), F.lit(1)).alias("o_orderdate"))
    made = {"lineitem": lines, "orders": orders}
    for name in "region nation customer supplier part events documents embeddings pages benchmark labels conversations".split():
        os.symlink(f"/root/testdata/sf0.001/{name}.parquet", f"{at}/{name}.parquet")
    for name, df in made.items():
        df.toPandas().to_parquet(f"{at}/{name}.parquet")
    return at


@pytest.mark.parametrize("name", ["distinct_by_year", "shared_between_years"])
def test_more_hashes_than_a_sketch_holds(spark, many_hashes, name):
    compare(catalog.queries()[name], catalog.oracle_sql()[name], spark, many_hashes)


def test_overlaps_of_gaps_and_empty_keys(spark):
    rows = [(1, 10), (1, 11), (1, 11), (3, 11), (3, 12), (4, None), (6, 10), (6, 12)]
    got = sketches.distinct_overlaps(spark.createDataFrame(rows, "k int, x long"), "k", "x")
    assert {(r.a, r.b): (r.n_union, r.n_both, r.n_only_a) for r in got.collect()} == {(1, 3): (3, 1, 1), (3, 4): (2, 0, 2), (4, 6): (2, 0, 0)}


def test_outliers_of_the_source_only(spark, tmp_path):
    rows = [(1, "same text", "en", "a", 9), (2, "same text", "de", "a", 9), (3, "same text", "en", "b", 9), (4, "other", "fr", "c", 5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").toPandas().to_parquet(f"{tmp_path}/documents.parquet")
    for name in "region nation customer supplier part orders lineitem events embeddings pages benchmark labels conversations".split():
        os.symlink(f"/root/testdata/sf0.001/{name}.parquet", f"{tmp_path}/{name}.parquet")
    compare(catalog.queries()["modal_outliers"], catalog.oracle_sql()["modal_outliers"], spark, str(tmp_path))
