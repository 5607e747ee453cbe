"""Frames that are written in loops: the planner's estimate of their size stays a number of bounded length."""

from pyspark.sql import functions as F

from sparkfen.operators.clusters import average_linkage
from sparkfen.operators import linkage
from sparkfen.session import cut, size_bits


def test_estimates_in_a_loop(spark):
    df = spark.range(50).select("id", F.array(F.col("id").cast("double"), F.lit(None)).alias("v"), F.struct("id").alias("s"), F.when(F.col("id") > 7, F.lit("x")).alias("t"))
    want, now = sorted(map(repr, df.collect())), df
    for _ in range(12):
        now = cut(now.join(now.select(F.col("id").alias("id")), "id").join(now.select(F.col("id").alias("id"), F.col("t").alias("u")), "id").drop("u"))
        assert size_bits(now) <= 4096
    assert sorted(map(repr, now.collect())) == want and now.schema.simpleString() == df.schema.simpleString()


def test_estimates_of_merge_rounds(spark, monkeypatch):
    """The state of average linkage is joined with itself in every round."""
    seen, write = [], linkage.cut
    monkeypatch.setattr(linkage, "cut", lambda df: seen.append(size_bits(df)) or write(df))
    v = spark.range(120).select(F.col("id").alias("vec_id"), F.lit("a").alias("label"), F.array(*[F.cos(F.col("id") * k) for k in (1.0, 2.3, 5.1)]).alias("embedding"))
    assert average_linkage(v, "label", [0.1], most=10).count() == 120
    assert len(seen) > 20 and max(seen) < 15_000
