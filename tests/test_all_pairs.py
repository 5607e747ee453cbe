"""Rank and distance correlations over all rows of a group, against brute force."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkfen.functions import special
from sparkfen.operators import statistics


def by_matrix(x, y):
    def centred(v):
        d = np.abs(v[:, None] - v[None, :])
        return d - d.mean(0) - d.mean(1)[:, None] + d.mean()

    a, b = centred(x.astype(float)), centred(y.astype(float))
    return math.sqrt(max(0.0, (a * b).mean()) / math.sqrt((a * a).mean() * (b * b).mean()))


def tau(x, y):
    a, b = np.sign(x[:, None] - x[None, :]), np.sign(y[:, None] - y[None, :])
    return (a * b).sum() / math.sqrt((a != 0).sum() * (b != 0).sum())


@given(st.lists(st.tuples(st.integers(-5, 5), st.integers(-5, 5)), min_size=2, max_size=50))
@settings(max_examples=60, deadline=None)
def test_distance_correlation_against_matrices(pairs):
    x, y = map(np.array, zip(*pairs))
    got = special.distance_correlation(x, y)
    if len(set(x)) < 2 or len(set(y)) < 2:
        assert math.isnan(got)
    else:
        assert got == pytest.approx(by_matrix(x, y), abs=1e-6)


def test_groups_use_all_rows_in_any_order(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(1, 60, 3000).astype(float)
    y = np.where(np.arange(3000) < 2000, x, 60 - x) * 3 + rng.integers(0, 40, 3000)
    rows = [("g", float(a), float(b)) for a, b in zip(x, y)]
    run = lambda r: tuple(statistics.grouped(spark.createDataFrame(r, "k string, x double, y double"), ["k"], "x", "y").first())
    got = run(rows)
    assert got[1:3] == (3000, 3000) and (got[3], got[5]) == pytest.approx((tau(x, y), by_matrix(x, y)))
    assert run(rows[::-1]) == got


def test_no_row_is_left_out_above_the_former_sample(spark):
    rows = [("g", float(i), float(i % 7)) for i in range(12_000)]
    got = statistics.grouped(spark.createDataFrame(rows, "k string, x double, y double"), ["k"], "x", "y").first()
    assert got.n_used == 12_000 and got.kendall_tau == pytest.approx(special.kendall_tau_b(np.arange(12_000), np.arange(12_000) % 7))


def test_tau_of_ranges_against_pairs(spark):
    """Groups with many ties and a hot value, whose pairs lie in the same and in different ranges; p by the formula."""
    rng = np.random.default_rng(7)
    parts = {"a": (rng.normal(size=900), rng.normal(size=900)), "b": (rng.integers(0, 9, 600), rng.integers(0, 7, 600)), "c": (np.where(rng.random(500) < 0.4, 3.0, rng.normal(size=500)), rng.integers(0, 400, 500)), "d": (np.arange(40), -np.arange(40)), "e": (np.ones(5), np.arange(5))}
    rows = [(k, float(u), float(v)) for k, (a, b) in parts.items() for u, v in zip(a, b)] + [("a", None, 1.0)]
    got = {r.k: r for r in statistics.kendall(spark.createDataFrame(rows, "k string, x double, y double"), ["k"], "x", "y").collect()}
    for k, (a, b) in parts.items():
        a, b = np.asarray(a, float), np.asarray(b, float)
        assert got[k].n == len(a)
        if k == "e":
            assert got[k].kendall_tau is None
        else:
            assert got[k].kendall_tau == pytest.approx(tau(a, b)) and got[k].p_kendall == pytest.approx(special.p_of_tau(a, b), abs=1e-12)


def test_p_of_tau():
    x = np.array([12, 2, 1, 12, 2], float)
    y = np.array([1, 4, 7, 1, 0], float)
    assert special.kendall_tau_b(x, y) == pytest.approx(-0.47140452079103173) and special.p_of_tau(x, y) == pytest.approx(0.2827454599327748)


def test_larger_groups_are_sampled_by_key(spark):
    df = spark.range(4000).select(F.lit("g").alias("k"), F.col("id").cast("double").alias("x"), (F.col("id") % 5).cast("double").alias("y"), "id")
    one, two = (statistics.grouped(d, ["k"], "x", "y", key=["id"], most=1000).first() for d in (df, df.repartition(3)))
    assert one == two and one.n == 4000 and 800 < one.n_used < 1200 and one.kendall_tau == pytest.approx(special.kendall_tau_b(np.arange(4000), np.arange(4000) % 5))


def test_battery_reads_its_rows_a_few_times(spark):
    """Each pass over the input, and the tasks of Python, run once; corrections read what was written."""
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for g in batches:
            made.add(len(g))
            yield g

    rows = spark.createDataFrame([("a" if i % 3 else "b", float(i % 11), float(i * 7919 % 13)) for i in range(300)], "k string, x double, y double")
    got = statistics.battery(rows.mapInPandas(counted, rows.schema), ["k"], "x", "y").collect()
    assert len(got) == 2 and made.value <= 6 * 300


def test_cells_of_two_ranges_are_no_groups(spark):
    """Pairs that share a range are counted by range of x and by range of y: three kinds of Python groups."""
    rows = spark.createDataFrame([("a", float(i % 17), float(i * 7919 % 101)) for i in range(500)], "k string, x double, y double")
    tau = statistics.kendall(rows, ["k"], "x", "y")
    assert tau._jdf.queryExecution().optimizedPlan().toString().count("FlatMapGroupsInPandas") <= 3
    x, y = np.arange(500) % 17, np.arange(500) * 7919 % 101
    assert tau.first().kendall_tau == pytest.approx(special.kendall_tau_b(x, y))
