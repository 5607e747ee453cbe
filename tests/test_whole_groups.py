"""Statistics of groups of any size: nothing is sampled, and columns are found exactly without a square of the clumps."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkfen.functions import special
from sparkfen.functions.grids import Columns
from sparkfen.operators import statistics


def test_no_pair_is_left_out_above_50_000(spark):
    """The last pairs would change little in a sample; here they are all that differs."""
    df = spark.range(60_000).select(F.lit("g").alias("k"), (F.col("id") % 40).cast("double").alias("x"), F.when(F.col("id") >= 40_000, F.col("id") % 40).otherwise(F.col("id") * 7 % 9).cast("double").alias("y"))
    got = statistics.grouped(df, ["k"], "x", "y").first()
    i = np.arange(60_000)
    x, y = (i % 40).astype(float), np.where(i >= 40_000, i % 40, i * 7 % 9).astype(float)
    assert got.n == got.n_used == 60_000
    assert got.distance_corr == pytest.approx(special.distance_correlation(x, y)) and got.mic == pytest.approx(special.maximal_information(x, y))


@pytest.mark.parametrize("seed", range(12))
def test_columns_against_all_sums(seed):
    """Any number of columns against the plain dynamic programme."""
    rng = np.random.default_rng(seed)
    cells = rng.integers(0, 2 + seed, (int(rng.integers(3, 60)), int(rng.integers(2, 6))))
    cells[cells.sum(1) == 0, 0] = 1
    want, grid = special.column_entropies(cells, len(cells)), Columns(cells)
    assert grid.layers(6) == pytest.approx(want[:6])
    assert [grid.least(m) for m in range(1, len(cells) + 1)] == pytest.approx(want)


def test_counted_pairs():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 30, 900).astype(float)
    y = x + rng.integers(0, 9, 900)
    pairs, times = np.unique(np.stack([x, y], 1), axis=0, return_counts=True)
    a, b = pairs.T
    assert special.information_along(a, b, times=times) == pytest.approx(special.information_along(x, y), abs=1e-12)
    assert special.distance_correlation(a, b, times) == pytest.approx(special.distance_correlation(x, y))
