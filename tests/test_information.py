"""The information coefficient: published values, ties, and a search over all grids."""

import itertools
import math

import numpy as np
import pytest

from sparkfen.functions import special


def test_published_values():
    """A noiseless and a noisy wave, as the documentation of a common implementation prints them (alpha 0.6, c 15)."""
    x = np.linspace(0, 1, 1000)
    y = np.sin(10 * np.pi * x) + x
    assert special.maximal_information(x, y) == pytest.approx(1.0, abs=1e-9)
    np.random.seed(0)
    y = y + np.random.uniform(-1, 1, x.shape[0])
    assert special.maximal_information(x, y) == pytest.approx(0.505716693417, abs=1e-9)


@pytest.mark.parametrize("f", [lambda x: x, lambda x: x * x, lambda x: np.exp(3 * x), lambda x: np.abs(x - 0.3), lambda x: -x])
def test_functions(f):
    x = np.linspace(-1, 1, 700)
    assert special.maximal_information(x, f(x)) > 0.95


@pytest.mark.parametrize("values", [2, 3, 10, 50])
def test_independent_ties(values):
    """Few values tell nothing about an independent variable, in whatever order the rows come."""
    rng = np.random.default_rng(values)
    x, y = rng.integers(0, values, 3000), rng.normal(size=3000)
    order = np.lexsort((y, x))
    got = special.maximal_information(x, y)
    assert got < 0.1 and got == pytest.approx(special.maximal_information(x[order], y[order])) == pytest.approx(special.maximal_information(y, x))
    z = rng.integers(0, values, 3000)
    assert special.maximal_information(x, z) < 0.1


def test_constants_and_few_points():
    x = np.arange(60.0)
    assert special.maximal_information(x, np.ones(60)) == special.maximal_information(np.ones(60), x) == 0.0
    assert math.isnan(special.maximal_information(x[:49], x[:49]))


def information(cells):
    p = cells / cells.sum()
    outer = p.sum(1, keepdims=True) * p.sum(0, keepdims=True)
    return float((p[p > 0] * np.log2(p[p > 0] / outer[p > 0])).sum())


def all_grids(x, y, limit):
    """The best of all grids that divide no value, in both directions: what the approximate search cannot pass."""
    best = 0.0
    xs, ys = np.unique(x), np.unique(y)
    for a in range(1, len(xs)):
        for b in range(1, len(ys)):
            if (a + 1) * (b + 1) > limit:
                continue
            for i in itertools.combinations(xs[1:], a):
                for j in itertools.combinations(ys[1:], b):
                    cells = np.zeros((a + 1, b + 1))
                    np.add.at(cells, (np.searchsorted(i, x, "right"), np.searchsorted(j, y, "right")), 1)
                    best = max(best, information(cells) / math.log2(min(a, b) + 1))
    return best


@pytest.mark.parametrize("seed", range(6))
def test_against_all_grids(seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 5, 60)
    y = (x * (seed % 3) + rng.integers(0, 3, 60)) % 4
    got, bound = special.maximal_information(x, y), all_grids(x, y, 60**0.6)
    assert got <= bound + 1e-9 and got >= 0.75 * bound


def test_columns_are_the_best():
    """The dynamic programme against all ways to join clumps."""
    rng = np.random.default_rng(1)
    cells = rng.integers(0, 6, (7, 3))
    cost = lambda c: -sum(float((r[r > 0] * np.log2(r[r > 0] / r.sum())).sum()) for r in c)
    got = special.column_entropies(cells, 7)
    for k in range(1, 8):
        ways = [cost([p.sum(0) for p in np.split(cells, list(cuts))]) for m in range(k) for cuts in itertools.combinations(range(1, 7), m)]
        assert got[k - 1] == pytest.approx(min(ways))
