"""Statistics that are computed in ranges of their value: against plain computations, and the plans of their queries."""

import contextlib
import io
import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkfen.operators import measures, ranks
from sparkfen.operators import statistics as st
from sparkfen.plans import catalog

DIR = "/root/testdata/sf0.001"


def groups_of(rng, n=900):
    """(g, x) with many ties, a null group, a group of one row and one of two, and null values."""
    rows = [(rng.choice(["a", "b", None]), float(rng.integers(0, 40))) for _ in range(n)]
    return [(None if g is None else str(g), x) for g, x in rows] + [("one", 3.5), ("two", -1.0), ("two", 8.0), ("a", None)]


def by_group(rows):
    out = {}
    for g, x in rows:
        if x is not None:
            out.setdefault(g, []).append(x)
    return {g: sorted(v) for g, v in out.items()}


def test_number_of_ranges_grows():
    assert ranks.parts_for(10) == ranks.PARTS
    assert ranks.parts_for(2_000_000_000) == 1000
    assert ranks.parts_for(10**13) == ranks.MOST_PARTS


@pytest.mark.parametrize("parts", [1, 2, 3, 7, 256, 700])
def test_ranges_are_in_order_and_keep_ties_together(spark, parts):
    rows = [(float(x),) for x in np.random.default_rng(parts).integers(-50, 50, 2000)] + [(None,)]
    got = ranks.ranged(spark.createDataFrame(rows, "x double"), "x", "part", parts).collect()
    assert len(got) == len(rows) and {r.part for r in got if r.x is None} == {-1}
    of = {}
    for r in got:
        if r.x is not None:
            of.setdefault(r.x, set()).add(r.part)
    assert all(len(p) == 1 for p in of.values())
    order = [next(iter(of[x])) for x in sorted(of)]
    assert order == sorted(order) and 0 <= order[0] and order[-1] < max(parts, 1)
    assert len(set(order)) > min(parts, 100) / 3


def test_robust_means(spark):
    rows = groups_of(np.random.default_rng(3))
    got = {r.g: r for r in measures.robust_means(spark.createDataFrame(rows, "g string, x double"), ["g"], "x").collect()}
    want = by_group(rows)
    assert set(got) == set(want)
    for g, x in want.items():
        n, k, r = len(x), int(len(x) * 0.1), got[g]
        inner, positive = x[k : n - k], [v for v in x if v > 0]
        assert r.n == n and r.median == statistics.median(x)
        assert r.mean == pytest.approx(sum(x) / n) and r.trimmed == pytest.approx(sum(inner) / len(inner))
        assert r.winsorised == pytest.approx((sum(inner) + k * (x[k] + x[n - k - 1])) / n)
        assert r.geometric == pytest.approx(math.exp(sum(map(math.log, positive)) / len(positive)))
        assert r.iqr == pytest.approx(np.percentile(x, 75) - np.percentile(x, 25))
        assert (r.sd is None) if n < 2 else r.sem == pytest.approx(statistics.stdev(x) / math.sqrt(n))


def test_percentiles_and_positions(spark):
    rows = groups_of(np.random.default_rng(4))
    df = spark.createDataFrame(rows, "g string, x double")
    q = {r.g: r for r in ranks.percentiles(df, ["g"], "x", (0.05, 0.5, 0.95)).collect()}
    at = {r.g: r for r in ranks.at_positions(df, ["g"], "x", {"first": lambda n: F.lit(0), "third": lambda n: F.floor(3 * n / 4)}).collect()}
    for g, x in by_group(rows).items():
        assert [q[g].q0, q[g].q1, q[g].q2] == pytest.approx(list(np.percentile(x, [5, 50, 95])))
        assert (at[g].first, at[g].third) == (x[0], x[3 * len(x) // 4])


def test_mid_ranks_of_null_groups(spark):
    rows = groups_of(np.random.default_rng(5), 200)
    got = ranks.mid_ranks(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", "r").collect()
    want = by_group(rows)
    assert len(got) == len(rows)
    for r in got:
        if r.x is None:
            assert r.r is None
        else:
            x = want[r.g]
            assert r.r == sum(v < r.x for v in x) + (x.count(r.x) + 1) / 2


def test_correction_of_tied_and_missing_p(spark):
    rng = np.random.default_rng(6)
    rows = [(i, ["u", "v", None][i % 3], None if i % 50 == 0 else round(float(rng.random()) ** 3, 2)) for i in range(600)]
    got = st.corrected(spark.createDataFrame(rows, "id int, part string, p double"), within=["part"]).collect()
    assert len(got) == sum(p is not None for *_, p in rows)
    for part in ("u", "v", None):
        mine = sorted((r for r in got if r.part == part), key=lambda r: (r.p, r.id))
        m, least = len(mine), 1.0
        for i in range(m, 0, -1):  # the textbook form: from the largest p down
            r = mine[i - 1]
            least = min(least, r.p * m / i)
            assert r.p_fdr == pytest.approx(least) and r.rejected == (r.p_fdr <= 0.05)
            assert r.p_bonferroni == pytest.approx(min(1.0, r.p * m))


def test_correction_of_no_rows(spark):
    assert st.corrected(spark.createDataFrame([], "id int, p double")).count() == 0


def test_rank_sum_within_one_unit(spark):
    rng = np.random.default_rng(7)
    rows = [(bool(rng.integers(0, 2)), round(float(rng.random()), 2)) for _ in range(500)]
    got = st.mann_whitney(spark.createDataFrame(rows, "g boolean, x double"), F.col("g"), "x").first()
    ins, outs = [x for g, x in rows if g], [x for g, x in rows if not g]
    u = sum((a > b) + 0.5 * (a == b) for a in ins for b in outs)
    assert (got.n1, got.n2, got.u) == (len(ins), len(outs), u)


NAMES = "bh_fdr corpus_totals dmi_ranking mannwhitney_u median_element nearest_rank_quartiles pearson_by_category provenance robust_yearly_summary yearly_novelty".split()


@pytest.mark.parametrize("name", NAMES)
def test_no_task_holds_all_values(spark, name):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        catalog.queries()[name](spark, DIR).explain("extended")
    plan = text.getvalue()
    assert " percentile(" not in plan and "median(" not in plan.replace("median_", "")
    if name == "pearson_by_category":
        assert "Window" not in plan  # moments alone need no ranks
