"""Queries without SQL against plain computations over the same tables."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkfen.functions import hashing, special
from sparkfen.operators import clusters, enrichment, statistics
from sparkfen.plans import catalog
from sparkfen.plans.bindings import Bound
from tests.test_whole_texts import dna

DIR = "/root/testdata/sf0.001"


def rows(spark, name):
    return catalog.queries()[name](spark, DIR).collect()


def groups_of(spark):
    xy = Bound(spark, DIR).xy.toPandas()
    for variable in ("platform", "organism"):
        for category, g in xy.groupby(variable):
            yield variable, category, g["x"].astype(float).to_numpy(), g["y"].astype(float).to_numpy()


def test_murmur3_fmh(spark):
    want = set()
    for r in Bound(spark, DIR).t("documents").filter("doc_id % 10 = 0").collect():
        s = dna(r.text or "")
        found = {min(f, f[::-1].translate(str.maketrans("ACGT", "TGCA"))) for f in (s[i : i + 11] for i in range(len(s) - 10))}
        if found:
            h = hashing.murmur3_low64([f.encode() for f in sorted(found)], 42)
            want |= {(r.doc_id, int(x)) for x in h[h <= np.uint64(int(0.01 * 2**64))].view(np.int64)}
    assert {(r.sample_id, r.hash) for r in rows(spark, "murmur3_fmh") if r.sample_id % 10 == 0} == want


def test_murmur_of_a_known_collision():
    """Two 31-mers that share their hash, from the survey of collisions."""
    pair = ("AGTAAAAATAAAGAATTTTCTGACACTTCAG", "AGTGGCTTCTCTTCAGAAGCCATCTCTTTCA")
    assert hashing.murmur3_low64([x.encode() for x in pair], 42).tolist() == [13086129273328152] * 2


def test_battery(spark):
    got = {(r.variable, r.category): r for r in rows(spark, "category_statistics")}
    count = 0
    for variable, category, x, y in groups_of(spark):
        if len(x) < 30:
            continue
        r, count = got[variable, category], count + 1
        assert r.n == len(x) and r.pearson == pytest.approx(np.corrcoef(x, y)[0, 1]) and r.spearman == pytest.approx(np.corrcoef(pd.Series(x).rank(), pd.Series(y).rank())[0, 1])
        assert r.kendall_tau == pytest.approx(special.kendall_tau_b(x, y)) and r.p_kendall == pytest.approx(special.p_of_tau(x, y), abs=1e-9)
        assert r.p == pytest.approx(special.p_of_r(r.pearson, r.n)) and r.p_spearman == pytest.approx(special.p_of_r(r.spearman, r.n))
        assert (r.slope, r.intercept) == pytest.approx(tuple(np.polyfit(x, y, 1)), rel=1e-6) and 0 <= r.mic <= 1 and 0 < r.distance_corr <= 1
    assert len(got) == count > 5
    ordered = sorted(got.values(), key=lambda r: r.p)
    fdr = [min(r.p * count / i for i, r in enumerate(ordered, 1) if i >= k) for k in range(1, count + 1)]
    assert [r.p_fdr for r in ordered] == pytest.approx([min(1.0, f) for f in fdr])


def test_kendall_distance_mic(spark):
    got = {(r.variable, r.category): r for r in rows(spark, "kendall_distance_mic")}
    for variable, category, x, y in groups_of(spark):
        r = got.pop((variable, category))
        assert r.n == r.n_used == len(x) and r.kendall_tau == pytest.approx(special.kendall_tau_b(x, y)) and r.distance_corr == pytest.approx(special.distance_correlation(x, y))
    assert not got


def test_p_values_against_integrals():
    """The tail of Student's t for a correlation, by the trapezium rule."""
    for r, n in ((0.3, 12), (-0.6, 20), (0.05, 200)):
        t = abs(r) * math.sqrt((n - 2) / (1 - r * r))
        grid = np.linspace(t, t + 4000, 4_000_001)
        log = math.lgamma((n - 1) / 2) - math.lgamma((n - 2) / 2) - 0.5 * math.log((n - 2) * math.pi) - (n - 1) / 2 * np.log1p(grid**2 / (n - 2))
        assert special.p_of_r(r, n) == pytest.approx(2 * np.trapezoid(np.exp(log), grid), rel=1e-4)


def test_fisher_enrichment(spark):
    got = rows(spark, "fisher_enrichment")
    assert got and {r.category for r in got} == {r.category for r in rows(spark, "enrichment_ratio")}
    for r in got:
        a, b, c, d = map(int, (r.a, r.b, r.c, r.d))
        total = math.comb(a + b + c + d, a + c)
        p = [math.comb(a + b, k) * math.comb(c + d, a + c - k) / total for k in range(max(0, a - d), min(a + b, a + c) + 1)]
        own = math.comb(a + b, a) * math.comb(c + d, c) / total
        assert r.p_fisher == pytest.approx(min(1.0, sum(x for x in p if x <= own * (1 + 1e-7))), rel=1e-6)


def test_tests_with_p(spark):
    got = {r.test: r for r in rows(spark, "tests_with_p")}
    assert set(got) == {"chi2", "chi2 of two by two", "rank sum of x", "rank sum of y"}
    for name in ("rank sum of x", "rank sum of y"):
        assert got[name].p == pytest.approx(min(1.0, math.erfc(abs(got[name].statistic) / math.sqrt(2))))
    assert got["chi2 of two by two"].p == pytest.approx(math.erfc(math.sqrt(got["chi2 of two by two"].statistic / 2)))
    m = Bound(spark, DIR).meta.toPandas()
    o = pd.crosstab(m["center"], m["platform"]).to_numpy(float)
    e = o.sum(1, keepdims=True) * o.sum(0, keepdims=True) / o.sum()
    assert got["chi2"].statistic == pytest.approx(((o - e) ** 2 / e).sum()) and 0 < got["chi2"].p <= 1


def plain_linkage(d, cut):
    """Average-linkage clusters by merging the nearest two again and again."""
    parts = [[i] for i in range(len(d))]
    while len(parts) > 1:
        h, i, j = min((d[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(parts) for j, b in enumerate(parts[:i]))
        if h > cut:
            break
        parts[j] += parts.pop(i)
    return {frozenset(p) for p in parts}


def test_upgma(spark):
    v = Bound(spark, DIR).t("embeddings").toPandas()
    got = catalog.queries()["upgma"](spark, DIR).toPandas()
    assert len(got) == 4 * len(v)
    for label, g in list(v.groupby("label"))[:3]:
        g = g.sort_values("vec_id").head(10_000)
        x = np.stack(g["embedding"].to_numpy()).astype(float)
        x /= np.sqrt((x * x).sum(1, keepdims=True))
        ids = g["vec_id"].to_numpy()
        for cut in (0.2, 0.9):
            mine = got[(got["label"] == label) & (got["cut"] == cut)]
            want = {frozenset(ids[list(p)].tolist()) for p in plain_linkage(1 - x @ x.T, cut)}
            assert {frozenset(p["node"].tolist()) for _, p in mine.groupby("cluster")} == want

def test_louvain(spark):
    """Two cliques with one edge between them, and a far pair: three communities in any order of the edges; and the query's lie in components."""
    edges = [(i, j, 1.0) for a in (0, 10) for i in range(a, a + 5) for j in range(a, i)] + [(0, 10, 1.0), (20, 21, 0.5)]
    random.Random(1).shuffle(edges)
    df = spark.createDataFrame(edges, "src long, dst long, w double")
    members = spark.createDataFrame([(n, 20 if n > 15 else 0) for n in {*range(5), *range(10, 15), 20, 21}], "node long, component long")
    got = {r.node: r.community for r in clusters.louvain(df, members).collect()}
    assert got == {n: 20 if n > 15 else 10 if n > 5 else 0 for n in got} and len(got) == 12
    component = {r.node: r.component for r in rows(spark, "components")}
    found = rows(spark, "louvain")
    assert {r.node for r in found} == set(component) and all(component[r.community] == component[r.node] for r in found)
    assert sorted(map(tuple, found)) == sorted(map(tuple, rows(spark, "louvain")))


def test_leaf_order():
    d = np.array([[0, 1, 4, 5], [1, 0, 4, 5], [4, 4, 0, 2], [5, 5, 2, 0]], float)
    assert clusters.leaf_order(clusters.linkage(d), 4) == [0, 1, 2, 3]
    shuffled = [2, 0, 3, 1]
    order = clusters.leaf_order(clusters.linkage(d[np.ix_(shuffled, shuffled)]), 4)
    assert {frozenset(shuffled[i] for i in order[:2]), frozenset(shuffled[i] for i in order[2:])} == {frozenset({0, 1}), frozenset({2, 3})}


def test_scanners(spark):
    made = [(1, "a", "US", "p", 2001, 10.0, 20.0), (1, "b", "US", "p", 2001, 10.1, 20.0), (1, "c", "US", "q", 2010, 10.0, 20.1), (1, "d", "FR", "p", 2001, 50.0, 80.0), (2, "e", "US", "p", None, None, None), (2, "f", "US", "p", 2001, 1.0, 1.0)]
    df = spark.createDataFrame(made, "component_id long, sample_id string, country string, bioproject string, year long, lat double, lon double")
    got = {r.component_id: r.asDict() for r in enrichment.component_scan(df, "component_id", several=["country", "bioproject"], year="year").collect()}
    assert got[1] == {"component_id": 1, "size": 4, "n_country": 2, "n_bioproject": 2, "first_year": 2001, "last_year": 2010, "span": 9, "multi_country": True, "multi_bioproject": True, "spread_in_time": True}
    assert got[2]["multi_country"] is False and got[2]["span"] == 0
    late = enrichment.temporal_outliers(df, "component_id", "sample_id", "year", least=5).collect()
    assert [tuple(r) for r in late] == [(1, "c", 2010, 2001.0, 9.0)]
    far = enrichment.geographic_outliers(df, "component_id", "sample_id", least_km=1000).collect()
    assert [(r.component_id, r.sample_id) for r in far] == [(1, "d")] and far[0].km > 5000


def test_category_statistics_of_few_rows(spark):
    few = spark.createDataFrame([("g", float(i), float(i * i)) for i in range(10)], "k string, x double, y double")
    assert statistics.battery(few, ["k"], "x", "y").count() == 0 and statistics.battery(few, ["k"], "x", "y", least=5).count() == 1
    assert statistics.kendall(few.filter(F.lit(False)), ["k"], "x", "y").count() == 0
