"""Communities and linkage of graphs and groups that no task holds, and the order of leaves, against plain computations."""

import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkfen.operators import clusters, leaves, linkage
from sparkfen.operators.graph import connected_components
from sparkfen.plans import catalog
from sparkfen.plans.bindings import Bound
from tests.test_values import DIR


def frame(spark, edges):
    return spark.createDataFrame(edges, "src long, dst long, w double").repartition(5)


def quality(spark, df, found):
    return clusters.modularity(df, found.withColumnRenamed("community", "component")).first()[0]


def test_two_cliques(spark):
    edges = [(i, j, 1.0) for a in (0, 10) for i in range(a, a + 5) for j in range(a, i)] + [(0, 10, 1.0), (20, 21, 0.5), (30, 30, 2.0)]
    df = frame(spark, edges)
    members = spark.createDataFrame([(n, n // 20 * 20 if n != 30 else 30) for n in (*range(5), *range(10, 15), 20, 21, 30)], "node long, component long")
    want = {n: n // 10 * 10 for n in (*range(5), *range(10, 15), 20, 21, 30)}
    for most in (2_000_000, 5):  # all in one task, the cliques over all
        rows = clusters.louvain(df, members, most=most).collect()
        assert {r.node: r.community for r in rows} == want and len(rows) == len(want)


def test_planted_communities(spark):
    """Weighted blocks with loops: as good as moves one by one, the same when run again, and named by the smallest member."""
    rng = random.Random(4)
    edges = [(i, j, rng.choice([1.0, 2.0])) for i in range(200) for j in range(i) if rng.random() < (0.5 if i // 20 == j // 20 else 0.01)] + [(i, i, 1.0) for i in range(0, 200, 7)]
    df = frame(spark, edges)
    k = connected_components(df, "src", "dst").cache()
    one = clusters.louvain(df, k)
    apart = clusters.louvain(df, k, most=300).cache()
    assert quality(spark, df, apart) >= quality(spark, df, one) - 0.005
    assert {r.community for r in apart.collect()} == {r.m for r in apart.groupBy("community").agg(F.min("node").alias("m")).collect()}
    assert sorted(map(tuple, clusters.louvain(df.repartition(3), k, most=300).collect())) == sorted(map(tuple, apart.collect()))


def test_linkage_in_rounds(spark):
    """The same clusters at every height as in one task, down to a few clusters a group, over several blocks."""
    v = Bound(spark, DIR).t("embeddings").filter("label in (1, 2)")
    v = v.union(spark.createDataFrame([(90_000 + i, [0.0] * 64, 1) for i in range(2)] + [(95_000 + i, [float(i), 1.0] + [0.0] * 62, None) for i in range(9)], v.schema))
    cuts = [0.05, 0.3, 0.6, 0.8, 0.95, 1.1]
    want = sorted(map(repr, clusters.average_linkage(v, "label", cuts).collect()))
    assert sorted(map(repr, clusters.average_linkage(v, "label", cuts, most=42).collect())) == want
    rows = v.filter("label is not null").select(F.to_json(F.struct("label")).alias("g"), F.col("vec_id").alias("node"), F.col("embedding").cast("array<double>").alias("v"))
    small = linkage.large_dendrograms(rows, 40, block=16).collect()
    whole = linkage.large_dendrograms(rows, 10_000).collect()
    assert len(small) == len(whole) == rows.count() - 2
    for g in {r.g for r in whole}:
        assert sorted(r.height for r in small if r.g == g) == pytest.approx(sorted(r.height for r in whole if r.g == g), abs=1e-9)


def tree_orders(steps, n):
    """All orders that flips allow."""
    part, root = {i: [[i]] for i in range(n)}, list(range(n))
    for x, y, _ in steps:
        a, b = root[x], root[y]
        orders = [p + q for p in part[a] for q in part[b]] + [q + p for p in part[a] for q in part[b]]
        part[a] = orders
        root = [a if r == b else r for r in root]
    return part[root[0]]


@pytest.mark.parametrize("n", range(2, 9))
def test_optimal_order(n):
    rng = np.random.default_rng(n)
    for _ in range(5):
        x = rng.normal(size=(n, 2))
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
        steps = clusters.linkage(d)
        length = lambda o: sum(d[a, b] for a, b in itertools.pairwise(o))
        ways = tree_orders(steps, n)
        got = linkage.optimal_order(steps, d)
        assert got in ways and length(got) == pytest.approx(min(map(length, ways))) and got[0] < got[-1]


def test_leaf_order_query(spark):
    """Every vector once, in an order of its dendrogram that is no longer than the plain one."""
    v = Bound(spark, DIR).t("embeddings").toPandas()
    got = catalog.queries()["leaf_order"](spark, DIR).toPandas().sort_values(["label", "position"])
    assert len(got) == len(v)
    for label, g in list(v.groupby("label"))[:4]:
        g = g.sort_values("vec_id")
        x = np.stack(g["embedding"].to_numpy()).astype(float)
        x /= np.sqrt((x * x).sum(1, keepdims=True))
        d, ids = 1 - x @ x.T, g["vec_id"].tolist()
        order = [ids.index(i) for i in got[got["label"] == label]["node"]]
        length = lambda o: sum(d[a, b] for a, b in itertools.pairwise(o))  # noqa: E731, B023
        assert sorted(order) == list(range(len(ids))) and length(order) <= length(clusters.leaf_order(clusters.linkage(d), len(ids))) + 1e-9
    with pytest.raises(ValueError, match="bound"):
        linkage.leaf_orders(Bound(spark, DIR).t("embeddings"), "label", most=2)


def test_memory_of_linkage_in_a_task():
    """Two matrices of the most vectors that one task takes, and a search for neighbours by rows."""
    import inspect
    import tracemalloc

    n = inspect.signature(clusters.average_linkage).parameters["most"].default
    assert 4 * 2 * 8 * n * n < 2_000_000_000  # in four workers of an executor
    v = np.random.default_rng(3).normal(size=(900, 16))
    stale = pd.DataFrame({"g": "x", "cid": range(900), "n": 1, "s": list(v)})
    for run, most in ((lambda: clusters.linkage(clusters.cosine_distances(v)), 2.3), (lambda: linkage._nearest(pd.concat([stale] * 3), stale), 3)):
        tracemalloc.start()
        run()
        assert tracemalloc.get_traced_memory()[1] < most * 8 * 900 * 900
        tracemalloc.stop()


def test_leaf_orders_of_large_groups(spark):
    """Groups of more vectors than a square matrix is made for, many of them copies: every vector once, copies side by side, the least sum."""
    rng = np.random.default_rng(8)
    made = [(i, rng.normal(size=8).tolist(), i % 2) for i in range(240)]
    made += [(1000 + i, made[i % 7][1], made[i % 7][2]) for i in range(90)] + [(2000 + i, rng.normal(size=8).tolist(), None) for i in range(3)]
    df = spark.createDataFrame(made, "vec_id long, embedding array<float>, label int").repartition(5)
    got = linkage.leaf_orders(df, "label", square=90).toPandas()
    assert len(got) == len(made) and sorted(got["node"]) == sorted(m[0] for m in made)
    vectors = {i: np.array(v, np.float32).astype(float) for i, v, _ in made}
    for label in (0, 1, None):
        mine = got[got["label"].isna() if label is None else got["label"] == label].sort_values("position")
        assert mine["position"].tolist() == list(range(len(mine)))
        x = np.stack([vectors[i] for i in sorted(mine["node"])])
        x /= np.sqrt((x * x).sum(1, keepdims=True))
        d, ids = 1 - x @ x.T, sorted(mine["node"])
        length = lambda o: sum(d[a, b] for a, b in itertools.pairwise(o))  # noqa: E731, B023
        assert length([ids.index(i) for i in mine["node"]]) == pytest.approx(length(linkage.optimal_order(clusters.linkage(d), d)), abs=1e-9)


@pytest.mark.parametrize("call, distance", [(0, 0), (300, 1), (20_000, 4), (1e9, 4)])
def test_optimal_order_either_way(monkeypatch, call, distance):
    """Costs kept for pairs of leaves or asked again by part: the same sums as brute force."""
    monkeypatch.setattr(leaves, "CALL", call)
    monkeypatch.setattr(leaves, "DISTANCE", distance)
    rng = np.random.default_rng(2)
    for n in (2, 3, 5, 8, 8, 8):
        x = rng.normal(size=(n, 2))
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
        for steps in (clusters.linkage(d), [(0, i, 0.0) for i in range(1, n)]):
            got, ways = linkage.optimal_order(steps, d), tree_orders(steps, n)
            length = lambda o: sum(d[a, b] for a, b in itertools.pairwise(o))  # noqa: E731, B023
            assert got in ways and length(got) == pytest.approx(min(map(length, ways)))


def test_memory_of_leaf_orders():
    """Far less than a square matrix, where the tree is not one-sided."""
    import tracemalloc

    v = np.random.default_rng(5).normal(size=(3000, 16))
    v /= np.sqrt((v * v).sum(1, keepdims=True))
    steps = clusters.linkage(clusters.cosine_distances(v))
    tracemalloc.start()
    order = linkage.optimal_order(steps, lambda a, b: 1 - v[a] @ v[b].T)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(order) == list(range(3000)) and peak < 8 * 3000 * 3000
