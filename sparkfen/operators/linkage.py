"""Average linkage of groups of any size, and the best order of a dendrogram's leaves.

With vectors of length 1 the mean cosine distance of two clusters follows from their sums, so no square matrix is needed: a cluster is
(members, sum). Average linkage is reducible, that is no merge brings a cluster nearer to others than its parts were; so
all pairs that are each other's nearest merge at once, and a nearest neighbour stays one until it is merged itself.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfen.operators.leaves import optimal_order
from sparkfen.session import cut

#: Clusters in a block; two blocks meet in a task of the search for neighbours, so many rows at once.
BLOCK, ROWS = 4096, 512
#: Distances are compared to this many digits, so that both ends of a pair see the same one.
DIGITS = 12


def _nearest(stale: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
    """The nearest of `others` for each stale cluster; of equal ones the smallest."""
    if not len(stale) or not len(others):
        return pd.DataFrame({"g": [], "cid": [], "nn": [], "d": []})
    others = others.sort_values("cid")
    a, b = np.stack(stale["s"].to_numpy()) / stale["n"].to_numpy()[:, None], np.stack(others["s"].to_numpy()) / others["n"].to_numpy()[:, None]
    cid, other, at, least = stale["cid"].to_numpy(), others["cid"].to_numpy(), np.zeros(len(a), int), np.zeros(len(a))
    for i in range(0, len(a), ROWS):
        d = np.round(1 - a[i : i + ROWS] @ b.T, DIGITS)
        d[cid[i : i + ROWS, None] == other[None, :]] = np.inf
        at[i : i + ROWS], least[i : i + ROWS] = d.argmin(1), d.min(1)
    out = pd.DataFrame({"g": stale["g"].to_numpy(), "cid": cid, "nn": other[at], "d": least})
    return out[np.isfinite(out["d"])]


def neighbours(state: DataFrame, block: int = BLOCK) -> DataFrame:
    """(g, cid, nn, d) of the clusters (g, cid, n, s, nn) without a known nearest neighbour, each block of them against all blocks."""
    blocks = state.groupBy("g").agg(F.ceil(F.count("*") / block).cast("int").alias("__m"), F.ceil(F.count_if(F.col("nn").isNull()) / block).cast("int").alias("__k"))
    rows = state.join(blocks, "g")
    deal = lambda most: F.pmod(F.xxhash64("cid"), most).cast("int")
    each = lambda most: F.explode(F.sequence(F.lit(0), most - 1))
    stale = rows.filter("nn is null").select("g", "cid", "n", "s", deal(F.col("__k")).alias("ba"), each(F.col("__m")).alias("bb"))
    others = rows.filter("__k > 0").select(*[F.col(c).alias(c) for c in ("g", "cid", "n", "s")], deal(F.col("__m")).alias("bb"), each(F.col("__k")).alias("ba"))
    keys = ("g", "ba", "bb")
    found = stale.groupBy(*keys).cogroup(others.groupBy(*keys)).applyInPandas(_nearest, "g string, cid long, nn long, d double")
    return found.groupBy("g", "cid").agg(F.min(F.struct("d", "nn")).alias("x")).select("g", "cid", "x.nn", "x.d")


def merge_rounds(state: DataFrame, most: int, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(merges, clusters): clusters (g, cid, n, s) merged until no group has more than `most`. A merge (g, a, b, height) puts b into a,
    the smaller id. Each round is written to the shared folder."""
    state = cut(state.select("g", "cid", "n", "s", F.lit(None).cast("long").alias("nn"), F.lit(None).cast("double").alias("d")))
    merges = None
    while True:
        large = cut(state.groupBy("g").agg(F.count("*").alias("c")).filter(F.col("c") > most).select("g"))
        if large.isEmpty():
            break
        small, big = state.join(large, "g", "left_anti"), state.join(large, "g", "left_semi")
        fresh = neighbours(big, block).select("g", "cid", F.col("nn").alias("nn2"), F.col("d").alias("d2"))
        big = cut(big.join(fresh, ["g", "cid"], "left").select("g", "cid", "n", "s", F.coalesce("nn", "nn2").alias("nn"), F.coalesce("d", "d2").alias("d")))
        ends = big.select("g", F.col("cid").alias("b"), F.col("nn").alias("back"), "n", "s")
        both = big.select("g", F.col("cid").alias("a"), F.col("nn").alias("b"), F.col("d").alias("height")).filter("a < b").join(ends.select("g", "b", "back"), ["g", "b"]).filter("back = a").select("g", "a", "b", "height")
        # Rounding may leave a group without such a pair; then its nearest two merge.
        nearest = big.groupBy("g").agg(F.min(F.struct("d", F.least("cid", "nn").alias("a"), F.greatest("cid", "nn").alias("b"))).alias("x")).join(both.select("g").distinct(), "g", "left_anti")
        pairs = cut(both.union(nearest.select("g", "x.a", "x.b", "x.d")))
        touched = pairs.select("g", F.col("a").alias("t")).union(pairs.select("g", "b"))
        gone = pairs.select("g", F.col("b").alias("cid"), F.col("a").alias("into"))
        parts = big.join(gone, ["g", "cid"], "left")
        into = parts.filter("into is not null").select("g", F.col("into").alias("cid"), F.col("n").alias("n2"), F.col("s").alias("s2"))
        grown = parts.filter("into is null").drop("into").join(into, ["g", "cid"], "left")
        lost = touched.select("g", F.col("t").alias("nn"), F.lit(True).alias("lost"))
        new = F.col("n2").isNotNull()
        grown = grown.join(lost, ["g", "nn"], "left")
        keep = ~new & F.col("lost").isNull()
        now = grown.select(
            "g", "cid", (F.col("n") + F.coalesce("n2", F.lit(0))).alias("n"), F.when(new, F.zip_with("s", "s2", lambda x, y: x + y)).otherwise(F.col("s")).alias("s"),
            F.when(keep, F.col("nn")).alias("nn"), F.when(keep, F.col("d")).alias("d"),
        )
        state = cut(small.unionByName(now))
        merges = pairs if merges is None else merges.union(pairs)
    none = state.select("g", F.col("cid").alias("a"), F.col("cid").alias("b"), F.lit(0.0).alias("height")).filter("1 = 0")
    return none if merges is None else merges, state.select("g", "cid", "n", "s")


def large_dendrograms(rows: DataFrame, most: int, block: int = BLOCK) -> DataFrame:
    """(g, a, b, height) of all merges of each group of (g, node, v), whatever its size: rounds while it has more than `most` clusters, then
    one task. A merge puts the cluster named b into that named a; names are smallest members. With a column n a row stands for n
    equal vectors."""
    from sparkfen.operators.clusters import cosine_distances, linkage

    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    unit = F.when(length > 0, F.transform("v", lambda x: x / length)).otherwise(F.transform("v", lambda x: F.lit(0.0)))
    if "n" in rows.columns:
        start = rows.select("g", F.col("node").alias("cid"), "n", F.transform(unit, lambda x: x * F.col("n")).alias("s"))
    else:
        start = rows.select("g", F.col("node").alias("cid"), F.lit(1).cast("long").alias("n"), unit.alias("s"))
    merges, left = merge_rounds(start, most, block)

    def finish(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("cid")
        names, n = group["cid"].to_numpy(), group["n"].to_numpy(float)
        v = np.stack(group["s"].to_numpy()) / n[:, None]
        steps = linkage(cosine_distances(v), n)
        return pd.DataFrame({"g": group["g"].iloc[0], "a": names[[s[0] for s in steps]], "b": names[[s[1] for s in steps]], "height": [s[2] for s in steps]})

    return merges.union(left.groupBy("g").applyInPandas(finish, "g string, a long, b long, height double"))


def clusters_at(merges: DataFrame, nodes: DataFrame, cuts: Sequence[float]) -> DataFrame:
    """(g, node, cut, cluster): nodes (g, node) by the merges (g, a, b, height) up to each cut height; by pointers that double their reach."""
    heights = F.explode(F.array(*[F.lit(float(c)) for c in cuts])).alias("cut")
    up = merges.select("g", F.col("b").alias("node"), F.col("a").alias("to"), "height", heights).filter("height <= cut").select("g", "cut", "node", "to")
    now = cut(nodes.select("g", "node", heights).join(up, ["g", "cut", "node"], "left").select("g", "cut", "node", F.coalesce("to", "node").alias("to")))
    while True:
        ahead = now.select("g", "cut", F.col("node").alias("to"), F.col("to").alias("next"))
        new = cut(now.join(ahead, ["g", "cut", "to"]).select("g", "cut", "node", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")))
        now = new.drop("moved")
        if new.filter("moved").isEmpty():
            return now.select("g", "node", "cut", F.col("to").alias("cluster"))


def leaf_orders(vectors: DataFrame, by: str, key: str = "vec_id", vector: str = "embedding", most: int = 100_000, square: int = 4_000) -> DataFrame:
    """(by, node, position): the leaves of each group's average-linkage dendrogram by cosine distance, in the optimal order.

    Equal vectors are one leaf, whose members stand side by side. The dendrogram of more than `square` leaves is made over all tasks.
    The order is found in one task from its merges and the vectors, without a matrix of all pairs; more than `most` vectors in a
    group are an error, found by counting.
    """
    from sparkfen.operators.clusters import cosine_distances, linkage

    rows = vectors.select(F.col(by), F.col(key).cast("long").alias("node"), F.col(vector).cast("array<double>").alias("v")).filter("node is not null and v is not null")
    large = rows.groupBy(by).agg(F.count("*").alias("n")).filter(F.col("n") > most).first()
    if large:
        raise ValueError(f"a group of {large.n} vectors; the bound is {most}")
    classes = cut(rows.groupBy(by, "v").agg(F.sort_array(F.collect_list("node")).alias("nodes")).select(by, "v", "nodes", F.col("nodes")[0].alias("node"), F.size("nodes").cast("long").alias("n")))
    schema = f"{by} {dict(rows.dtypes)[by]}, node long, position long"

    def unit(group: pd.DataFrame) -> np.ndarray:
        v = np.stack(group["v"].to_numpy())
        length = np.sqrt((v * v).sum(1, keepdims=True))
        return np.divide(v, length, out=np.zeros_like(v), where=length > 0)

    def placed(group: pd.DataFrame, steps: Sequence[tuple[int, int, float]], v: np.ndarray) -> pd.DataFrame:
        nodes = group["nodes"].to_numpy()[optimal_order(steps, lambda a, b: cosine_distances(v[a], v[b]))]
        return pd.DataFrame({by: group[by].iloc[0], "node": np.concatenate(nodes), "position": range(int(group["n"].sum()))})

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("node")
        v = unit(group)
        return placed(group, linkage(cosine_distances(v), group["n"].to_numpy()), v)

    def run_merged(group: pd.DataFrame, merges: pd.DataFrame) -> pd.DataFrame:
        group, merges = group.sort_values("node"), merges.sort_values(["height", "a", "b"])
        a, b = (np.searchsorted(group["node"], merges[c]) for c in "ab")
        return placed(group, list(zip(a, b, merges["height"])), unit(group))

    apart = cut(classes.groupBy(by).agg(F.count("*").alias("c")).filter(F.col("c") > square).select(F.col(by).alias("__by")))
    if apart.isEmpty():
        return classes.groupBy(by).applyInPandas(run, schema)
    same = F.col(by).eqNullSafe(F.col("__by"))
    whole = cut(classes.join(apart, same, "left_semi").withColumn("g", F.to_json(F.struct(by))))
    merged = whole.groupBy("g").cogroup(large_dendrograms(whole, square).groupBy("g")).applyInPandas(run_merged, schema)
    return classes.join(apart, same, "left_anti").groupBy(by).applyInPandas(run, schema).union(merged)
