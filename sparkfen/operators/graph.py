"""Graph operators on edge frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfen.session import cut


def symmetric(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Both directions of each edge, once, without loops."""
    pairs = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst"))
    return pairs.union(pairs.select(F.col("dst"), F.col("src"))).filter("src <> dst").distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component): for each node of an edge, the smallest node it is connected with.

    Alternating large-star and small-star rounds: each round links a node's neighbours to the smallest of them, so the
    edge count never grows and long chains shorten fast. Each round is written to the shared folder. A node's
    neighbours are never gathered: both steps are a minimum by key and a join. Nulls and loops are dropped; a node with
    only a loop has no row. Not settling within max_rounds is an error.
    """
    now = cut(symmetric(edges, src, dst).filter("src > dst"))
    state = _state(now)
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.least(F.col("src"), F.min("dst")).alias("m"))
        large = both.join(least, "src").filter("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).filter("src <> dst").distinct()
        low = large.groupBy("src").agg(F.min("dst").alias("m"))
        small = large.join(low, "src")
        now = cut(small.select(F.when(F.col("dst") == F.col("m"), F.col("src")).otherwise(F.col("dst")).alias("src"), F.col("m").alias("dst")).filter("src <> dst").distinct())
        last, state = state, _state(now)
        if last == state:
            break
    else:
        raise RuntimeError(f"not settled after {max_rounds} rounds")
    return now.select(F.col("src").alias("node"), F.col("dst").alias("component")).union(now.select(F.col("dst"), F.col("dst")).distinct())


def _state(edges: DataFrame) -> tuple:
    """A digest of an edge set: equal sets have equal digests."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("dst", "src"))).first()
    return tuple(row)
