"""Mixing overlapping sources to target weights by min-cost flow.

Documents are reduced to membership patterns (the set of sources a document belongs to). Token capacity flows from
patterns to the sources' quotas; a pattern's capacity comes in copies, and the k-th copy of a token costs k - 1, so
repeats are spread before anything is repeated often. The solved flow says how many words to take of each pattern; the
documents are then chosen in a seeded order.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkfen.llm.common import words_of
from sparkfen.session import cut, scratch_path

#: The weights of sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
#: Documents of a pattern are cut into seeded groups of about this many, within which they are put in order.
GROUP = 2_000


def targets_of(sizes: dict[str | None, int], weights: Sequence[float] = WEIGHTS, cap: float = MAX_COPIES) -> dict[str | None, float]:
    """Shares of the total by weight, none above cap times its source's size; what is cut goes to the others by weight."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out: dict[str | None, float] = {}
    left, open_ = float(sum(sizes.values())), list(names)
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > cap * sizes[s]]
        if not over:
            out |= {s: left * weight[s] / total for s in open_}
            break
        out |= {s: float(cap * sizes[s]) for s in over}
        left -= sum(out[s] for s in over)
        open_ = [s for s in open_ if s not in out]
    return out


def route(patterns: dict[tuple, int], quotas: dict[object, int], copies: int = MAX_COPIES) -> dict[tuple[tuple, object], int]:
    """Words of each (pattern, source) in a flow of least cost among those that fill the quotas as far as they go.

    patterns: members -> words. The k-th copy of a pattern costs k - 1 a word. Primal-dual: one search for the distances at each
    price of a path, of which there are few, then blocking flows along the shortest paths, so many patterns are routed at once.
    """
    names = list(patterns)
    node = {("p", p): 2 + i for i, p in enumerate(names)} | {("s", s): 2 + len(names) + i for i, s in enumerate(quotas)}
    graph: list[list[int]] = [[] for _ in range(2 + len(node))]
    head, room, cost = [], [], []

    def arc(a: int, b: int, capacity: int, price: int) -> int:
        for x, y, c, w in ((a, b, capacity, price), (b, a, 0, -price)):
            graph[x].append(len(head))
            head.append(y)
            room.append(c)
            cost.append(w)
        return len(head) - 2

    for p in names:
        for k in range(copies):
            arc(0, node["p", p], patterns[p], k)
    flow = {(p, s): arc(node["p", p], node["s", s], copies * patterns[p], 0) for p in names for s in dict.fromkeys(p) if s in quotas}
    for s, q in quotas.items():
        arc(node["s", s], 1, q, 0)
    height = [0] * len(graph)
    while True:
        far: list[int | None] = [None] * len(graph)
        far[0], heap = 0, [(0, 0)]
        while heap:
            d, at = heapq.heappop(heap)
            if d > far[at]:
                continue
            for e in graph[at]:
                if room[e] > 0:
                    new = d + cost[e] + height[at] - height[head[e]]
                    if far[head[e]] is None or new < far[head[e]]:
                        far[head[e]] = new
                        heapq.heappush(heap, (new, head[e]))
        if far[1] is None:
            break
        height = [h + (f if f is not None else far[1]) for h, f in zip(height, far)]
        while _block(graph, head, room, cost, height):
            pass
    return {k: room[e ^ 1] for k, e in flow.items() if room[e ^ 1]}


def _block(graph: list[list[int]], head: list[int], room: list[int], cost: list[int], height: list[int]) -> bool:
    """Fills shortest paths from node 0 to 1 until none of the present number of steps is left; whether any was filled."""
    free = lambda at, e: room[e] > 0 and cost[e] + height[at] == height[head[e]]
    step, line = {0: 0}, [0]
    for at in line:
        for e in graph[at]:
            if head[e] not in step and free(at, e):
                step[head[e]] = step[at] + 1
                line.append(head[e])
    if 1 not in step:
        return False
    turn, path, at = [0] * len(graph), [], 0
    while True:
        if at == 1:
            push = min(room[e] for e in path)
            for e in path:
                room[e] -= push
                room[e ^ 1] += push
            k = next(i for i, e in enumerate(path) if not room[e])
            at = head[path[k] ^ 1]
            del path[k:]
            continue
        edges, i = graph[at], turn[at]
        while i < len(edges) and not (step.get(head[edges[i]]) == step[at] + 1 and free(at, edges[i])):
            i += 1
        turn[at] = i
        if i < len(edges):
            path.append(edges[i])
            at = head[edges[i]]
        elif path:
            at = head[path.pop() ^ 1]
            turn[at] += 1
        else:
            return True


def choose(rows: DataFrame, quota: DataFrame, seed: int) -> DataFrame:
    """rows (rid, key, th, pattern, size) with copies: whole copies of every document, and one more of a seeded part.

    quota: (q_pattern, n, words, take). A pattern's documents are put in the order of a seeded hash of key and text, cut into groups
    of about GROUP documents; sums of groups, in two levels, say which are taken whole, and the one in which the quota ends is
    filled document by document, so no task holds a pattern. Where more than GROUP rows have the same key and text, their place (rid)
    decides among them, so that they spread over groups too.
    """
    copies = rows.groupBy("key", "th").agg(F.count("*").alias("same")).filter(F.col("same") > GROUP)
    hot = copies.select(F.col("key").alias("h_key"), F.col("th").alias("h_th"), F.lit(True).alias("many"))
    known = rows.join(hot, F.col("key").eqNullSafe(F.col("h_key")) & F.col("th").eqNullSafe(F.col("h_th")), "left").drop("h_key", "h_th")
    u = F.pmod(F.xxhash64("key", "th", F.when(F.col("many"), F.col("rid")), F.lit(seed)), F.lit(1 << 40))
    full = F.when(F.col("words") > 0, F.floor(F.col("take") / F.col("words"))).otherwise(0)
    groups = F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(GROUP)))
    placed = known.join(quota, F.col("pattern").eqNullSafe(F.col("q_pattern"))).withColumns({"u": u, "full": full, "rest": F.col("take") - full * F.col("words")})
    placed = placed.withColumn("g", F.floor(F.col("u") * groups / F.lit(1 << 40))).withColumn("gg", F.floor(F.col("g") / F.lit(GROUP)))
    placed = placed.select(*rows.columns, "u", "full", "rest", "g", "gg")
    sums = placed.groupBy("pattern", "gg", "g").agg(F.sum("size").alias("gs"))
    coarse = sums.groupBy("pattern", "gg").agg(F.sum("gs").alias("ggs")).withColumn("first", F.sum("ggs").over(W.partitionBy("pattern").orderBy("gg")) - F.col("ggs"))
    inside = F.sum("gs").over(W.partitionBy("pattern", "gg").orderBy("g")) - F.col("gs")
    before = sums.withColumn("inside", inside).join(coarse.select(F.col("pattern").alias("c_pattern"), F.col("gg").alias("c_gg"), "first"), F.col("pattern").eqNullSafe(F.col("c_pattern")) & (F.col("gg") == F.col("c_gg")))
    before = before.select(F.col("pattern").alias("b_pattern"), F.col("g").alias("b_g"), "gs", (F.col("first") + F.col("inside")).alias("base"))
    joined = placed.join(before, F.col("pattern").eqNullSafe(F.col("b_pattern")) & (F.col("g") == F.col("b_g"))).drop("b_pattern", "b_g", "gg")
    whole = (F.col("base") + F.col("gs") <= F.col("rest")) | (F.col("base") >= F.col("rest"))
    clear = joined.filter(whole).withColumn("more", (F.col("base") < F.col("rest")).cast("int"))
    schema = T.StructType([*joined.schema.fields, T.StructField("more", T.IntegerType())])
    edge = joined.filter(~whole).groupBy("pattern", "g").applyInPandas(fill, schema)
    return clear.unionByName(edge).withColumn("copies", (F.col("full") + F.col("more")).cast("long")).select(*rows.columns, "copies")


def fill(group: pd.DataFrame) -> pd.DataFrame:
    """Of one group in seeded order, each document that still fits; then the smallest left, if that ends nearer."""
    group = group.sort_values(["u", "key", "size", "rid"], kind="stable").reset_index(drop=True)
    left, more = int(group["rest"].iloc[0] - group["base"].iloc[0]), []
    for size in group["size"].tolist():
        more.append(int(0 < size <= left))
        left -= size * more[-1]
    rest = [(size, i) for i, (size, m) in enumerate(zip(group["size"].tolist(), more)) if size and not m]
    if rest and 2 * left > min(rest)[0]:
        more[min(rest)[1]] = 1
    return group.assign(more=more)


def mix(docs: DataFrame, members: Column, key: Column, weights: Sequence[float] = WEIGHTS, cap: int = MAX_COPIES, seed: int = 7, text: str = "text", rid: Column | None = None, max_patterns: int = 20_000) -> DataFrame:
    """(rid, key, pattern, size, copies, source_size, target): a row for each row of docs; the last two are of its first source.

    members: an array of source names (null is a source of its own; an empty or null array is no source, never taken).
    key: what the seeded order goes by, with the text; both may be missing or repeat. size: words, 0 of a missing text. rid: a number
    of each row, if the rows are to be found again (by default its place in the scan). The text is read once: keys,
    patterns and sizes are written to the shared folder. Only sums by pattern go to the driver: more than max_patterns
    patterns are an error (the flow of 20,000 patterns over 20 sources took the driver 3 seconds).
    """
    place = F.monotonically_increasing_id() if rid is None else rid
    sized = docs.select(place.alias("rid"), key.alias("key"), F.xxhash64(F.col(f"`{text}`")).alias("th"), F.coalesce(members, F.array().cast("array<string>")).alias("pattern"), F.size(words_of(F.col(f"`{text}`"))).cast("long").alias("size"))
    rows = cut(sized)
    sums = rows.groupBy("pattern").agg(F.sum("size").alias("words"), F.count("*").alias("n")).limit(max_patterns + 1).collect()
    if len(sums) > max_patterns:
        raise ValueError(f"more than {max_patterns} patterns")
    sums.sort(key=lambda r: [(s is None, s or "") for s in r.pattern])  # of equally good flows the same one each time
    patterns: dict[tuple, int] = {}
    sizes: dict = {}
    for r in sums:
        patterns[tuple(r.pattern)] = r.words
        for s in dict.fromkeys(r.pattern):
            sizes[s] = sizes.get(s, 0) + r.words
    goal = targets_of(sizes, weights, cap)
    taken = route(patterns, {s: round(t) for s, t in goal.items()}, cap)
    take: dict = {}
    for (p, _), words in taken.items():
        take[p] = take.get(p, 0) + words
    quotas = [(list(r.pattern), r.n, r.words, take.get(tuple(r.pattern), 0), sizes.get(r.pattern[0], 0) if r.pattern else None, goal.get(r.pattern[0], 0.0) if r.pattern else None) for r in sums]
    schema = T.StructType([T.StructField("q_pattern", T.ArrayType(T.StringType())), *(T.StructField(n, T.LongType()) for n in ("n", "words", "take", "source_size")), T.StructField("target", T.DoubleType())])
    quota = docs.sparkSession.createDataFrame(quotas, schema)
    chosen = choose(rows, quota.drop("source_size", "target"), seed)
    return chosen.join(quota.select("q_pattern", "source_size", "target"), F.col("pattern").eqNullSafe(F.col("q_pattern"))).drop("q_pattern", "th")


def digest(docs: DataFrame) -> DataFrame:
    """The columns of the query over documents."""
    mixed = mix(docs, F.array("source"), F.col("doc_id"))
    return mixed.select(F.col("key").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def apply_mix(docs: DataFrame, members: Column | None = None, seed: int = 7) -> DataFrame:
    """docs as the mix takes them: a row for each copy, none for what it leaves out. members: by default the column source alone.

    Each row has the copies that were solved for it, also where rows share a doc_id, have none, or are equal. Documents
    without words (or a text) add nothing to any target and are left out. All columns come back as they were, whatever
    their names. The rows are numbered and written to the shared folder first, as they are read twice.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "mixing")
    docs.select(F.monotonically_increasing_id().alias("rid"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).write.parquet(path)
    rows = spark.read.parquet(path)
    of = rows.select(F.col("rid").alias("__rid"), "row.*")
    plan = mix(of, F.array("source") if members is None else members, F.col("doc_id"), seed=seed, rid=F.col("__rid"))
    taken = plan.filter("copies > 0 and size > 0").select("rid", "copies")
    return rows.join(taken, "rid").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).select("row.*")
