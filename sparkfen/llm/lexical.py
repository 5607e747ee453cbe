"""The best documents for each test item by integer term weights, with norm buckets in the manner of LEMP.

A document is an impact vector over the items' vocabulary. Vectors are written with their length; the longest ones are
scored first and give each item a threshold, its k-th best score so far. All others are read longest first in buckets of
some thousands: a bucket is skipped for an item if the bucket's greatest length times the item's is below the item's threshold
(Cauchy-Schwarz); inside, the coordinates of an item's heaviest terms must lie in the range that the threshold leaves
for them. What survives is scored anew in 64-bit integers, so the bounds, which are doubles with a margin, never decide.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from sparkfen.llm.decontaminate import TABLE, words_of
from sparkfen.session import scratch_path

TOP = 50
#: terms: uint32 numbers of the vocabulary's terms, ascending; times: how often each occurs (uint32).
COUNTED = T.StructType([T.StructField("key", T.LongType()), T.StructField("n", T.LongType()), T.StructField("terms", T.BinaryType()), T.StructField("times", T.BinaryType())])
FOUND = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("key", T.LongType()), T.StructField("score", T.LongType())])
#: Bounds are raised by this share, far above the rounding of a sum of doubles.
SLACK = 1e-9


def counted(data: bytes, numbers: dict[bytes, int], stretch: int = 1 << 22) -> tuple[int, Counter]:
    """All terms of a text and how often each of the vocabulary occurs; long texts are cut between words."""
    text, at, n, times = data.translate(TABLE), 0, 0, Counter()
    while at < len(text):
        end = text.find(b" ", at + stretch)
        words = text[at : end if end >= 0 else len(text)].split()
        n += len(words)
        times.update(filter(None, map(numbers.get, words)))
        at += len(text) if end < 0 else end - at + 1
    return n, times


def index(docs: DataFrame, vocabulary: list[bytes], key: str = "doc_id", text: str = "text") -> DataFrame:
    """COUNTED of each row with at least one term, in the shared folder; one pass over the texts, and no shuffle."""
    spark = docs.sparkSession
    numbers = spark.sparkContext.broadcast({w: i + 1 for i, w in enumerate(vocabulary)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = numbers.value
        for batch in batches:
            rows = []
            for k, cell in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                n, times = counted(cell.as_py(), known)
                if n:
                    pairs = np.array(sorted(times.items()), "<u4").reshape(-1, 2)
                    rows.append((k, n, (pairs[:, 0] - 1).astype("<u4").tobytes(), pairs[:, 1].copy().tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=COUNTED.names)

    path = scratch_path(spark, "terms")
    docs.select(F.col(f"`{key}`").cast("long"), F.col(f"`{text}`")).filter(F.col(f"`{text}`").isNotNull()).mapInArrow(run, COUNTED).write.parquet(path)
    return spark.read.schema(COUNTED).parquet(path)


def frequencies(rows: DataFrame, size: int) -> np.ndarray:
    """df of each term of the vocabulary: counts of each task are added up, `size` rows a task at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(size, np.int64)
        for batch in batches:
            out += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u4"), minlength=size)
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(out[at])], names=["term", "df"])

    out = np.zeros(size, np.int64)
    for r in rows.select("terms").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r.term] = r.df
    return out


class Scorer:
    """weights: w of each term; items: the term numbers of each; total: N; length: L; floors: the scores to reach."""

    def __init__(self, weights: np.ndarray, items: list[np.ndarray], total: int, length: int, floors: np.ndarray, top: int) -> None:
        self.weights, self.roots, self.total, self.length, self.floors, self.top = weights, np.sqrt(weights.astype(float)), total, length, floors, top
        self.items = [t[weights[t] > 0] for t in items]
        self.norms = [float(np.sqrt(weights[t].sum())) for t in self.items]
        self.heavy = [t[np.argsort(-weights[t], kind="stable")][:3] for t in self.items]
        self.skipped = 0  # documents that no item's score was computed for, over all items

    def impacts(self, n: np.ndarray, ends: np.ndarray, times: np.ndarray) -> np.ndarray:
        """The impact of each posting of documents with n terms, whose postings end at ends."""
        m = 50 + 50 * n * self.total // self.length
        return 1_000_000_000 * times // (1000 * times + 20 * np.repeat(m, np.diff(ends, prepend=0)))

    def lengths(self, ends: np.ndarray, terms: np.ndarray, impacts: np.ndarray) -> np.ndarray:
        """The length of each vector, whose coordinate at a term is impact * sqrt(weight)."""
        return np.sqrt(np.add.reduceat(impacts.astype(float) ** 2 * self.weights[terms], np.r_[0, ends[:-1]]))

    def bucket(self, keys: list, n: np.ndarray, ends: np.ndarray, terms: np.ndarray, times: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(item, places, scores) of the documents of one bucket that can be among an item's best."""
        impacts = self.impacts(n, ends, times)
        lengths = self.lengths(ends, terms, impacts)
        doc = np.repeat(np.arange(len(n)), np.diff(ends, prepend=0))
        order = np.argsort(terms, kind="stable")
        by_term, doc, impacts = terms[order], doc[order], impacts[order]
        longest = float(lengths.max())
        for i, (mine, norm) in enumerate(zip(self.items, self.norms)):
            floor = float(self.floors[i])
            if longest * norm * (1 + SLACK) < floor or not len(mine):
                self.skipped += len(n)
                continue
            low, high = np.searchsorted(by_term, mine, "left"), np.searchsorted(by_term, mine, "right")
            fits = None
            if floor > 0:
                fits = lengths * norm * (1 + SLACK) >= floor
                angle = np.arccos(np.minimum(1.0, floor / (lengths * norm * (1 + SLACK)))) + 1e-7
                for t in self.heavy[i]:
                    own = math.acos(min(1.0, self.roots[t] / norm))
                    least = np.where(own + angle < math.pi / 2, np.cos(np.minimum(own + angle, math.pi / 2)), 0.0)
                    most = np.cos(np.maximum(0.0, own - angle))
                    at = np.zeros(len(n))
                    a, b = np.searchsorted(by_term, [t, t + 1])
                    at[doc[a:b]] = impacts[a:b] * self.roots[t]
                    fits &= (at >= least * lengths * (1 - SLACK)) & (at <= most * lengths * (1 + SLACK) + 1e-6)
                if not fits.any():
                    self.skipped += len(n)
                    continue
                self.skipped += int((~fits).sum())
            scores = np.zeros(len(n), np.int64)
            for t, a, b in zip(mine.tolist(), low.tolist(), high.tolist()):
                at, made = doc[a:b], impacts[a:b]
                if fits is not None:
                    left = fits[at]
                    at, made = at[left], made[left]
                scores[at] += int(self.weights[t]) * made
            places = np.flatnonzero(scores >= max(1, int(self.floors[i])))
            if len(places) > self.top:
                places = places[scores[places] >= np.partition(scores[places], -self.top)[-self.top]]
                self.floors[i] = max(self.floors[i], scores[places].min())
            if len(places):
                yield i, places, scores[places]


class Best:
    """The best of each item in one task: equal scores by ascending key, missing keys first."""

    def __init__(self, top: int) -> None:
        self.top, self.rows = top, {}

    def add(self, item: int, keys: list, scores: list[int]) -> int:
        """Takes candidates; the score that others must reach, 0 while there are too few."""
        new = sorted(self.rows.get(item, []) + [(-s, k is not None, k or 0) for k, s in zip(keys, scores)])[: self.top]
        self.rows[item] = new
        return -new[-1][0] if len(new) == self.top else 0


def _search(rows: DataFrame, state, top: int, bucket: int) -> DataFrame:
    """FOUND: the best of each task's rows for each item, from the rows in the order they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, items, total, length, floors = state.value
        scorer, best = Scorer(weights, items, total, length, floors.copy(), top), Best(top)
        for whole in batches:
            for at in range(0, whole.num_rows, bucket):
                batch = whole.slice(at, bucket)
                keys, terms, times = batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()
                ends = np.cumsum([len(t) // 4 for t in terms])
                flat = lambda x: np.frombuffer(b"".join(x), "<u4").astype(np.int64)
                for i, places, scores in scorer.bucket(keys, batch.column(1).to_numpy(), ends, flat(terms), flat(times)):
                    floor = best.add(i, [keys[p] for p in places.tolist()], scores.tolist())
                    scorer.floors[i] = max(scorer.floors[i], floor)
        for i, found in best.rows.items():
            yield pa.RecordBatch.from_arrays([pa.array([i] * len(found), pa.int32()), pa.array([k if there else None for _, there, k in found], pa.int64()), pa.array([-s for s, _, _ in found], pa.int64())], names=FOUND.names)

    return rows.select("key", "n", "terms", "times").mapInArrow(run, FOUND)


def best_of(found: DataFrame, top: int) -> DataFrame:
    """The best of each item of all tasks. Each task has cut its own already; groups of them do so again before the last."""
    order = lambda *by: W.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_first("key"))
    some = found.withColumn("__salt", F.pmod(F.xxhash64("key", "score"), F.lit(64))).withColumn("rank", F.row_number().over(order("item", "__salt"))).filter(F.col("rank") <= top)
    return some.withColumn("rank", F.row_number().over(order("item"))).filter(F.col("rank") <= top).drop("__salt")


def rank_documents(docs: DataFrame, items: DataFrame, top: int = TOP, head_rows: int = 20_000, bucket: int = 4096, max_item_bytes: int = 16_000_000) -> DataFrame:
    """(item_id, rank, doc_id, score) of the `top` best documents of each item, all of them if fewer have a score above 0.

    Equal items are one; items that share an id, or have none, are ranked each on its own. An item or a document
    that is missing, or has no term, has no score. Repeated rows of docs are documents of their own; equal scores go by
    ascending doc_id, missing ones first. Empty tables give no rows; other columns are not looked at.

    The items' vocabulary goes to each task, so more than max_item_bytes of item text is an error. head_rows
    longest vectors, or somewhat more, are searched first; their number only decides how early thresholds are known.
    A task holds the best of each item and one bucket. Texts are read once; their vectors lie in the shared folder.
    """
    spark = docs.sparkSession
    chosen = items.select(F.col("item_id"), F.col("text")).filter("text is not null").distinct()
    size = chosen.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if size > max_item_bytes:
        raise ValueError(f"{size} bytes of items; the bound is {max_item_bytes}")
    rows = [(r.item_id, sorted(set(words_of(r.text.encode())))) for r in chosen.collect()]
    vocabulary = sorted({w for _, words in rows for w in words})
    numbers = {w: i for i, w in enumerate(vocabulary)}
    wanted = [np.array([numbers[w] for w in words], np.int64) for _, words in rows]
    kind = items.schema["item_id"].dataType
    names = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", kind)]))

    counted_rows = index(docs, vocabulary)
    total, length = counted_rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * df + 1))) for df in frequencies(counted_rows, len(vocabulary)).tolist()], np.int64)
    state = spark.sparkContext.broadcast((weights, wanted, total, length, np.zeros(len(rows), np.int64)))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, wants, total, length, floors = state.value
        scorer = Scorer(w, wants, total, length, floors, top)
        for batch in batches:
            flat = lambda c: np.frombuffer(b"".join(c.to_pylist()), "<u4").astype(np.int64)
            ends = np.cumsum([len(t.as_py()) // 4 for t in batch.column(2)])
            terms = flat(batch.column(2))
            made = scorer.lengths(ends, terms, scorer.impacts(batch.column(1).to_numpy(), ends, flat(batch.column(3))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made)], names=[*batch.schema.names, "size"])

    path = scratch_path(spark, "vectors")
    schema = T.StructType([*COUNTED.fields, T.StructField("size", T.DoubleType())])
    counted_rows.filter("octet_length(terms) > 0").mapInArrow(measured, schema).sortWithinPartitions(F.desc("size")).write.parquet(path)
    vectors = spark.read.schema(schema).parquet(path)
    share = 1 - head_rows / max(1, total)
    edge = vectors.agg(F.percentile_approx("size", share, 1000)).first()[0] if share > 0 else 0.0
    head = _search(vectors.filter(F.col("size") >= F.lit(edge or 0.0)), state, top, bucket)
    path = scratch_path(spark, "head")
    best_of(head, top).select("item", "key", "score", "rank").write.parquet(path)
    best = spark.read.schema("item int, key long, score long, rank int").parquet(path)
    floors = np.zeros(len(rows), np.int64)
    for r in best.filter(F.col("rank") == top).collect():
        floors[r.item] = r.score
    if share > 0:
        later = spark.sparkContext.broadcast((weights, wanted, total, length, floors))
        best = best_of(best.drop("rank").union(_search(vectors.filter(F.col("size") < F.lit(edge or 0.0)), later, top, bucket)), top)
    return best.join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), F.col("key").alias("doc_id"), "score")
