"""Token ids in files of directly addressable codes.

An id is split into chunks of BITS bits, lowest first. Level 0 holds the lowest chunk of every token, level k the next
chunk of those that continue; a bitmap for each level says which do, and a rank directory says how many did before each
block of BLOCK tokens. Any token is read by one bit test, one rank and one byte for each level; no block is decoded.

The files are Parquet tables of segments, one row each (written by Spark's committer, so a lost executor leaves no
half-written segment): shard, seg, first_doc, n_tokens, n_null, doc_ids and ends (int64 each) and codes. Segments
ordered by shard and seg hold the documents in ascending doc_id; the first n_null documents of one have no id.

codes: b"DACT", uint32 version, uint32 levels, uint32 block, uint64 n; then for each level uint64 n_level, the chunks (one
byte each), and, but for the last level, the bitmap (little-endian bits) and the directory (uint32 a block).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from sparkfen.llm.common import arrow_type, held
from sparkfen.llm.text_ids import TextIds
from sparkfen.llm.token_counts import tokenizer
from sparkfen.session import scratch_path

BITS, BLOCK = 8, 512
HEAD, COUNT = struct.Struct("<4sIIIQ"), struct.Struct("<Q")
END_ID = 2


def encode(ids: np.ndarray) -> bytes:
    """The codes of ids below 2**32."""
    left = np.ascontiguousarray(ids, np.uint32)
    levels: list[bytes] = []
    while True:
        more = left >> np.uint32(BITS)
        goes = more != 0
        parts = [COUNT.pack(len(left)), (left & np.uint32(0xFF)).astype(np.uint8).tobytes()]
        if not goes.any():
            levels.append(b"".join(parts))
            break
        sums = np.add.reduceat(goes, np.arange(0, len(left), BLOCK), dtype=np.int64)
        parts += [np.packbits(goes, bitorder="little").tobytes(), np.r_[0, np.cumsum(sums)[:-1]].astype("<u4").tobytes()]
        levels.append(b"".join(parts))
        left = more[goes]
    return HEAD.pack(b"DACT", 1, len(levels), BLOCK, len(ids)) + b"".join(levels)


class Codes:
    """Random and whole reads of one segment."""

    def __init__(self, data: bytes) -> None:
        magic, version, count, self.block, self.n = HEAD.unpack_from(data)
        if (magic, version) != (b"DACT", 1):
            raise ValueError("not a segment of codes")
        at, self.levels = HEAD.size, []
        for k in range(count):
            (n,) = COUNT.unpack_from(data, at)
            chunks = np.frombuffer(data, np.uint8, n, at + 8)
            at += 8 + n
            if k + 1 < count:
                bits = np.frombuffer(data, np.uint8, -(-n // 8), at)
                ranks = np.frombuffer(data, "<u4", -(-n // self.block), at + len(bits))
                at += len(bits) + 4 * len(ranks)
                self.levels.append((chunks, bits, ranks))
            else:
                self.levels.append((chunks, None, None))

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = shift = 0
        for chunks, bits, ranks in self.levels:
            value |= int(chunks[i]) << shift
            if bits is None or not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // self.block
            first, last = block * self.block // 8, i >> 3
            i = int(ranks[block]) + int(np.bitwise_count(bits[first:last]).sum()) + int(bits[last] & ((1 << (i & 7)) - 1)).bit_count()
            shift += BITS
        return value

    def all(self) -> np.ndarray:
        """Every id."""
        value = None
        for chunks, bits, _ in reversed(self.levels):
            now = chunks.astype(np.uint32)
            if bits is not None:
                now[np.unpackbits(bits, count=len(chunks), bitorder="little").view(bool)] |= value << np.uint32(BITS)
            value = now
        return value


LEAST = -(1 << 63)
PLACED = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("key", T.LongType()), T.StructField("h", T.LongType()), T.StructField("ids", T.BinaryType())])
SEGMENT = T.StructType([
    T.StructField("shard", T.IntegerType()), T.StructField("seg", T.IntegerType()), T.StructField("first_doc", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_null", T.LongType()),
    T.StructField("doc_ids", T.BinaryType()), T.StructField("ends", T.BinaryType()), T.StructField("codes", T.BinaryType()),
])


def key_ranges(rows: DataFrame, range_bytes: int) -> np.ndarray:
    """Upper bounds of all but the last of the ranges of `key` that hold about `range_bytes` of `text` each.

    There are as many ranges as shuffle partitions at least. The bounds come from an approximate quantile sketch, and
    one that repeats says that its key fills ranges alone.
    """
    size, least = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    count = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // range_bytes))
    shares = [i / count for i in range(1, count)]
    if not shares or not least:
        return np.empty(0, np.int64)
    found = rows.agg(F.percentile_approx(F.coalesce("key", F.lit(LEAST)), shares, max(10_000, 20 * count)).alias("b")).first().b
    return np.array(found, np.int64)


def write_tokens(docs: DataFrame, path: str, out: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID, segment: int = 1 << 21, range_bytes: int = 1 << 29) -> None:
    """Writes the ids of each whole text, and end_id after it, to `out` in ascending key.

    A missing or empty text has only end_id. Rows without a key come first and read back without one. Texts are encoded
    where they are read, so only ids (of two bytes, if the vocabulary allows) are shuffled, by key ranges of about
    range_bytes of text; rows of one key that fill ranges alone are spread over these by a hash, so they may come in
    any, though always the same, order. A task holds one segment of about `segment` tokens (at least one whole
    document) at a time.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text"))
    bounds = key_ranges(rows, range_bytes)
    shared = spark.sparkContext.broadcast(bounds)
    width = "<u2" if tokenizer(path).get_vocab_size() < 1 << 16 and end_id < 1 << 16 else "<u4"

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, tail, ends = held("text ids", path, lambda: TextIds(path)), np.array([end_id], "<u4").tobytes(), shared.value
        for batch in batches:
            keys = batch.column(0).fill_null(LEAST).to_numpy()
            low, high = np.searchsorted(ends, keys, "left"), np.searchsorted(ends, keys, "right")
            share = batch.column(2).to_numpy().view(np.uint64).astype(float) / 2.0**64
            shard = np.minimum(low + (share * (high - low + 1)).astype(np.int64), high).astype(np.int32)
            made = []
            for data in batch.column(3).cast(pa.binary()):
                made.append(np.frombuffer(encoder.encode(data.as_py()) + tail, "<u4").astype(width).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(shard), batch.column(0), batch.column(1), pa.array(made, pa.binary())], names=PLACED.names)
            del batch, made
        pa.default_memory_pool().release_unused()

    hashed = rows.select("key", F.xxhash64("text").alias("h"), "text").select("key", "h", F.xxhash64("h", F.monotonically_increasing_id()).alias("u"), "text")
    placed = hashed.mapInArrow(spread, PLACED).repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions("shard", "key", "h")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, seg, keys, ends, held, size = None, 0, [], [], [], 0

        def flush() -> pa.RecordBatch:
            codes = encode(np.frombuffer(b"".join(held), width))
            made = [[at], [seg], [keys[0]], [size], [keys.count(None)], [np.array([0 if k is None else k for k in keys], "<i8").tobytes()], [np.array(ends, "<i8").tobytes()], [codes]]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(made, map(arrow_type, (f.dataType for f in SEGMENT.fields)))], names=SEGMENT.names)

        for batch in batches:
            for shard, k, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()):
                if keys and (size >= segment or shard != at):
                    yield flush()
                    seg, keys, ends, held, size = seg + 1, [], [], [], 0
                if shard != at:
                    at, seg = shard, 0
                held.append(ids)
                size += len(ids) // np.dtype(width).itemsize
                keys.append(k)
                ends.append(size)
        if keys:
            yield flush()

    placed.mapInArrow(pack, SEGMENT).write.parquet(out)
    shared.unpersist()


def starts_of(spark: SparkSession, out: str) -> DataFrame:
    """(shard, seg, n_tokens, start) of the segments: start is the ids of all segments before.

    Totals are summed for each shard first, so no task sees more rows than there are shards, or segments in a shard.
    """
    slim = spark.read.schema(SEGMENT).parquet(out).select("shard", "seg", "n_tokens")
    totals = slim.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = totals.select("shard", F.coalesce(F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("n_tokens").over(W.partitionBy("shard").orderBy("seg").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return slim.withColumn("inside", inside).join(before, "shard").select("shard", "seg", "n_tokens", (F.col("base") + F.col("inside")).alias("start"))


def documents_of(spark: SparkSession, out: str, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of each document, from the decoded files.

    Segments are decoded where they are read; only the rows of documents meet the segments' starts.
    """
    schema = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("seg", T.IntegerType()), *(T.StructField(n, T.LongType()) for n in (key, "__from", "n_tokens", "ids_crc32"))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, seg, nulls, keys, ends, codes in zip(*batch.columns):
                keys, ends, data = np.frombuffer(keys.as_py(), "<i8"), np.frombuffer(ends.as_py(), "<i8"), Codes(codes.as_py()).all().astype("<u4").tobytes()
                from_ = np.r_[0, ends[:-1]]
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(from_.tolist(), ends.tolist())]
                n = len(keys)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, shard.as_py(), np.int32)), pa.array(np.full(n, seg.as_py(), np.int32)), pa.array(keys, mask=np.arange(n) < nulls.as_py()), pa.array(from_), pa.array(ends - from_), pa.array(crc, pa.int64())], names=schema.names)

    segments = spark.read.schema(SEGMENT).parquet(out).select("shard", "seg", "n_null", "doc_ids", "ends", "codes")
    placed = segments.mapInArrow(run, schema).join(starts_of(spark, out).select("shard", "seg", F.col("start").alias("__base")), ["shard", "seg"])
    return placed.select(F.col(f"`{key}`"), (F.col("__base") + F.col("__from")).alias("start"), "n_tokens", "ids_crc32")


def tokens_at(spark: SparkSession, out: str, places: Sequence[int], most: int = 100_000) -> DataFrame:
    """(place, id) at some places of the whole stream, each read directly from its segment; places outside have no row.

    places is a list of the caller's, at most `most`, which is what is broadcast. Segments stay where they are.
    """
    if len(places) > most:
        raise ValueError(f"{len(places)} places; the bound is {most}")
    wanted = spark.createDataFrame([(int(p),) for p in set(places)], "place long")
    found = starts_of(spark, out).join(F.broadcast(wanted), F.expr("place >= start and place < start + n_tokens"))
    asked = found.groupBy("shard", "seg").agg(F.collect_list(F.struct("place", (F.col("place") - F.col("start")).alias("i"))).alias("asked"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for codes, wants in zip(*batch.columns):
                data, wants = Codes(codes.as_py()), wants.as_py()
                yield pa.RecordBatch.from_arrays([pa.array([w["place"] for w in wants], pa.int64()), pa.array([data[w["i"]] for w in wants], pa.int64())], names=["place", "id"])

    return spark.read.schema(SEGMENT).parquet(out).join(F.broadcast(asked), ["shard", "seg"]).select("codes", "asked").mapInArrow(run, "place long, id long")


def digest(docs: DataFrame, path: str) -> DataFrame:
    """The columns of the query over documents."""
    out = scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, out)
    return documents_of(docs.sparkSession, out)
