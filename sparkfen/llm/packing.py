"""Packing of documents into training sequences, online and in bounded space.

Each partition keeps a fixed number of open windows. A document is cut into whole windows and a rest; the rest goes where it
fits best, that is into the open window with the least room that holds it. If none does and all windows are in use, the
fullest is emitted. What is open at a partition's end is written down, and groups of partitions are merged in the same way,
round after round, until one is left; its last tokens are cut at powers of two, which need no padding.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkfen.llm.common import arrow_type, held
from sparkfen.llm.text_ids import TextIds
from sparkfen.session import scratch_path

WIDTH, END_ID = 1024, 0
#: part: the task that wrote the row; open: the window it stays in, or null in an emitted sequence.
PIECE = T.StructType([
    T.StructField("part", T.LongType()), T.StructField("open", T.IntegerType()), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()),
    T.StructField("key", T.LongType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("doc_tokens", T.LongType()), T.StructField("ids", T.BinaryType()),
])


class Piece:
    """length ids (4 bytes each) of a document, from its start-th."""

    __slots__ = ("ids", "key", "length", "start", "total")

    def __init__(self, key: int | None, start: int, total: int, ids: bytes) -> None:
        self.key, self.start, self.total, self.ids, self.length = key, start, total, ids, len(ids) // 4

    def cut(self, n: int) -> tuple["Piece", "Piece"]:
        """The first n ids and the others."""
        return Piece(self.key, self.start, self.total, self.ids[: 4 * n]), Piece(self.key, self.start + n, self.total, self.ids[4 * n :])


def cut(pieces: list[Piece], n: int) -> tuple[list[Piece], list[Piece]]:
    """The pieces of the first n ids and those of the others."""
    for k, p in enumerate(pieces):
        if n < p.length:
            a, b = p.cut(n) if n else (None, p)
            return [*pieces[:k], a] if n else pieces[:k], [b, *pieces[k + 1 :]]
        n -= p.length
    return pieces, []


class Windows:
    """At most `most` open windows of `width` ids; emitted sequences are collected in `out`.

    A window that leaves with `least` ids of room or more is filled up by the head of what did not fit, so padding is below
    `least` ids a sequence and no shorter head is ever cut.
    """

    def __init__(self, width: int, most: int, least: int) -> None:
        self.width, self.most, self.least = width, most, least
        self.rooms: list[tuple[int, int]] = []  # (room, number of the window), least room first
        self.windows: dict[int, list[Piece]] = {}
        self.made, self.out = 0, []

    def add(self, pieces: list[Piece]) -> None:
        """Places pieces that belong together."""
        size = sum(p.length for p in pieces)
        while size > self.width:
            head, pieces = cut(pieces, self.width)
            self.out.append(head)
            size -= self.width
        while size:
            at = bisect_left(self.rooms, (size, -1))
            if at < len(self.rooms):
                room, w = self.rooms.pop(at)
                return self._put(room, w, pieces, size)
            if len(self.rooms) < self.most:
                self.made += 1
                self.windows[self.made] = []
                return self._put(self.width, self.made, pieces, size)
            room, w = self.rooms.pop(0)
            if room >= self.least:
                head, pieces = cut(pieces, room)
                self.windows[w] += head
                size -= room
            self.out.append(self.windows.pop(w))

    def _put(self, room: int, w: int, pieces: list[Piece], size: int) -> None:
        self.windows[w] += pieces
        if room == size:
            self.out.append(self.windows.pop(w))
        else:
            insort(self.rooms, (room - size, w))

    def close(self) -> None:
        """Emits what is open: the fullest first, the others fill it up; the last ids in sequences of a power of two."""
        left = [p for _, w in self.rooms for p in self.windows.pop(w)]
        self.rooms, size = [], sum(p.length for p in left)
        while size:
            n = min(self.width, 1 << size.bit_length() - 1)
            head, left = cut(left, n)
            self.out.append(head)
            size -= n


class Rows:
    """Turns the sequences of one task into rows."""

    def __init__(self, level: int, part: int) -> None:
        self.part, self.next = part, (level << 58) | (part << 34)

    def emitted(self, windows: Windows) -> Iterator[tuple]:
        """The rows of what was emitted lately."""
        for sequence in windows.out:
            yield from self._rows(sequence, None)
            self.next += 1
        windows.out = []

    def open(self, windows: Windows) -> Iterator[tuple]:
        """The rows of the open windows."""
        for _, w in windows.rooms:
            yield from self._rows(windows.windows[w], w)

    def _rows(self, sequence: list[Piece], w: int | None) -> Iterator[tuple]:
        offset = 0
        for p in sequence:
            yield self.part, w, None if w else self.next, offset, p.key, p.start, p.length, p.total, p.ids
            offset += p.length


TYPES = [arrow_type(f.dataType) for f in PIECE.fields]


def batches_of(rows: Iterator[tuple], bound: int = 20_000) -> Iterator[pa.RecordBatch]:
    """The rows in batches."""
    held_rows: list[tuple] = []
    for row in rows:
        held_rows.append(row)
        if len(held_rows) == bound:
            yield _batch(held_rows)
            held_rows = []
    if held_rows:
        yield _batch(held_rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), TYPES)], names=PIECE.names)


def pack(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID, width: int = WIDTH, open_windows: int = 64, least: int = 8, merge: int = 64) -> DataFrame:
    """(key, start, length, doc_tokens, sequence_id, offset, ids) of each piece of each row of docs.

    A row's ids are those of its whole text by the tokenizer at path, then end_id; a missing or empty text has only that.
    Each id lies in one piece, and a sequence's pieces have gapless offsets. Sequences have width ids or, fewer than
    `least` short of it or of a power of two, are to be padded (see sequences()). Repeated rows and keys, or missing
    keys, are packed row by row; an empty table gives no rows; other columns are not looked at.

    A task holds one document and open_windows windows at a time. Each round is a table in the shared folder, so a lost
    executor costs the running round's tasks only and no row is numbered twice. Only open windows are shuffled: at most
    open_windows * width ids a task, `merge` tasks' to one, whatever the input. Equal keys meet in no place.
    """
    spark, made = docs.sparkSession, []
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text"))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = held("text ids", path, lambda: TextIds(path)), end_id.to_bytes(4, "little")
        windows, out = Windows(width, open_windows, least), Rows(0, TaskContext.get().partitionId())

        def emit() -> Iterator[tuple]:
            for batch in batches:
                for k, data in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                    ids = encoder.encode(data.as_py()) + end
                    windows.add([Piece(k, 0, len(ids) // 4, ids)])
                    yield from out.emitted(windows)
            yield from out.open(windows)

        yield from batches_of(emit())

    def again(level: int, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            windows, out = Windows(width, open_windows, least), Rows(level, TaskContext.get().partitionId())

            def emit() -> Iterator[tuple]:
                at, bundle = None, []
                for batch in batches:
                    for row in batch.to_pylist():
                        if (row["part"], row["open"]) != at:
                            windows.add(bundle)
                            yield from out.emitted(windows)
                            at, bundle = (row["part"], row["open"]), []
                        bundle.append(Piece(row["key"], row["start"], row["doc_tokens"], row["ids"]))
                windows.add(bundle)
                if last:
                    windows.close()
                yield from out.emitted(windows)
                yield from out.open(windows)

            yield from batches_of(emit())

        return run

    level, frame = 0, rows.mapInArrow(first, PIECE)
    while True:
        out = scratch_path(spark, f"packed{level}")
        frame.write.parquet(out)
        made.append(spark.read.schema(PIECE).parquet(out))
        left = made[-1].filter("open is not null")
        parts = left.agg(F.max("part")).first()[0]
        if parts is None:
            break
        level, groups = level + 1, parts // merge + 1
        placed = left.repartitionById(groups, F.floor(F.col("part") / merge).cast("int")).sortWithinPartitions("part", "open", "offset")
        frame = placed.mapInArrow(again(level, groups == 1), PIECE)
    pieces = made[0].filter("open is null")
    for m in made[1:]:
        pieces = pieces.union(m.filter("open is null"))
    return pieces.select(F.col("key").alias(key), "start", "length", "doc_tokens", "sequence_id", "offset", "ids")


def sequences(pieces: DataFrame, width: int = WIDTH) -> DataFrame:
    """(sequence_id, n_tokens, padded, ids) of each sequence of pack(): its ids in order, and the length to pad it to."""
    n = F.col("n_tokens")
    joined = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    ids = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return joined.select("sequence_id", "n_tokens", F.when(n.bitwiseAND(n - 1) == 0, n).otherwise(F.lit(width)).alias("padded"), ids.alias("ids"))


def digest(docs: DataFrame, path: str) -> DataFrame:
    """The columns of the query over documents."""
    made = pack(docs, path)
    return made.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
