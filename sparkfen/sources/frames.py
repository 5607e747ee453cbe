"""Zstandard text as a Spark data source: read by frames where a file has a seek table, written with one.

    spark.dataSource.register(ZstdText)
    spark.read.format("zstd_text").option("separator", "\n>").load(path)     # (path, offset, value)
    df.write.format("zstd_text").mode("overwrite").save(folder)               # one .zst a task

A file with a seek table is dealt out by runs of frames, each a partition that decompresses its own frames and as much of the next ones as
its last record needs. A file without one can only be read from its beginning and is one task with bounded memory. Paths may be of any
store that pyarrow.fs knows, or plain local ones.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from typing import Any

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from sparkfen.sources.hashfile import Written, opened

#: Fixed by the seekable format: the number that begins the table's frame, the one that ends the file, and the size of the footer.
TABLE = 0x184D2A5E
LAST = 0x8F92EAB1
FOOTER = 9
#: Frames to skip have this number but for its last four bits.
SKIPPED = 0x184D2A50

CHUNK = 1 << 20
STEP = 1 << 12
BATCH = 1 << 23


@dataclass
class Run(InputPartition):
    """Frames of one file: from byte at to byte limit of the file, where the last frame ends; they hold the text from start to end."""

    path: str
    at: int
    limit: int
    start: int
    end: int | None
    total: int | None


def seek_table(file: Any, size: int) -> list[tuple[int, int]] | None:
    """(compressed, decompressed) size of each frame, or None if the file has no table. A table that does not fit its file is an error."""
    if size < FOOTER + 8:
        return None
    n, flags, last = struct.unpack("<IBI", file.read_at(FOOTER, size - FOOTER))
    if last != LAST:
        return None
    width = 12 if flags & 0x80 else 8
    length = n * width + FOOTER
    if size < length + 8 or struct.unpack("<II", file.read_at(8, size - length - 8)) != (TABLE, length):
        raise ValueError("a broken seek table")
    data = file.read_at(n * width, size - length)
    frames = [struct.unpack_from("<II", data, i) for i in range(0, n * width, width)]
    if sum(f[0] for f in frames) != size - length - 8:
        raise ValueError("the seek table does not add up to its file")
    return frames


def unpacked(file: Any, at: int, limit: int) -> Iterator[bytes]:
    """The text of the frames between two places of a file. A frame that does not end is an error.

    A block is 4 bytes at least and 128 kB of text at most, so what a step of 4 kB gives is bounded by 128 MB, whatever its ratio.
    """
    data, i = memoryview(b""), 0

    def more() -> None:
        nonlocal data, i, at
        new = file.read_at(min(CHUNK, limit - at), at) if at < limit else b""
        if not new:
            raise ValueError("a frame does not end")
        data, i, at = memoryview(bytes(data[i:]) + new), 0, at + len(new)

    while i < len(data) or at < limit:
        while len(data) - i < 8:
            more()
        if struct.unpack_from("<I", data, i)[0] & 0xFFFFFFF0 == SKIPPED:
            i += 8 + struct.unpack_from("<I", data, i + 4)[0]
            if i > len(data):
                data, i, at = memoryview(b""), 0, at + i - len(data)
                if at > limit:
                    raise ValueError("a frame does not end")
            continue
        frame = zstandard.ZstdDecompressor(max_window_size=1 << 31).decompressobj()
        while not frame.eof:
            if i == len(data):
                more()
            step = data[i : i + STEP]
            if out := frame.decompress(step):
                yield out
            i += len(step) - len(frame.unused_data)


def records(pieces: Iterator[bytes], separator: bytes, start: int, end: int | None) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of those whose separator before them begins from start to below end; the first record of all has none.

    pieces: text from start on, beyond end as far as it is asked for. As in Spark's text files the last record is left out if it is empty.
    """
    held, at, owned, size, least = [], start, start == 0, 0, CHUNK
    for piece in chain(pieces, [None]):
        if piece is not None:
            held.append(piece)
            size += len(piece)
            if size < least:
                continue
        *whole, rest = b"".join(held).split(separator)
        for record in whole:
            if owned:
                yield at, record
            at += len(record)
            if end is not None and at >= end:
                return
            owned = True
            at += len(separator)
        if not owned:  # nothing before the first separator is kept
            drop = max(len(rest) - len(separator) + 1, 0)
            at, rest = at + drop, rest[drop:]
            if end is not None and at >= end:
                return
        held, size = [rest], len(rest)
        least = max(CHUNK, 2 * size)  # a long record is joined a few times only
    if owned and rest:
        yield at, rest


class ZstdText(DataSource):
    """Options: path; separator (a newline by default); size when reading (text of a partition, 128 MB); frame (text of a frame, 4 MB)
    and level when writing."""

    @classmethod
    def name(cls) -> str:
        return "zstd_text"

    def schema(self) -> str:
        return "path string, offset long, value string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return ZstdReader(self.options["path"], self._separator(), int(self.options.get("size", 1 << 27)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if schema.fieldNames() != ["value"] or schema[0].dataType.typeName() != "string":
            raise ValueError("one column, value, of type string")
        return ZstdWriter(self.options["path"], overwrite, self._separator(), int(self.options.get("frame", 1 << 22)), int(self.options.get("level", 3)))

    def _separator(self) -> bytes:
        s = self.options.get("separator", "\n").encode()
        if not s or any(s[:k] == s[-k:] for k in range(1, len(s))):
            raise ValueError("a separator that is empty, or ends as it begins, divides a text in more than one way")
        return s


class ZstdReader(DataSourceReader):
    """Each record with the offset of its first byte in its file's text. Bytes that are no UTF-8 become replacement characters. A folder's
    files are its *.zst, by name; an empty file or folder has no rows; a broken table or frame is an error."""

    def __init__(self, path: str, separator: bytes, size: int) -> None:
        self.path, self.separator, self.size = path, separator, size

    def partitions(self) -> list[Run]:
        store, at = opened(self.path)
        info = store.get_file_info(at)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        if info.type == fs.FileType.Directory:
            files = sorted((f for f in store.get_file_info(fs.FileSelector(at)) if f.path.endswith(".zst")), key=lambda f: f.path)
        else:
            files = [info]
        out = []
        for f in files:
            with store.open_input_file(f.path) as file:
                frames = seek_table(file, f.size)
            if frames is None:
                out.append(Run(f.path, 0, f.size, 0, None, None))
                continue
            total, packed, text, begin = sum(n for _, n in frames), 0, 0, (0, 0)
            for a, n in frames:
                packed, text = packed + a, text + n
                if text - begin[1] >= self.size or (text == total and text > begin[1]):
                    out.append(Run(f.path, begin[0], f.size, begin[1], text, total))
                    begin = (packed, text)
        return out or [Run("", 0, 0, 0, None, None)]

    def read(self, part: Run) -> Iterator[pa.RecordBatch]:
        if part.at == part.limit:
            return
        store, _ = opened(self.path)
        with store.open_input_file(part.path) as file:
            text, at, size = [], [], 0
            end = None if part.end == part.total else part.end
            for offset, record in records(unpacked(file, part.at, part.limit), self.separator, part.start, end):
                text.append(record.decode("utf-8", "replace"))
                at.append(offset)
                size += len(record) + 16
                if size >= BATCH:
                    yield self._batch(part.path, at, text)
                    text, at, size = [], [], 0
            if text:
                yield self._batch(part.path, at, text)

    def _batch(self, path: str, at: list[int], text: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([path] * len(at)), pa.array(at, pa.int64()), pa.array(text, pa.string())], names=["path", "offset", "value"])


class ZstdWriter(DataSourceArrowWriter):
    """One file a task, of frames with checksums and a seek table; under a name of its own until all tasks are done. A missing value is an
    empty record; one that has the separator in it is read as several."""

    def __init__(self, path: str, overwrite: bool, separator: bytes, frame: int, level: int) -> None:
        self.path, self.overwrite, self.separator, self.frame, self.level, self.mark = path, overwrite, separator, frame, level, uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, at = opened(self.path)
        part, task = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        store.create_dir(f"{at}/_{self.mark}", recursive=True)
        path = f"{at}/_{self.mark}/{part}-{task}"
        packer, frames = zstandard.ZstdCompressor(level=self.level, write_checksum=True), []
        with store.open_output_stream(path) as f:

            def out(held: list[bytes]) -> None:
                text = b"".join(held)
                data = packer.compress(text)
                f.write(data)
                frames.append((len(data), len(text)))

            held, size = [], 0
            for batch in batches:
                for value in batch.column(0).to_pylist():
                    record = (value or "").encode() + self.separator
                    held.append(record)
                    size += len(record)
                    if size >= self.frame:
                        out(held)
                        held, size = [], 0
            if held:
                out(held)
            f.write(struct.pack("<II", TABLE, len(frames) * 8 + FOOTER) + b"".join(struct.pack("<II", *x) for x in frames) + struct.pack("<IBI", len(frames), 0, LAST))
        return Written(part, path if frames else None)

    def commit(self, messages: list[Written | None]) -> None:
        store, at = opened(self.path)
        store.create_dir(at, recursive=True)
        old = [f.path for f in store.get_file_info(fs.FileSelector(at)) if f.path.endswith(".zst")]
        if old and not self.overwrite:
            raise ValueError(f"{self.path} has files already")
        for path in old:
            store.delete_file(path)
        for i, m in enumerate(sorted((m for m in messages if m and m.path), key=lambda m: m.part)):
            store.move(m.path, f"{at}/part-{i:06d}.zst")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        store, at = opened(self.path)
        if store.get_file_info(f"{at}/_{self.mark}").type == fs.FileType.Directory:
            store.delete_dir(f"{at}/_{self.mark}")
