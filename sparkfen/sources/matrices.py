"""Matrices in NumPy files as a Spark data source: read in runs of cells at their offsets, never a file at once.

    spark.dataSource.register(Matrices)
    spark.read.format("numpymatrix").load(path)     # (i, j, v) of the non-zero cells of a file or of a folder's *.npy and *.npz

A .npy file of two dimensions, in either order, is cut into runs of cells. So is a .npz archive whose members are stored: of
compressed rows or columns (data, indices, indptr), of coordinates (row, col, data), or of one dense array. A task finds its first
row by a binary search in indptr. Members that are deflated can only be read from their beginning: such an archive is one task, which
inflates its members side by side in blocks, so its memory is bounded too.
"""

from __future__ import annotations

import struct
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from sparkfen.sources.hashfile import opened

#: Cells in a block of a task.
BLOCK = 1 << 18


@dataclass
class Cells(InputPartition):
    """A run of the cells of one file, in the order in which they are stored."""

    path: str
    start: int
    end: int


class Vector:
    """The numbers of one array in .npy form inside an open file, by position; of a deflated member only forwards."""

    def __init__(self, file: Any, offset: int, forwards: bool = False) -> None:
        self.file, self.forwards = file, forwards
        if not forwards:
            file.seek(offset)
        version = np.lib.format.read_magic(file)
        read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        self.shape, self.fortran, self.type = read(file)
        if self.type.kind not in "biuf":
            raise ValueError(f"no matrix of numbers: {self.type}")
        self.size = int(np.prod(self.shape, dtype=np.int64))
        self.begin, self.at = (0 if forwards else file.tell()), 0

    def read(self, start: int, end: int) -> np.ndarray:
        width = self.type.itemsize
        if self.forwards:
            if start < self.at:
                raise ValueError("a deflated member is read forwards only")
            skip = (start - self.at) * width
            while skip:
                skip -= len(self._exactly(min(skip, 1 << 20)))
            self.at = end
        else:
            self.file.seek(self.begin + start * width)
        return np.frombuffer(self._exactly((end - start) * width), self.type)

    def _exactly(self, size: int) -> bytes:
        parts, missing = [], size
        while missing:
            data = self.file.read(missing)
            if not data:
                raise ValueError("the file ends within an array")
            parts.append(data)
            missing -= len(data)
        return b"".join(parts)


def vectors(store: fs.FileSystem, path: str) -> dict[str, Vector]:
    """The arrays of a file by name; a .npy file has one, named "". Each has a handle of its own."""
    handle = lambda: store.open_input_file(path)
    if not path.endswith(".npz"):
        return {"": Vector(handle(), 0)}
    out = {}
    with zipfile.ZipFile(handle()) as archive:
        members = archive.infolist()
    for m in members:
        name = m.filename.removesuffix(".npy")
        if name in ("format", "shape"):
            continue
        if m.compress_type == zipfile.ZIP_STORED:
            file = handle()
            file.seek(m.header_offset)
            names = struct.unpack("<HH", file.read(30)[26:30])  # lengths of the name and of the extra field in the member's own header
            out[name] = Vector(file, m.header_offset + 30 + sum(names))
        else:
            out[name] = Vector(zipfile.ZipFile(handle()).open(m.filename), 0, forwards=True)
    return out


def by_columns(store: fs.FileSystem, path: str) -> bool:
    """Whether the format member of an archive says that columns are compressed."""
    with store.open_input_file(path) as file, zipfile.ZipFile(file) as archive:
        if "format.npy" not in archive.namelist():
            return False
        with archive.open("format.npy") as f:
            kind = np.load(f, allow_pickle=False).item()
    kind = kind.decode() if isinstance(kind, bytes) else kind
    if kind not in ("csr", "csc", "coo"):
        raise ValueError(f"a sparse form that is not read: {kind}")
    return kind == "csc"


def main_vector(found: dict[str, Vector], path: str) -> Vector:
    """The array whose cells are dealt out."""
    if "data" in found and ("indptr" in found or "row" in found):
        return found["data"]
    if len(found) != 1 or len(next(iter(found.values())).shape) != 2:
        raise ValueError(f"neither a matrix nor a sparse form: {path}")
    return next(iter(found.values()))


class Matrices(DataSource):
    """Options: path; numbers (how many cells a partition reads, 4 million by default)."""

    @classmethod
    def name(cls) -> str:
        return "numpymatrix"

    def schema(self) -> str:
        return "i long, j long, v double"

    def reader(self, schema: StructType) -> DataSourceReader:
        return MatrixReader(self.options["path"], int(self.options.get("numbers", 1 << 22)))


class MatrixReader(DataSourceReader):
    """Explicit zeros of a sparse form are left out, as those of a dense one are; a NaN is kept."""

    def __init__(self, path: str, numbers: int) -> None:
        self.path, self.numbers = path, numbers

    def partitions(self) -> list[Cells]:
        store, at = opened(self.path)
        info = store.get_file_info(at)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        if info.type == fs.FileType.Directory:
            paths = sorted(f.path for f in store.get_file_info(fs.FileSelector(at)) if f.path.endswith((".npy", ".npz")))
        else:
            paths = [info.path]
        out = []
        for path in paths:
            found = vectors(store, path)
            size = main_vector(found, path).size
            step = size if any(v.forwards for v in found.values()) else self.numbers
            out += [Cells(path, a, min(a + step, size)) for a in range(0, size, max(step, 1))]
        return out or [Cells("", 0, 0)]

    def read(self, part: Cells) -> Iterator[pa.RecordBatch]:
        if part.start == part.end:
            return
        store, _ = opened(self.path)
        found = vectors(store, part.path)
        main = main_vector(found, part.path)
        if "indptr" in found:
            blocks = compressed(found, part.start, part.end, by_columns(store, part.path))
        elif "row" in found:
            blocks = ((found["row"].read(a, b), found["col"].read(a, b), main.read(a, b)) for a, b in runs(part.start, part.end))
        else:
            blocks = dense(main, part.start, part.end)
        for i, j, v in blocks:
            some = v != 0
            columns = [np.asarray(i)[some].astype(np.int64), np.asarray(j)[some].astype(np.int64), v[some].astype(float)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["i", "j", "v"])


def runs(start: int, end: int) -> Iterator[tuple[int, int]]:
    """The blocks of a run of cells."""
    return ((a, min(a + BLOCK, end)) for a in range(start, end, BLOCK))


def dense(m: Vector, start: int, end: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, v) of cells by their place in the file."""
    for a, b in runs(start, end):
        at = np.arange(a, b)
        if m.fortran:
            j, i = np.divmod(at, m.shape[0])
        else:
            i, j = np.divmod(at, m.shape[1])
        yield i, j, m.read(a, b)


def compressed(found: dict[str, Vector], start: int, end: int, columns: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, v) of cells start to end of compressed rows (or columns): indptr is walked in blocks from the row of the first cell."""
    ptr = found["indptr"]
    row = 0
    if start:
        # The last row that begins at or before the first cell; rows without a cell lie before it.
        low, high = 0, ptr.size - 1
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if ptr.read(middle, middle + 1)[0] <= start else (low, middle)
        row = low
    carried = None  # the last bound of the block before, as a deflated member cannot be read twice
    while row < ptr.size - 1:
        last = min(row + BLOCK, ptr.size - 1)
        bounds = ptr.read(row, last + 1) if carried is None else np.concatenate([carried, ptr.read(row + 1, last + 1)])
        carried, bounds = bounds[-1:], np.clip(bounds.astype(np.int64), start, end)
        for a, b in runs(int(bounds[0]), int(bounds[-1])):
            major = row + np.searchsorted(bounds, np.arange(a, b), side="right") - 1
            minor, v = found["indices"].read(a, b), found["data"].read(a, b)
            yield (minor, major, v) if columns else (major, minor, v)
        if carried[0] >= end:
            return
        row = last
