"""Work on sorted files of 64-bit hashes without reading or shuffling them whole: lookup by binary search, and merging of runs.

A run is a file, or a folder whose *.bin files in the order of their names are one sorted set (as sinks.sorted_hashes writes them).
Order is that of unsigned numbers.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.accumulators import Accumulator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfen.sources.hashfile import WIDTH, HashFiles, opened

#: Numbers in a block of the sparse index (512 kB), and the most blocks whose first numbers are broadcast (32 MB).
STEP, MOST_BLOCKS = 1 << 16, 1 << 22


class Run:
    """One sorted set in files; numbers are addressed by their place in it."""

    def __init__(self, path: str) -> None:
        self.store, at = opened(path)
        info = self.store.get_file_info(at)
        if info.type == fs.FileType.Directory:
            files = sorted((f for f in self.store.get_file_info(fs.FileSelector(at)) if f.path.endswith(".bin")), key=lambda f: f.path)
        elif info.type == fs.FileType.File:
            files = [info]
        else:
            raise FileNotFoundError(path)
        if wrong := [f.path for f in files if f.size % WIDTH]:
            raise ValueError(f"the size of {wrong[0]} is no multiple of 8")
        self.files = [f.path for f in files]
        self.ends = np.cumsum([f.size // WIDTH for f in files]) if files else np.zeros(0, np.int64)
        self.open: dict[int, object] = {}

    def __len__(self) -> int:
        return int(self.ends[-1]) if len(self.ends) else 0

    def read(self, start: int, end: int) -> np.ndarray:
        """The numbers at places start to end."""
        parts = []
        while start < min(end, len(self)):
            k = int(np.searchsorted(self.ends, start, "right"))
            first, last = int(self.ends[k - 1]) if k else 0, min(end, int(self.ends[k]))
            if k not in self.open:
                self.open[k] = self.store.open_input_file(self.files[k])
            parts.append(np.frombuffer(self.open[k].read_at((last - start) * WIDTH, (start - first) * WIDTH), "<u8"))
            start = last
        return np.concatenate(parts) if parts else np.zeros(0, np.uint64)

    def place(self, value: int) -> int:
        """How many numbers are smaller."""
        low, high = 0, len(self)
        while low < high:
            mid = (low + high) // 2
            low, high = (mid + 1, high) if int(self.read(mid, mid + 1)[0]) < value else (low, mid)
        return low

    def close(self) -> None:
        for f in self.open.values():
            f.close()
        self.open = {}


def numbers_at(spark: SparkSession, path: str, places: np.ndarray) -> np.ndarray:
    """The numbers at some places of a run, read by all tasks."""
    n = max(1, min(len(places) // 256, 4 * spark.sparkContext.defaultParallelism))
    shared = spark.sparkContext.broadcast(places)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = Run(path)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            values = np.array([source.read(p, p + 1)[0] for p in shared.value[ids].tolist()], np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(values.view(np.int64))], names=["i", "v"])
        source.close()

    out = np.zeros(len(places), np.uint64)
    for r in spark.range(0, len(places), 1, n).mapInArrow(run, "i long, v long").collect():
        out[r.i] = np.int64(r.v).view(np.uint64)
    return out


def present(df: DataFrame, path: str, column: str = "hash", step: int = STEP, blocks_read: Accumulator | None = None) -> DataFrame:
    """(hash): the distinct hashes of a column that are in a sorted run. Missing ones are in none.

    Only the column's distinct hashes are shuffled, by the block of the run that they would be in; a block without any is never read, and
    none is read by two tasks. The first number of each block of `step` is broadcast; beyond MOST_BLOCKS blocks these are larger.
    """
    spark, run_of = df.sparkSession, Run(path)
    size = len(run_of)
    step = max(step, -(-size // MOST_BLOCKS))
    firsts = numbers_at(spark, path, np.arange(0, size, step))
    shared = spark.sparkContext.broadcast(firsts)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.searchsorted(shared.value, h.view(np.uint64), "right") - 1)], names=["hash", "block"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, at, numbers = Run(path), -1, np.zeros(0, np.uint64)
        for batch in batches:
            h, blocks, good = batch.column(0).to_numpy(), batch.column(1).to_numpy(), np.zeros(len(batch), bool)
            cuts = np.flatnonzero(np.diff(blocks)) + 1
            for a, b in zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(blocks)].tolist()):
                if a == b:
                    continue
                if blocks[a] != at:
                    at = int(blocks[a])
                    numbers = source.read(at * step, (at + 1) * step)
                    if blocks_read is not None:
                        blocks_read.add(1)
                mine = h[a:b].view(np.uint64)
                good[a:b] = numbers[np.minimum(np.searchsorted(numbers, mine), len(numbers) - 1)] == mine
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good))], names=["hash"])
        source.close()

    hashes = df.select(F.col(f"`{column}`").cast("long").alias("hash")).filter("hash is not null").distinct()
    placed = hashes.mapInArrow(place, "hash long, block long").filter("block >= 0")
    return placed.repartition("block").sortWithinPartitions("block").mapInArrow(search, "hash long")


def merge_two(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Two sorted arrays as one."""
    out, at = np.empty(len(a) + len(b), np.uint64), np.searchsorted(a, b, "right") + np.arange(len(b))
    free = np.ones(len(out), bool)
    free[at] = False
    out[at], out[free] = b, a
    return out


def merged(runs: Sequence[Run], spans: Sequence[tuple[int, int]], chunk: int) -> Iterator[np.ndarray]:
    """The distinct numbers of a span of each run, in order: of each only `chunk` are held, and what is not above the least of their
    last numbers is merged, smallest parts first."""
    at, held = [a for a, _ in spans], [np.zeros(0, np.uint64) for _ in runs]
    last = None
    while True:
        for k, run in enumerate(runs):
            if not len(held[k]) and at[k] < spans[k][1]:
                end = min(at[k] + chunk, spans[k][1])
                held[k], at[k] = run.read(at[k], end), end
        open_runs = [k for k in range(len(runs)) if len(held[k])]
        if not open_runs:
            return
        bound = min((held[k][-1] for k in open_runs if at[k] < spans[k][1]), default=None)
        parts = []
        for k in open_runs:
            n = len(held[k]) if bound is None else int(np.searchsorted(held[k], bound, "right"))
            parts.append(held[k][:n])
            held[k] = held[k][n:]
        whole = reduce(merge_two, sorted(parts, key=len))
        keep = np.r_[True if last is None else whole[0] != last, whole[1:] != whole[:-1]]
        last = whole[-1]
        if keep.any():
            yield whole[keep]


def merge_runs(spark: SparkSession, paths: Sequence[str], out: str, ranges: int | None = None, chunk: int = 1 << 17) -> None:
    """Merges sorted runs into one, each number once, without a shuffle or a sort.

    Splitters come from evenly spaced numbers of all runs; each task finds its range in every run by binary search and merges what lies
    there, holding `chunk` numbers of each run. A long run of equal numbers is one number in the end, so no range is hot.
    """
    runs = [Run(p) for p in paths]
    total = sum(map(len, runs))
    count = ranges or max(1, min(total // chunk, 4096))
    seen = [numbers_at(spark, p, np.unique(np.linspace(0, len(r) - 1, min(len(r), 16 * count)).astype(np.int64))) for p, r in zip(paths, runs) if len(r)]
    # Each sample stands for its share of its run.
    values = np.concatenate(seen) if seen else np.zeros(0, np.uint64)
    weight = np.concatenate([np.full(len(s), len(r) / len(s)) for s, r in zip(seen, [r for r in runs if len(r)])]) if seen else np.zeros(0)
    order = np.argsort(values, kind="stable")
    share = np.cumsum(weight[order])
    splits = np.unique(values[order][np.searchsorted(share, np.arange(1, count) * total / count)]) if len(values) and count > 1 else np.zeros(0, np.uint64)
    shared = spark.sparkContext.broadcast([int(s) for s in splits])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                sources, bounds = [Run(p) for p in paths], shared.value
                low = [r.place(bounds[i - 1]) if i else 0 for r in sources]
                high = [r.place(bounds[i]) if i < len(bounds) else len(r) for r in sources]
                for numbers in merged(sources, list(zip(low, high)), chunk):
                    yield pa.RecordBatch.from_arrays([pa.array(numbers.view(np.int64))], names=["hash"])
                for r in sources:
                    r.close()

    spark.dataSource.register(HashFiles)
    n = len(splits) + 1
    spark.range(0, n, 1, n).mapInArrow(run, "hash long").write.format("hashfile").mode("overwrite").save(out)
