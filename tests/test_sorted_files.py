"""Lookup in sorted files and merging of runs against plain set operations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkfen.plans import catalog
from sparkfen.sources import readers, sinks, sorted_files
from tests.differential import compare

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["dmi_by_lookup", "reference_merge"])
def test_queries(spark, name):
    compare(catalog.queries()[name], catalog.oracle_sql()[name], spark, DIR)


def frame(spark, numbers):
    return spark.createDataFrame([(None if n is None else int(n),) for n in numbers], "hash long")


@pytest.fixture(scope="module")
def numbers():
    rng = np.random.default_rng(3)
    return np.unique(np.r_[rng.integers(-(2**63), 2**63 - 1, 3000), [0, -1, 1, 2**63 - 1, -(2**63)]])


def test_lookup(spark, tmp_path, numbers):
    """Numbers of both signs, over files and blocks; only blocks that a hash may be in are read, each once."""
    path = str(tmp_path / "set")
    sinks.sorted_hashes(frame(spark, numbers[::2]), path)
    asked = frame(spark, [*numbers, *numbers[:50], None, 5]).repartition(4)
    got = sorted(r.hash for r in sorted_files.present(asked, path, step=64).collect())
    assert got == sorted(int(n) for n in numbers[::2])
    count = spark.sparkContext.accumulator(0)
    few = np.sort(numbers[::2].view(np.uint64))[[3, 5, 700]].view(np.int64)
    assert {r.hash for r in sorted_files.present(frame(spark, few), path, step=64, blocks_read=count).collect()} == set(few.tolist())
    assert count.value == 2
    assert sorted_files.present(asked.filter("1=0"), path).count() == 0
    (tmp_path / "none.bin").write_bytes(b"")
    assert sorted_files.present(asked, str(tmp_path / "none.bin")).count() == 0
    (tmp_path / "bad.bin").write_bytes(b"123")
    with pytest.raises(ValueError, match="multiple"):
        sorted_files.present(asked, str(tmp_path / "bad.bin"))


@pytest.mark.parametrize("ranges", [1, 7])
def test_merge(spark, tmp_path, numbers, ranges):
    """Runs that overlap, one that is a single file with repeats, and an empty one: each number once, in order."""
    for k in range(3):
        sinks.sorted_hashes(frame(spark, numbers[k :: k + 1]), str(tmp_path / f"run{k}"))
    many = np.sort(np.r_[np.full(500, 7), numbers[5:400]].astype(np.int64).view(np.uint64))
    (tmp_path / "one.bin").write_bytes(many.astype("<u8").tobytes())
    (tmp_path / "none.bin").write_bytes(b"")
    out = str(tmp_path / "out")
    sorted_files.merge_runs(spark, [*(str(tmp_path / f"run{k}") for k in range(3)), str(tmp_path / "one.bin"), str(tmp_path / "none.bin")], out, ranges=ranges, chunk=50)
    whole = sorted_files.Run(out).read(0, 1 << 30)
    want = np.unique(np.r_[numbers, 7].astype(np.int64).view(np.uint64))
    assert whole.tolist() == want.tolist()
    assert readers.hash_file(spark, out).agg(F.count("*")).first()[0] == len(want)
