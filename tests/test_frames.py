"""Zstandard text by frames: every cut gives the records of the whole text, and broken files are errors."""

import io
import os
import struct

import pyarrow as pa
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkfen.sources import frames, readers, sinks


def packed(pieces, table=True, checksums=False):
    """A file of these frames."""
    made = [zstandard.ZstdCompressor(write_checksum=True).compress(p) for p in pieces]
    out = b"".join(made)
    if table:
        sizes = b"".join(struct.pack("<II", len(m), len(p)) + (b"\1\2\3\4" if checksums else b"") for m, p in zip(made, pieces))
        out += struct.pack("<II", frames.TABLE, len(sizes) + 9) + sizes + struct.pack("<IBI", len(made), 128 if checksums else 0, frames.LAST)
    return out


def plain(text, separator):
    """(offset, record) as splitting has it, without a last empty one."""
    out, at = [], 0
    for r in text.split(separator):
        out.append((at, r))
        at += len(r) + len(separator)
    return out[:-1] if not out[-1][1] else out


def rows(path, separator, size):
    reader = frames.ZstdReader(str(path), separator, size)
    parts = reader.partitions()
    return len(parts), [r for p in parts for b in reader.read(p) for r in zip(b.column("offset").to_pylist(), (v.encode() for v in b.column("value").to_pylist()))]


@given(st.lists(st.text("ab>\n", max_size=9), min_size=1, max_size=9), st.sampled_from([b"\n", b"\n>", b"ab"]), st.integers(1, 12))
@settings(max_examples=300, deadline=None)
def test_any_frames_and_separators(tmp_path_factory, pieces, separator, size):
    """Separators over frame borders, frames without one, empty frames, empty text."""
    path = tmp_path_factory.mktemp("z") / "x.zst"
    path.write_bytes(packed([p.encode() for p in pieces]))
    assert rows(path, separator, size)[1] == plain("".join(pieces).encode(), separator)


@given(st.text("ab\n", max_size=60), st.integers(1, 7), st.integers(1, 9))
@settings(max_examples=100, deadline=None)
def test_records_in_small_pieces(text, step, chunk):
    old, frames.CHUNK = frames.CHUNK, chunk
    try:
        data = text.encode()
        assert list(frames.records((data[i : i + step] for i in range(0, len(data), step)), b"\n", 0, None)) == plain(data, b"\n")
    finally:
        frames.CHUNK = old


def test_long_records_and_many_frames(tmp_path):
    """A record of 5 MB over 50 frames, whose partitions but the first have no row of their own before its end."""
    text = b"first\n" + os.urandom(2_500_000).hex().encode() + b"\nlast\nno newline"
    pieces = [text[i : i + 100_000] for i in range(0, len(text), 100_000)]
    for table, checksums in ((True, False), (True, True), (False, False)):
        (tmp_path / "x.zst").write_bytes(packed(pieces, table, checksums))
        n, got = rows(tmp_path / "x.zst", b"\n", 300_000)
        assert got == plain(text, b"\n") and n == (17 if table else 1)


def test_a_part_reads_its_frames_only(tmp_path):
    pieces = [os.urandom(400_000).hex().encode() + b"\n" for _ in range(20)]
    (tmp_path / "x.zst").write_bytes(packed(pieces))
    reader = frames.ZstdReader(str(tmp_path / "x.zst"), b"\n", 1)
    part = reader.partitions()[7]
    seen = []

    class Watched:
        def __init__(self, f):
            self.f = f

        def read_at(self, n, at):
            seen.append((at, n))
            return self.f.read_at(n, at)

    with pa.OSFile(str(tmp_path / "x.zst")) as f:
        list(frames.records(frames.unpacked(Watched(f), part.at, part.limit), b"\n", part.start, part.end))
    assert min(a for a, _ in seen) == part.at and sum(n for _, n in seen) <= 2 << 20


def test_frames_to_skip_and_highly_compressed_ones(tmp_path):
    skip = struct.pack("<II", 0x184D2A53, 5) + b"abcde"
    far = struct.pack("<II", 0x184D2A50, 3 << 20) + bytes(3 << 20)
    body = skip + packed([b"one\ntw"], False) + far + packed([b"o\n" + b" " * 20_000_000], False) + skip
    (tmp_path / "x.zst").write_bytes(body)
    assert rows(tmp_path / "x.zst", b"\n", 1)[1] == [(0, b"one"), (4, b"two"), (8, b" " * 20_000_000)]
    with pa.BufferReader(packed([b"\0" * 10**8], False)) as f:
        assert max(map(len, frames.unpacked(f, 0, f.size()))) <= 1 << 27


def test_broken_files(tmp_path):
    whole, plain_file = packed([b"a\n" * 1000, b"b\n" * 1000]), packed([os.urandom(5000)], False)
    table = len(whole) - 8 - 2 * 8 - 9
    for name, data in {"cut": plain_file[:-3], "shifted": whole[:5] + whole[6:], "size": whole[: table + 4] + b"\0" + whole[table + 5 :], "skip": struct.pack("<II", 0x184D2A50, 99) + b"x", "head": plain_file + b"\x28"}.items():
        (tmp_path / name).write_bytes(data)
        with pytest.raises(ValueError):
            rows(tmp_path / name, b"\n", 10)
    (tmp_path / "flipped").write_bytes(whole[:15] + bytes([whole[15] ^ 1]) + whole[16:])
    with pytest.raises((ValueError, zstandard.ZstdError)):
        rows(tmp_path / "flipped", b"\n", 10)
    with pytest.raises(FileNotFoundError):
        rows(tmp_path / "none", b"\n", 10)
    (tmp_path / "empty.zst").write_bytes(b"")
    assert rows(tmp_path / "empty.zst", b"\n", 10)[1] == []


def test_round_trip(spark, tmp_path):
    """Nulls are empty records; files are replaced; frames are dealt out; a plain stream of several frames is read too."""
    lines = [None if i % 50 == 0 else f"{i} ä " + "x" * (i % 300) for i in range(4000)]
    df = spark.createDataFrame([(v,) for v in lines], "value string")
    for _ in range(2):
        sinks.zstd_text(df.coalesce(1), str(tmp_path / "out"), 10_000)
    back = readers.zstd_text(spark, str(tmp_path / "out"), size=50_000)
    assert back.rdd.getNumPartitions() > 5
    assert [r.value for r in back.orderBy("offset").collect()] == [v or "" for v in lines]
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO((tmp_path / "out/part-000000.zst").read_bytes()), read_across_frames=True).read()
    assert whole.decode() == "".join((v or "") + "\n" for v in lines)
    with pytest.raises(Exception, match="files already"):
        df.write.format("zstd_text").mode("append").save(str(tmp_path / "out"))
    sinks.zstd_text(df.filter("false"), str(tmp_path / "none"))
    assert readers.zstd_text(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="more than one way"):
        readers.zstd_text(spark, str(tmp_path / "out"), separator="aba").count()
