"""NumPy matrices read in parts, against numpy itself."""

import io
import zipfile

import numpy as np
import pytest

from sparkfen.sources import matrices, readers


def cells(m):
    return sorted((int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m)))


def compressed_rows(m):
    indptr, indices, data = [0], [], []
    for row in m:
        at = np.flatnonzero(row)
        indices += list(at)
        data += list(row[at])
        indptr.append(len(indices))
    return {"indptr": np.array(indptr, np.int32), "indices": np.array(indices, np.int32), "data": np.array(data)}


@pytest.fixture
def sparse():
    rng = np.random.default_rng(1)
    m = np.where(rng.random((60, 37)) < 0.1, rng.random((60, 37)), 0.0)
    m[:7], m[20:31], m[-5:] = 0, 0, 0  # rows without a cell at both ends and within
    m[40] = 1.0
    return m


def read(spark, path, numbers):
    df = readers.matrix(spark, str(path), numbers)
    return sorted(map(tuple, df.collect())), df.rdd.getNumPartitions()


@pytest.mark.parametrize("numbers", [13, 1 << 22])
def test_dense(spark, tmp_path, numbers, monkeypatch):
    m = np.random.default_rng(2).integers(-2, 3, (11, 9)).astype(np.int16)
    np.save(tmp_path / "rows.npy", m)
    np.save(tmp_path / "columns.npy", np.asfortranarray(m))
    for name in ("rows", "columns"):
        got, parts = read(spark, tmp_path / f"{name}.npy", numbers)
        assert got == cells(m) and parts == -(-m.size // numbers)


@pytest.mark.parametrize("numbers", [7, 1 << 22])
@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
def test_sparse(spark, tmp_path, sparse, numbers, save):
    forms = {
        "csr": compressed_rows(sparse) | {"format": np.array(b"csr"), "shape": np.array(sparse.shape)},
        "csc": compressed_rows(sparse.T) | {"format": np.array(b"csc"), "shape": np.array(sparse.shape)},
        "coo": dict(zip(("row", "col"), np.nonzero(sparse))) | {"data": sparse[np.nonzero(sparse)], "format": np.array(b"coo")},
        "bare": compressed_rows(sparse), "dense": {"m": sparse},
    }
    for name, members in forms.items():
        save(tmp_path / f"{name}.npz", **members)
        got, parts = read(spark, tmp_path / f"{name}.npz", numbers)
        assert got == cells(sparse), name
        n = members["m"].size if name == "dense" else len(members["data"])
        assert parts == (-(-n // numbers) if save is np.savez else 1)


def test_blocks_smaller_than_a_row(tmp_path, sparse, monkeypatch):
    monkeypatch.setattr(matrices, "BLOCK", 4)
    for save in (np.savez, np.savez_compressed):
        save(tmp_path / "m.npz", **compressed_rows(sparse))
        r = matrices.MatrixReader(str(tmp_path / "m.npz"), 10)
        rows = [t for p in r.partitions() for b in r.read(p) for t in zip(*(c.to_pylist() for c in b.columns))]
        assert sorted(rows) == cells(sparse)


def test_a_part_reads_its_bytes_only(tmp_path):
    m = np.ones((1000, 100))
    np.save(tmp_path / "m.npy", m)
    r = matrices.MatrixReader(str(tmp_path / "m.npy"), 500)
    parts = r.partitions()
    with open(tmp_path / "m.npy", "r+b") as f:  # the file loses all but the first parts
        f.truncate(128 + 8 * 1000)
    assert sum(len(b) for p in parts[:2] for b in r.read(p)) == 1000
    with pytest.raises(ValueError, match="ends within"):
        list(r.read(parts[2]))


def test_odd_files(spark, tmp_path):
    np.save(tmp_path / "none.npy", np.zeros((0, 5)))
    assert read(spark, tmp_path / "none.npy", 10)[0] == []
    np.save(tmp_path / "nan.npy", np.array([[np.nan, 0.0]]))
    assert [(i, j) for i, j, _ in read(spark, tmp_path / "nan.npy", 10)[0]] == [(0, 0)]
    (tmp_path / "folder").mkdir()
    assert read(spark, tmp_path / "folder", 10)[0] == []
    for i in range(2):
        np.save(tmp_path / "folder" / f"{i}.npy", np.eye(2))
    assert len(read(spark, tmp_path / "folder", 10)[0]) == 4
    for bad in (np.zeros(3), np.array([["a"]]), np.array([[1j]])):
        np.save(tmp_path / "bad.npy", bad)
        with pytest.raises(ValueError):
            matrices.MatrixReader(str(tmp_path / "bad.npy"), 10).partitions()
    np.savez(tmp_path / "bad.npz", a=np.eye(2), b=np.eye(2))
    with pytest.raises(ValueError):
        matrices.MatrixReader(str(tmp_path / "bad.npz"), 10).partitions()
    with pytest.raises(FileNotFoundError):
        matrices.MatrixReader(str(tmp_path / "missing.npy"), 10).partitions()


def test_deflated_members_forwards(tmp_path):
    data = io.BytesIO()
    np.save(data, np.arange(1000))
    with zipfile.ZipFile(tmp_path / "m.npz", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("data.npy", data.getvalue())
    v = matrices.vectors(*matrices.opened(str(tmp_path / "m.npz")))["data"]
    assert list(v.read(5, 8)) == [5, 6, 7] and list(v.read(900, 901)) == [900]
    with pytest.raises(ValueError):
        v.read(0, 1)
