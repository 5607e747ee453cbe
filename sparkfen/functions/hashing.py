"""64-bit hashes of byte strings and longs, vectorised with numpy's unsigned wrap-around."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

try:  # without OpenSSL's cost for each call
    from _md5 import md5
except ImportError:
    md5 = hashlib.md5

U = np.uint64
#: Fixed values of the hash definitions.
C1, C2 = U(0x87C37B91114253D5), U(0x4CF5AD432745937F)
M1, M2 = U(0xFF51AFD7ED558CCD), U(0xC4CEB9FE1A85EC53)
GOLDEN, S1, S2 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


def rotl(x: np.ndarray, r: int) -> np.ndarray:
    """Bits turned left."""
    return (x << U(r)) | (x >> U(64 - r))


def fmix64(x: np.ndarray) -> np.ndarray:
    """Murmur's last mixing step."""
    for m in (M1, M2):
        x = (x ^ (x >> U(33))) * m
    return x ^ (x >> U(33))


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix's mixing step."""
    x = (x ^ (x >> U(30))) * S1
    x = (x ^ (x >> U(27))) * S2
    return x ^ (x >> U(31))


def splitmix64(x: np.ndarray) -> np.ndarray:
    """One step from each state."""
    return mix64(np.asarray(x, U) + GOLDEN)


def permutations(perms: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """The odd factors and the offsets of a MinHash's permutations: the numbers of one SplitMix sequence, by turns."""
    s = splitmix64(U(seed) + np.arange(2 * perms, dtype=U) * GOLDEN)
    return s[::2] | U(1), s[1::2]


def murmur3_low64(texts: Sequence[bytes], seed: int = 42) -> np.ndarray:
    """The low 64 bits of MurmurHash3 x64 128 of byte strings, grouped by length and computed together."""
    out = np.zeros(len(texts), U)
    lengths = np.array([len(t) for t in texts])
    with np.errstate(over="ignore"):
        for n in np.unique(lengths):
            at = np.flatnonzero(lengths == n)
            blocks = -(-int(n) // 16)
            data = np.zeros((len(at), max(1, blocks) * 16), np.uint8)
            if n:
                data[:, :n] = np.frombuffer(b"".join(texts[i] for i in at), np.uint8).reshape(len(at), n)
            k = data.view("<u8")
            h1 = np.full(len(at), seed, U)
            h2 = h1.copy()
            for b in range(int(n) // 16):
                h1 = (rotl(h1 ^ (rotl(k[:, 2 * b] * C1, 31) * C2), 27) + h2) * U(5) + U(0x52DCE729)
                h2 = (rotl(h2 ^ (rotl(k[:, 2 * b + 1] * C2, 33) * C1), 31) + h1) * U(5) + U(0x38495AB5)
            if n % 16:
                h2 = h2 ^ (rotl(k[:, -1] * C2, 33) * C1)
                h1 = h1 ^ (rotl(k[:, -2] * C1, 31) * C2)
            h1, h2 = h1 ^ U(n), h2 ^ U(n)
            h1 = h1 + h2
            h2 = h2 + h1
            out[at] = fmix64(h1) + fmix64(h2)
    return out


def murmur3_udf(seed: int = 42):
    """A column function: the hash of a string as a signed long (same bits)."""

    @F.pandas_udf("long")
    def murmur(s: pd.Series) -> pd.Series:
        made = murmur3_low64([("" if x is None else x).encode() for x in s], seed).view(np.int64)
        return pd.Series(made).where(s.notna().to_numpy())

    return murmur


def murmur3_rows(letters: np.ndarray) -> np.ndarray:
    """murmur3_low64 with its usual seed of texts of one length, a row of bytes each, as longs."""
    return murmur3_low64([row.tobytes() for row in letters]).view(np.int64)


def md5_60(texts: Sequence[bytes]) -> np.ndarray:
    """The first 60 bits of the MD5 of each text, as longs."""
    return (np.frombuffer(b"".join([md5(t).digest() for t in texts]), ">u8")[::2] >> U(4)).astype(np.int64)


def md5_rows(letters: np.ndarray) -> np.ndarray:
    """The first 60 bits of the MD5 of texts of one length, a row of bytes each, as longs."""
    return md5_60([row.tobytes() for row in letters])


def shingle_sets(words: DataFrame, size: int, most: int = 1 << 20) -> DataFrame:
    """(sample_id, hashes): for texts (sample_id, words) of ASCII words with one space between them, md5_60 of the distinct runs of `size`
    words, ascending; texts of fewer words have no row. Batches have about `most` shingles, so that memory does not grow with them."""
    schema = T.StructType([words.schema["sample_id"], T.StructField("hashes", T.ArrayType(T.LongType(), False))])
    names = schema.names

    def made(text: str) -> np.ndarray:
        data = text.encode()
        gaps = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
        starts, ends = np.r_[0, gaps + 1].tolist(), np.r_[gaps, len(data)].tolist()
        grams = {data[a:b] for a, b in zip(starts, ends[size - 1 :])} if data else ()
        return np.sort(md5_60(grams)) if grams else np.zeros(0, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, sets, held = [], [], 0

            def packed() -> pa.RecordBatch:
                at = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(sets))).cast(kind)], names)

            kind = pa.list_(pa.field("element", pa.int64(), False))
            for i, text in enumerate(batch.column(1)):
                found = made(text.as_py() or "")
                if len(found):
                    rows.append(i)
                    sets.append(found)
                    held += len(found)
                if held >= most:
                    yield packed()
                    rows, sets, held = [], [], 0
            if rows:
                yield packed()

    return words.mapInArrow(run, schema)
