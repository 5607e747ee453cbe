"""Sketches from texts reduced where they are read, against the same sketches from a row for each k-mer."""

import numpy as np
import pytest

from sparkfen.functions import hashing
from sparkfen.operators import kmers, sketches
from sparkfen.plans.bindings import surrogate
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def seqs(spark):
    rng = np.random.default_rng(5)
    text = lambda n, letters="ACGT": "".join(rng.choice(list(letters), n))
    long = text(40_000)
    rows = [(1, text(700)), (2, text(300, "ACGTN")), (2, text(300)), (3, long), (4, long.lower()), (5, "ACGTACGTACGTACGT" * 30), (6, "ACG"), (7, ""), (8, None), (None, text(50)), (9, "é" + text(60) + "ü" + text(10)), (1, text(90))]
    return spark.createDataFrame(rows, "sample_id long, seq string").repartition(3)


def same(x, y):
    cols = sorted(x.columns)
    key = lambda df: sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    assert cols == sorted(y.columns) and x.dtypes and key(x) == key(y)


@pytest.mark.parametrize("k", [4, 11, 16, 31])
def test_sketches(spark, seqs, k, monkeypatch):
    rows = sketches.scan_kmers(seqs, k, hasher=surrogate(F.col("kmer"))).localCheckpoint()
    h = hashing.md5_rows
    same(kmers.frac_min_hash(seqs, k, h, 0.01), sketches.frac_min_hash(rows, 0.01))
    same(kmers.bottom_k(seqs, k, h, 20), sketches.bottom_k(rows, 20))
    same(kmers.max_geom(seqs, k, h, 12, size=4), sketches.max_geom(rows, 12, size=4))
    same(kmers.max_geom(seqs, k, h, 12, alpha=0.45), sketches.max_geom(rows, 12, alpha=0.45))
    same(kmers.max_geom(seqs, k, h, 6, size=3), sketches.max_geom(rows, 6, size=3))
    same(kmers.min_hash(seqs, k, h, 8), sketches.min_hash(rows, 8))
    same(kmers.distinct_kmers(seqs, k, h), rows.select("kmer", "hash").distinct())


def test_murmur(spark, seqs):
    rows = sketches.scan_kmers(seqs, 11)
    same(kmers.frac_min_hash(seqs, 11, hashing.murmur3_rows, 0.2), sketches.frac_min_hash(rows, 0.2))
    same(kmers.max_geom(seqs, 11, hashing.murmur3_rows, 12, size=4), sketches.max_geom(rows, 12, size=4))  # hashes with the highest bit, too


def test_no_row_for_a_kmer(spark, seqs):
    from contextlib import redirect_stdout
    from io import StringIO

    from sparkfen.plans import catalog

    for name in ("kmer_fmh", "bottomk", "maxgeom", "alpha_maxgeom", "minhash", "murmur3_fmh", "sketch_union", "collisions"):
        out = StringIO()
        with redirect_stdout(out):
            catalog.queries()[name](spark, "/root/testdata/sf0.001").explain()
        assert "MapInArrow" in out.getvalue() and out.getvalue().count("Generate explode") <= 2 and "ArrowEvalPython" not in out.getvalue()


@pytest.mark.parametrize("k", [4, 11, 31])
def test_hits_of_targets(spark, seqs, k, monkeypatch):
    monkeypatch.setattr(kmers, "BLOCK", 2)
    monkeypatch.setattr(kmers, "HITS", 50)
    rows = sketches.scan_kmers(seqs, k, hasher=surrogate(F.col("kmer"))).localCheckpoint()
    sets = rows.select("sample_id", "hash").distinct()
    picked = lambda df: df.filter("sample_id in (1, 2, 5, 6)").withColumnRenamed("sample_id", "target_id")
    same(kmers.localise(seqs, picked(seqs), k, hashing.md5_rows), sketches.localise(rows, picked(rows)))
    same(kmers.prevalence_tiers(seqs, picked(seqs), k, hashing.md5_rows), sketches.prevalence_tiers(sets, picked(sets)))
