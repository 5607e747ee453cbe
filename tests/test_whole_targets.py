"""Targets and queries are taken from the whole table, not from a few small ids."""

import random

import pytest

from sparkfen.operators import sketches
from sparkfen.plans import catalog
from tests.test_whole_texts import kmers, md5


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    rng = random.Random(8)
    base = "".join(rng.choice("acgt") for _ in range(900))
    made = {i: base[rng.randrange(400) :][: rng.randrange(5, 500)] + "".join(rng.choice("acgt") for _ in range(30)) for i in (3, 25, 50, 77, 100, 131)} | {150: "short"}
    folder = str(tmp_path_factory.mktemp("targets"))
    spark.createDataFrame(list(made.items()), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return folder, {i: [md5(k) for k in kmers(t)] for i, t in made.items() if kmers(t)}


def test_prevalence_of_every_query(spark, many):
    folder, hashes = many
    want = set()
    for t in (50, 100):
        v = hashes[t]
        n, k = len(set(v)), [len(set(v) & set(w)) for w in hashes.values()]
        want.add((t, n, sum(x > 0 for x in k), sum(x >= 3 for x in k), sum(10 * x >= n for x in k), sum(4 * x >= n for x in k)))
    assert {tuple(r) for r in catalog.queries()["prevalence_tiers"](spark, folder).collect()} == want


def test_localise_every_query(spark, many):
    folder, hashes = many
    want = {(t, i): (len(v), n) for t in (50, 100) for i, v in hashes.items() if (n := sum(h in set(hashes[t]) for h in v))}
    assert {(r.target_id, r.sample_id): (r.n_kmers, r.n_hits) for r in catalog.queries()["localise"](spark, folder).collect()} == want


def test_sketch_similarity_of_every_query(spark, many):
    folder, hashes = many
    got = {(r.a, r.b): (r.jaccard, r.cosine, r.containment) for r in catalog.queries()["sketch_similarity"](spark, folder).collect()}
    assert set(got) == {(a, b) for a in (50, 100) for b in hashes if a != b}  # each has a small bucket
    s = sketches.max_geom(spark.createDataFrame([(i, h) for i, v in hashes.items() for h in v], "sample_id long, hash long"), 12, size=4).cache()
    for a, b in ((50, 3), (50, 100), (100, 131)):
        assert got[a, b] == pytest.approx(tuple(sketches.bucket_similarity(s, a, b, 12, size=4).first()), abs=1e-8)
