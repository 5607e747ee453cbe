"""The search with many queries against brute force."""

import random

import pytest

from sparkfen.operators import similarity
from sparkfen.plans import catalog
from sparkfen.plans.bindings import Bound

DIR = "/root/testdata/sf0.001"


def brute(sets, queries, threshold):
    out = {}
    for q in queries:
        for i, v in sets.items():
            both = len(sets[q] & v)
            j = both / (len(v) + len(sets[q]) - both)
            if both and j >= threshold:
                out[q, i] = (both, j, both / len(v))
    return out


@pytest.mark.parametrize("threshold", [0.01, 0.3, 1.0])
def test_many_queries(spark, threshold):
    rng = random.Random(2)
    sets = {i: {min(rng.randrange(60), rng.randrange(60)) for _ in range(rng.randrange(1, 40))} for i in range(40)} | {40: {5}, 41: {5}}
    df = spark.createDataFrame([(i, h) for i, v in sets.items() for h in v], "sample_id long, hash long")
    got = similarity.search(df.filter("sample_id in (0, 7, 40)").withColumnRenamed("sample_id", "query_id"), df, threshold)
    assert {(r[0], r[1]): pytest.approx(tuple(r)[2:]) for r in got.collect()} == brute(sets, (0, 7, 40), threshold)


def test_every_query_of_the_table(spark):
    sets = {}
    for r in Bound(spark, DIR).shingles.collect():
        sets.setdefault(r.sample_id, set()).add(r.hash)
    got = catalog.queries()["similarity_search"](spark, DIR).collect()
    assert {(r.query_id, r.sample_id): (r.both, r.jaccard, r.containment) for r in got} == {k: pytest.approx(v, abs=1e-8) for k, v in brute(sets, [i for i in sets if i % 50 == 0], 0.01).items()}
