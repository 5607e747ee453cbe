"""Ranked lexical search against a plain computation over all documents."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkfen.llm import lexical
from tests.llm.test_operators import ODD

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(rows, items, top):
    docs = [(k, collections.Counter(terms(t))) for k, t in rows if terms(t)]
    n_all, l_all = len(docs), sum(sum(c.values()) for _, c in docs)
    df = collections.Counter(w for _, c in docs for w in c)
    weight = {w: math.floor(1000 * math.log((2 * n_all + 2) / (2 * n + 1))) for w, n in df.items()}
    out = []
    for item, text in set(items):
        scored = []
        for k, c in docs:
            m = 100 - 50 + (50 * sum(c.values()) * n_all) // l_all
            s = sum(weight[w] * ((1_000_000_000 * c[w]) // (1000 * c[w] + 20 * m)) for w in set(terms(text)) if w in c)
            if s > 0:
                scored.append((-s, k is not None, k or 0))
        out += [(item, i + 1, k if there else None, -s) for i, (s, there, k) in enumerate(sorted(scored)[:top])]
    return sorted(map(repr, out))


def got(docs, items, **kw):
    return sorted(repr((r.item_id, r.rank, r.doc_id, r.score)) for r in lexical.rank_documents(docs, items, **kw).collect())


def corpus(n, seed=1):
    rng = random.Random(seed)
    words = [f"W{i}" for i in range(300)]
    return [(i, " ".join(rng.choices(words, [1 / (k + 1) for k in range(300)], k=rng.randrange(1, 120)))) for i in range(n)], rng


@pytest.mark.parametrize("head", [0, 40, 10**9])
def test_against_all_scores(spark, head):
    """With thresholds from no, some and all documents; many copies tie."""
    rows, rng = corpus(900)
    rows += [(2000 + i, rows[i % 7][1]) for i in range(300)] + ODD
    items = [(i, " ".join(rng.choices([f"w{k}" for k in range(300)], k=rng.randrange(1, 25)))) for i in range(12)] + [(50, "x no key"), (51, ""), (52, None), (53, "nowhere-found"), (None, "w1 w250"), (50, "w3"), (50, "w3")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6).withColumn("score", F.lit("s")).withColumn("n", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert got(docs, bench, top=20, head_rows=head, bucket=64) == plain(rows, [x for x in items if x[1] is not None], 20)
    assert got(docs.filter("1=0"), bench) == [] and got(docs, bench.filter("1=0")) == []
    with pytest.raises(ValueError):
        lexical.rank_documents(docs, bench, max_item_bytes=10)


def test_bounds_skip(spark):
    """Buckets in the order of lengths, a floor for each item: most documents are skipped, and none of the best."""
    rng = np.random.default_rng(2)
    weights = rng.integers(1, 9000, 40)
    docs = [np.sort(rng.choice(40, rng.integers(1, 30), replace=False)) for _ in range(3000)]
    items = [np.array([k, k + 1, k + 2]) for k in range(0, 36, 3)]
    ends, flat = np.cumsum([len(d) for d in docs]), np.concatenate(docs)
    times, n = rng.integers(1, 6, len(flat)), rng.integers(30, 900, 3000)
    s = lexical.Scorer(weights, items, 3000, int(n.sum()), np.zeros(12, np.int64), 10)
    size = s.lengths(ends, flat, s.impacts(n, ends, times))
    whole = {i: dict(zip(p.tolist(), v.tolist())) for i, p, v in lexical.Scorer(weights, items, 3000, int(n.sum()), np.zeros(12, np.int64), 3000).bucket(None, n, ends, flat, times)}
    best, starts = lexical.Best(10), np.r_[0, ends[:-1]]
    order = np.argsort(-size)
    for at in range(0, 3000, 100):
        part = order[at : at + 100]
        pick = np.concatenate([np.arange(starts[p], ends[p]) for p in part])
        for i, places, scores in s.bucket(None, n[part], np.cumsum([ends[p] - starts[p] for p in part]), flat[pick], times[pick]):
            s.floors[i] = max(s.floors[i], best.add(i, part[places].tolist(), scores.tolist()))
    assert {i: [(k, -v) for v, _, k in r] for i, r in best.rows.items()} == {i: sorted(w.items(), key=lambda x: (-x[1], x[0]))[:10] for i, w in whole.items()}
    assert s.skipped > 0.3 * 3000 * 12


def test_long_texts_are_counted_in_stretches():
    data = ("a Bee, see " * 1000).encode()
    assert lexical.counted(data, {b"bee": 1, b"x": 2}, 50) == lexical.counted(data, {b"bee": 1, b"x": 2}) == (3000, collections.Counter({1: 1000}))
