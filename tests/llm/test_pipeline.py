"""The pipeline's stages, each against a plain version of its decision that shares no code with it."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as cp
from sparkfen.llm import registry
from sparkfen.session import scratch_path, table
from tests.llm.test_operators import measured, water_level

DIR = "/root/testdata/sf0.001"
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars", "n_words", "n_hit", "copies", "cleaned", "kept", "row", "rid")
SMALL = {65 + i: 97 + i for i in range(26)}
BENCH = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Documents with all that the stages must stand: no key, keys that repeat with equal and other texts, no text, copies and near
    copies, benchmark passages, very long texts, and columns with the stages' own names."""
    rng = random.Random(12)
    words = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    items = [words(30) for _ in range(5)] + [words(4)]
    texts = [words(rng.randrange(12, 90)) for _ in range(60)]
    for t in texts[:10]:  # near copies: one word of many is another
        texts.append([*t[:-1], "changed"])
    texts += [list(t) for t in texts[:12]]
    texts.append(words(30_000))
    for i in range(8):
        t = words(60)
        t[20:20] = items[i % 6]
        texts.append(t)
    texts += [items[0] + words(5), ["same"] * 50, words(3), []]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rows += [(None, " ".join(words(40))), (None, " ".join(words(40))), (None, rows[3][1]), (None, None), (7, " ".join(words(50))), (7, " ".join(words(50))), rows[9], rows[9], (900, None), (901, " \n ")]
    rng.shuffle(rows)
    made = [(d, t, rng.choice(("en", None)), rng.choice(("a", "b", None)), None if t is None else len(t), f"x{i}", i * 0.5, "own", i % 3 == 0, [i], {"k": i} and str(i), i) for i, (d, t) in enumerate(rows)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_words string, n_hit double, copies string, cleaned boolean, kept array<int>, row string, rid int"
    spark.createDataFrame(made, schema).repartition(5).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(9, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, items


def plain_quality(rows):
    def good(text):
        n, chars, symbols, dup, repeated = measured(text)
        lines = sum(bool(re.search("[^\\x20\\x09-\\x0D]", x)) for x in (text or "").split("\n"))
        marks = (text or "").count("!")
        return not (n < 10 or 100 * repeated > 20 * n or 10 * symbols > 5 * n or 10 * dup > 5 * lines or 10 * marks > 5 * n or chars < 2 * n or chars > 20 * n)

    return [r for r in rows if good(r[1])]


def plain_groups(rows):
    """Group of each row by links of five-word sets; None without words."""
    sets = []
    for r in rows:
        w = (r[1] or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(rows)))
    for i, s in enumerate(sets):
        for j in range(i):
            if s and 100 * len(s & sets[j]) >= 80 * len(s | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return [g if s else None for g, s in zip(group, sets)]


def plain_clean(text, items):
    """(text without benchmark spans, or None if it consists of them by half)."""
    found = list(BENCH.finditer((text or "").translate(SMALL)))
    low = [m[0] for m in found]
    hit = [False] * len(low)
    for item in items:
        n = min(10, len(item))
        windows = {tuple(item[i : i + n]) for i in range(len(item) - n + 1)}
        for i in range(len(low) - n + 1):
            if tuple(low[i : i + n]) in windows:
                hit[i : i + n] = [True] * n
    if not any(hit):
        return text
    if sum(hit) > 0.5 * len(hit):
        return None
    parts, at, i = [], 0, 0
    while i < len(hit):
        if hit[i]:
            j = i
            while j < len(hit) and hit[j]:
                j += 1
            parts.append(text[at : found[i].start()].rstrip())
            at, i = found[j - 1].end(), j
        else:
            i += 1
    return " ".join(x for x in [*parts, text[at:].lstrip()] if x)


def check_stages(spark, folder, items):
    stages = dict(cp.STAGES)
    docs = table(spark, folder, "documents")
    columns = docs.columns
    rows = as_rows(docs)
    good = stages["quality rules"](spark, docs, folder)
    assert good.columns == columns and as_rows(good) == plain_quality(rows)

    kept = as_rows(stages["near duplicates"](spark, good, folder))
    before, groups = plain_quality(rows), collections.defaultdict(list)
    for r, g in zip(before, plain_groups(before)):
        groups[g].append(r)
    assert len(kept) == len(groups) - (None in groups) + len(groups.get(None, []))
    assert not collections.Counter(map(repr, kept)) - collections.Counter(map(repr, before))
    for g, members in groups.items():
        here = [r for r in kept if any(repr(r) == repr(m) for m in members)]
        assert len(here) == (1 if g is not None else len(members))
        assert here[0][0] == min((m[0] for m in members if m[0] is not None), default=None)

    one = spark.createDataFrame(kept, docs.schema)
    clean = stages["benchmark passages"](spark, one, folder)
    want = []
    for r in kept:
        t = plain_clean(r[1], items)
        if r[1] is None or t is not None:
            want.append((r[0], t, r[2], r[3], r[4] if t == r[1] else len(t), *r[5:]))
    assert clean.columns == columns and as_rows(clean) == sorted(want, key=repr)

    mixed = stages["mixing"](spark, spark.createDataFrame(want, docs.schema), folder)
    got, sizes, taken = as_rows(mixed), collections.Counter(), collections.Counter()
    size = lambda r: len(re.findall("[^\\x20\\x09-\\x0D]+", r[1] or ""))
    largest = collections.Counter()
    for r in want:
        sizes[r[3]] += size(r)
        largest[r[3]] = max(largest[r[3]], size(r))
    for r in got:
        taken[r[3]] += size(r)
    assert mixed.columns == columns and all(abs(taken[s] - t) <= max(1, largest[s] / 2) for s, t in water_level(sizes).items())
    source, copies = collections.Counter(map(repr, want)), collections.Counter(map(repr, got))
    assert set(copies) <= set(source) and all(n <= 3 * source[k] for k, n in copies.items()) and all(size(r) for r in got)

    t, start = Tokenizer.from_file(registry.tokenizer_path("word_bpe_49k.json")), 0
    index = sorted(map(tuple, stages["token files"](spark, spark.createDataFrame(got, docs.schema), folder).collect()), key=lambda r: r[1])
    assert [r[0] for r in index] == sorted((r[0] for r in got), key=lambda k: (k is not None, k or 0))
    crc = collections.Counter()
    for r in got:
        ids = t.encode(r[1] or "", add_special_tokens=False).ids + [2]
        crc[r[0], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert collections.Counter((r[0], r[2], r[3]) for r in index) == crc
    for r in index:
        assert r[1] == start
        start += r[2]


def test_stages(spark):
    items = [BENCH.findall((r.text or "").translate(SMALL)) for r in table(spark, DIR, "benchmark").collect()]
    check_stages(spark, DIR, [i for i in items if i])


def test_stages_on_odd_documents(spark, corpus):
    check_stages(spark, *corpus)


def test_run(spark, corpus):
    """The whole is its stages one after the other, and leaves no stage but the last behind."""
    folder, _ = corpus
    out = cp.run(spark, folder).collect()
    docs = table(spark, folder, "documents")
    for _, stage in cp.STAGES:
        path = scratch_path(spark, "test")
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
    count = lambda rows: collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows)
    assert out and count(out) == count(docs.collect())


def test_empty_tables(spark, corpus, tmp_path):
    folder, _ = corpus
    for name in ("documents", "benchmark"):
        table(spark, folder, name).filter(F.lit(False)).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0
