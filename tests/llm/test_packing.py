"""Packing and id encoding against the tokenizers and plain checks of every rule."""

import collections
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkfen.llm import packing, registry, text_ids
from sparkfen.session import table
from tests.llm.test_operators import DIR, ODD

PATH = "byte_bpe_50k.json"
ENCODERS: dict = {}


@given(st.lists(st.sampled_from([" ", "  ", "\n", "\t\n", "a", "É", "x²", "'s", "'S", "<|endoftext|>", "<|ENDOFTEXT|>", "12", "!", " ", "😀", "Don't", "　", "é", "İ", "\x85", ".", "_", "×", "ÿ", "ß", "ﬁ", "\x1c", "\x7f", "\x00", "\x01", "ſ", "K", "the "]), max_size=10).map("".join))
@settings(max_examples=500, deadline=None)
def test_ids_are_the_tokenizers(text):
    for name in (PATH, "word_bpe_49k.json"):
        path = registry.tokenizer_path(name)
        t = ENCODERS.setdefault(name, ENCODERS.get(name) or text_ids.TextIds(path))
        assert t.merge is not None and t.encode(text.encode()) == t.whole(text.encode())


def test_stretches():
    for name in (PATH, "word_bpe_49k.json"):
        t = text_ids.TextIds(registry.tokenizer_path(name))
        data = ("one two,  three\n\nfour's é " * 400).encode()
        cut = list(text_ids.stretches(data, 100))
        assert b"".join(cut) == data and len(cut) > 50 and b"".join(map(t._stretch, cut)) == t.whole(data) == t.encode(data)
    assert list(text_ids.stretches(b"x" * 50, 10)) == [b"x" * 50]


def check(rows, want, width=1024, least=8):
    """Every id in one piece, gapless offsets, lengths, and the padding."""
    docs, seqs = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        assert len(r.ids) == 4 * r.length > 0
        docs[r.doc_id].append(r)
        seqs[r.sequence_id].append((r.offset, r.length))
    got = collections.Counter()
    for key, pieces in docs.items():
        texts = collections.Counter(zlib.crc32(w) for w in want[key])
        if len(want[key]) == 1:
            joined = b"".join(p.ids for p in sorted(pieces, key=lambda p: p.start))
            assert joined == want[key][0] and all(p.doc_tokens == len(joined) // 4 for p in pieces)
        assert sum(p.length for p in pieces) == sum(len(w) // 4 for w in want[key])
        got[key] = sum(texts.values())
    assert got == collections.Counter({k: len(v) for k, v in want.items()})
    pad = 0
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert 0 < at <= width
        pad += 0 if at & (at - 1) == 0 else width - at
        assert at & (at - 1) == 0 or width - at < least
    return pad, len(seqs)


def expected(rows):
    t, out = Tokenizer.from_file(registry.tokenizer_path(PATH)), collections.defaultdict(list)
    for r in rows:
        out[r.doc_id].append(np.array(t.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4").tobytes())
    return out


def test_documents(spark):
    docs = table(spark, DIR, "documents")
    made = packing.pack(docs.repartition(5), registry.tokenizer_path(PATH), merge=2).cache()
    rows = made.collect()
    pad, n = check(rows, expected(docs.collect()))
    assert pad < 0.002 * sum(r.length for r in rows)
    joined = packing.sequences(made).collect()
    assert len(joined) == n and all(len(r.ids) == 4 * r.n_tokens and r.padded in (1024, r.n_tokens) for r in joined)
    first = {r.sequence_id: r.ids for r in rows if r.offset == 0}
    assert all(r.ids.startswith(first[r.sequence_id]) for r in joined)
    ids = {(r.doc_id, r.start): r.ids for r in rows}
    assert all(r.ids_crc32 == zlib.crc32(ids[r.doc_id, r.start]) for r in packing.digest(docs.repartition(5), registry.tokenizer_path(PATH)).collect() if (r.doc_id, r.start) in ids and len(ids[r.doc_id, r.start]) == 4 * r.length)


@pytest.mark.parametrize("parts", [1, 13])
def test_odd_rows(spark, parts):
    """Nulls, empty and very long texts, repeated rows, a hot key and clashing columns; an empty table."""
    df = spark.createDataFrame(ODD * 3, "doc_id long, text string").repartition(parts).withColumn("start", F.lit("x")).withColumn("sequence_id", F.lit(1))
    check(packing.pack(df, registry.tokenizer_path(PATH), merge=3, open_windows=4).collect(), expected(df.collect()))
    assert packing.digest(df.filter("1=0"), registry.tokenizer_path(PATH)).count() == 0


@given(st.lists(st.integers(1, 40), max_size=60), st.integers(1, 4), st.integers(1, 4))
@settings(max_examples=200, deadline=None)
def test_windows(sizes, most, least):
    w, seen = packing.Windows(16, most, least), []
    for k, n in enumerate(sizes):
        w.add([packing.Piece(k, 0, n, bytes(4 * n))])
        assert len(w.rooms) <= most
        seen += w.out
        w.out = []
    assert all(16 - sum(p.length for p in s) < least for s in seen)
    w.close()
    tail = [sum(p.length for p in s) for s in w.out]
    assert all(n & (n - 1) == 0 for n in tail)
    covered = collections.defaultdict(list)
    for s in seen + w.out:
        for p in s:
            covered[p.key] += range(p.start, p.start + p.length)
    assert {k: sorted(v) for k, v in covered.items()} == {k: list(range(n)) for k, n in enumerate(sizes)}


def test_best_fit():
    w = packing.Windows(16, 2, 1)
    for k, n in enumerate((10, 7, 6)):  # the third fits the first window exactly
        w.add([packing.Piece(k, 0, n, bytes(4 * n))])
    assert [[p.key for p in s] for s in w.out] == [[0, 2]] and [r for r, _ in w.rooms] == [9]


def test_rounds_of_many_tasks(spark):
    """With far more tasks than one merge takes, the last padding stays that of one task."""
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["a", "bee", "sea"]) for _ in range(rng.randrange(1, 90)))) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(60)
    pad, _ = check(packing.pack(df, registry.tokenizer_path(PATH), merge=4).collect(), expected(df.collect()))
    assert pad < 8 * 60
