"""Queries on k-mers against brute force on texts that are longer than a prefix of 400 letters."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest

from sparkfen.operators import sketches
from sparkfen.plans import catalog
from sparkfen.plans.sketches import LETTERS, LIMIT


def dna(text):
    return re.sub("[^a-z]", "", text.lower()).translate(str.maketrans("abcdefghijklmnopqrstuvwxyz", LETTERS)).upper()


def kmers(text):
    s = dna(text)
    found = [s[i : i + 11] for i in range(len(s) - 10)]
    return [min(f, f[::-1].translate(str.maketrans("ACGT", "TGCA"))) for f in found]


def md5(kmer):
    return int(hashlib.md5(kmer.encode()).hexdigest()[:15], 16)


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    rng = random.Random(3)
    made = {i: "".join(rng.choice("abcdefghij klmnop qrstuvwxyz.") for _ in range(n)) for i, n in enumerate((0, 9, 300, 700, 5000, 20_000), 1)}
    folder = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame(list(made.items()), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return folder, made


def rows(spark, name, folder):
    return {tuple(r) for r in catalog.queries()[name](spark, folder).collect()}


def test_sketches_read_whole_texts(spark, texts):
    folder, made = texts
    hashes = {i: {md5(k) for k in kmers(t)} for i, t in made.items()}
    assert rows(spark, "kmer_fmh", folder) == {(i, h) for i, v in hashes.items() for h in v if h <= LIMIT}
    assert rows(spark, "bottomk", folder) == {(i, h) for i, v in hashes.items() for h in sorted(v)[:20]}
    assert rows(spark, "sketch_union", folder) == {(len(set().union(*hashes.values())), sum(map(bool, hashes.values())))}


def test_profile_of_whole_texts(spark, texts):
    folder, made = texts
    got = {r[0]: r for r in rows(spark, "seq_profile", folder)}
    for i, t in made.items():
        s = dna(t)
        w = Counter(s[j : j + 3] for j in range(len(s) - 2))
        n = sum(w.values())
        want = (len(s), (s.count("G") + s.count("C")) / len(s) if s else None, max((len(x) for x in re.findall("A+|C+|G+|T+", s)), default=0), -sum(x / n * math.log2(x / n) for x in w.values()))
        assert got[i][1:] == pytest.approx(want)


@pytest.mark.parametrize("n", [0, 2, 3, 4, 7, 8, 9, 10, 23])
def test_windows_do_not_depend_on_pieces(spark, n):
    s = "ACGTTGCATTACGGATCCAGATA"[:n]
    got = sketches.windows(spark.createDataFrame([(1, s)], "sample_id long, seq string"), 3, piece=4)
    assert sorted((r.pos, r.kmer) for r in got.collect()) == [(i, s[i : i + 3]) for i in range(n - 2)]
