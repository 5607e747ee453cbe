"""Language identification: known words by their frequency, unknown ones by ever shorter character n-grams.

The model is fitted on a bounded sample of labelled documents, all of whose words and n-grams it keeps. A known word
scores with its log frequency in each language; any other backs off to its character n-grams (with word borders), from
ORDERS' longest to its shortest, using the first order of which the model knows any.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkfen.llm.common import annotate, held

ORDERS = (4, 3, 2, 1)
#: A word: a letter, then letters and marks.
WORDS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
#: The same where no character needs Unicode's classes: below U+0250 all alphanumerics but digits and these six are letters.
SIMPLE, OTHERS = re.compile(r"[^\W\d_]+"), re.compile("[\u00b2\u00b3\u00b9\u00bc-\u00be\u0250-\U0010ffff]")


def words_in(text: str | None) -> list[str]:
    """The lower-cased words of a text."""
    if not text:
        return []
    low = text.lower()
    return (WORDS if OTHERS.search(low) else SIMPLE).findall(low)


def grams(word: str, n: int, start: int = 0, most: int = 1 << 60) -> list[str]:
    """The n-grams of a word between borders, `most` of them from the start-th; of one letter, without borders."""
    padded = word if n == 1 else f"^{word}$"
    return [padded[i : i + n] for i in range(start, min(len(padded) - n + 1, start + most))]


#: Words that the share of a feature in all languages together counts for in each language.
POOLED = 20.0
#: Longer words are scored each time anew rather than kept.
LONGEST = 64


class Model:
    """langs in code-point order; tables: order (0 for words) -> feature -> its row in that order's matrix of log frequencies."""

    def __init__(self, langs: list[str], counts: dict[int, tuple[list[str], np.ndarray]]) -> None:
        self.langs, self.tables, self.logs = langs, {}, {}
        for order, (features, by) in counts.items():
            self.tables[order] = {f: i for i, f in enumerate(features)}
            # A language with hardly any text has hardly more than the share of all languages, which favours none.
            self.logs[order] = np.log((by + POOLED * by.sum(axis=1, keepdims=True) / by.sum()) / (by.sum(axis=0) + POOLED)).astype(np.float32)

    def score(self, word: str) -> np.ndarray:
        """The log score of a word in each language, relative to the best."""
        at = self.tables.get(0, {}).get(word)
        found = None if at is None else self.logs[0][at].astype(float)
        if found is None:
            for n in ORDERS:
                table = self.tables.get(n, {})
                for start in range(0, len(word) + 2, 4096):
                    known = [i for g in grams(word, n, start, 4096) if (i := table.get(g)) is not None]
                    if known:
                        found = self.logs[n][known].sum(axis=0, dtype=float) + (0.0 if found is None else found)
                if found is not None:
                    break
        return np.zeros(len(self.langs)) if found is None else found - found.max()


class Scorer(dict):
    """word of LONGEST letters at most -> row of a growing matrix of scores; emptied when it holds `bound` words, or as many as make a
    matrix of 60 MB where there are more languages than 12."""

    def __init__(self, model: Model, bound: int) -> None:
        self.model, self.bound = model, max(4096, min(bound, 7_500_000 // max(1, len(model.langs))))
        self.rows = np.zeros((self.bound + 1, len(model.langs)))

    def __missing__(self, word: str) -> int:
        k = len(self)
        self.rows[k] = self.model.score(word)
        self[word] = k
        return k

    def predict(self, text: str | None) -> tuple[str, float]:
        """The likeliest language and its share, tempered by the root of the number of words."""
        words = words_in(text)
        if not words or not self.model.langs:
            return "und", 0.0
        total = np.zeros(len(self.model.langs))
        for i in range(0, len(words), 4096):
            part = words[i : i + 4096]
            if max(map(len, part)) > LONGEST:
                total += sum(self.model.score(w) for w in part if len(w) > LONGEST)
                part = [w for w in part if len(w) <= LONGEST]
            if len(self) + len(part) > self.bound:
                self.clear()
            total += self.rows[np.fromiter(map(self.__getitem__, part), np.int64, len(part))].sum(axis=0)
        best = int(total.argmax())
        return self.model.langs[best], float(1 / np.exp((total - total[best]) / math.sqrt(len(words))).sum())


def fit(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", docs_per_lang: int = 500, bytes_per_lang: int = 8_000_000, max_langs: int = 200) -> Model:
    """A model from about docs_per_lang documents of each language (by a hash of key and text; all where there are fewer).

    The sample is bounded in every way, as all its words and n-grams go to the driver and, in the model, to each worker:
    about bytes_per_lang of text a language, of documents of an eighth of that at most, and the max_langs most frequent
    languages (of equally frequent ones the first by code point). Rows without text or lang are left out; repeated rows are picked together or not at all. No usable rows
    give a model that knows no language. The table is read twice: the languages' counts, then the sample.
    """
    rows = df.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"), F.col(f"`{key}`").alias("key")).filter("text is not null and lang is not null")
    rows = rows.filter(F.octet_length("text") <= bytes_per_lang // 8)
    found = rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).orderBy(F.desc("n"), "lang").limit(max_langs).collect()
    counts = {r.lang: max(r.n, 1 + docs_per_lang * r.b // bytes_per_lang) for r in found}
    if not counts:
        return Model([], {})
    langs = sorted(counts)
    share = F.element_at(F.create_map(*[x for name in langs for x in (F.lit(name), F.lit(int(min(1.0, docs_per_lang / counts[name]) * (1 << 30))))]), F.col("lang"))
    picked = rows.filter(F.col("lang").isin(langs) & (F.pmod(F.xxhash64("key", "text"), F.lit(1 << 30)) < share)).select("text", "lang")
    schema = T.StructType([T.StructField("ord", T.IntegerType()), T.StructField("feature", T.StringType()), T.StructField("k", T.IntegerType()), T.StructField("n", T.LongType())])
    place = {name: k for k, name in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[str, Counter] = defaultdict(Counter)
        for b in batches:
            for t, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                by[name].update(words_in(t))
        for name, seen in by.items():
            features: dict[int, Counter] = {0: seen} | {n: Counter() for n in ORDERS}
            for w, c in seen.items():
                for n in ORDERS:
                    for g in grams(w, n):
                        features[n][g] += c
            for n, table in features.items():
                yield pa.RecordBatch.from_arrays([pa.array([n] * len(table), pa.int32()), pa.array(list(table), pa.string()), pa.array([place[name]] * len(table), pa.int32()), pa.array(list(table.values()), pa.int64())], names=schema.names)

    summed = picked.mapInArrow(run, schema).groupBy("ord", "feature", "k").agg(F.sum("n").alias("n")).orderBy("ord", "feature", "k").toPandas()
    model = {}
    for n, part in summed.groupby("ord"):
        code, features = part["feature"].factorize()
        by = np.zeros((len(features), len(langs)))
        by[code, part["k"].to_numpy()] = part["n"].to_numpy()
        model[int(n)] = (features.tolist(), by)
    return Model(langs, model)


FIELDS = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]


def identify(df: DataFrame, model: Model, text: str = "text", cache_size: int = 600_000) -> DataFrame:
    """df with lang_pred and score (0 to 1) of each whole text.

    A missing text, or one without letters, is und with score 0, as is every text if the model knows no language. Ties
    take the first language by code point. Very long texts are scored in parts. Columns of df with these names are
    replaced, repeated rows are treated alike. Rows stay where they are; the model's size is bounded by fit.
    """
    tag = uuid.uuid4().hex
    shared = df.sparkSession.sparkContext.broadcast(model)

    def start():
        scorer = held("languages", tag, lambda: Scorer(shared.value, cache_size))

        def work(batch: pa.RecordBatch) -> list:
            made = [scorer.predict(t.as_py()) for t in batch.column(batch.schema.get_field_index("__text"))]
            return [[m[0] for m in made], [m[1] for m in made]]

        return work

    return annotate(df.withColumn("__text", F.col(f"`{text}`")), FIELDS, start).drop("__text")


def held_out(key: Column) -> Column:
    """The documents that are not learned from: crc32 of the key as text, modulo 3, is 1. Without a key: false."""
    return F.coalesce(F.crc32(key.cast("string")) % 3 == 1, F.lit(False))


def digest(docs: DataFrame) -> DataFrame:
    """The columns of the query over documents."""
    model = fit(docs.select("doc_id", "text", "lang").filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))))
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return identify(rows, model).drop("text")
