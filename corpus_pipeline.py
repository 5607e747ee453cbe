"""A corpus through five stages: quality rules, near duplicates, benchmark passages, mixing, token files.

Each stage takes (spark, docs, sf_dir) and returns a frame; all but the last return the columns of documents, with the values
they had, whatever other columns there are and however they are called. Nulls in any column, repeated rows and empty tables
are fine; what each stage does with them is said below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkfen.llm import decontaminate, mixing, near_dup, quality, registry, token_store
from sparkfen.session import remove, scratch_path, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality policy rejects; a missing or empty text has too few words. Repeated rows go or
    stay together."""
    return quality.keep_good(docs)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8): the smallest doc_id, or any if none
    has one. Rows of a group that share it are reduced to one; rows without words are in no group and stay. Unlike texts stay
    also where they share a doc_id or have none."""
    return near_dup.keep_one(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without benchmark passages of ten words, and without documents that consist of them by half; n_chars follows. Rows without
    a hit, or a text, are untouched."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mix of sources takes; a missing source is one of its own. Rows without words are
    left out, as they add nothing. Rows that share a doc_id, have none or are equal have each their own number of copies."""
    return mixing.apply_mix(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The index of the token files: a row for each document and copy, in the order of the ids, those without a doc_id first. A
    missing or empty text has the end id only."""
    return token_store.digest(docs, registry.tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", keep_good),
    ("near duplicates", keep_one_of_each),
    ("benchmark passages", cut_benchmark),
    ("mixing", mix_sources),
    ("token files", write_tokens),
]

#: Tokenizing and MinHash have no SQL; tests/llm holds the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written to the shared folder, read again, and deleted after the next one."""
    docs, before = registry.documents(spark, sf_dir), None
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        path = scratch_path(spark, f"stage{k}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
