"""Token counts without shuffling pre-tokens: a broadcast table of frequent lengths, then a cache in each worker.

A text is cut into pieces at white space such that the tokenizer's own cuts lie at every piece border; a piece's token
count then never depends on its neighbours. Counts of the frequent pieces, from a bounded sample of documents, are
broadcast; the others are encoded once by each worker and kept in a bounded cache. Texts with white space outside ASCII,
or with special strings, are encoded whole.
"""

from __future__ import annotations

import json
import re
import uuid
from collections import Counter

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkfen.llm.common import annotate, held

#: A blank with the non-white characters after it, or white space split as the byte-level pattern splits it.
PIECE = re.compile(rb" ?[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+(?![^\x20\x09-\x0D])|[\x20\x09-\x0D]+")
#: White space that the tokenizer's pattern knows besides PIECE's.
OTHER_SPACE = re.compile("[\\x1c-\\x1f\\x85\\xa0\\u1680\\u180e\\u2000-\\u200b\\u2028\\u2029\\u202f\\u205f\\u2060\\u3000\\ufeff]")
FIELDS = [T.StructField("n_tokens", T.LongType())]
_OPEN: dict[str, object] = {}


def tokenizer(path: str):
    """The tokenizer of a file, opened once in each process."""
    if path not in _OPEN:
        from tokenizers import Tokenizer

        _OPEN[path] = Tokenizer.from_file(path)
    return _OPEN[path]


#: Printable ASCII and Latin letters, composed already and lower-cased one by one.
PLAIN = regex.compile("[ -~\u00c0-\u012f\u0131-\u017f]+")
#: The steps before the merges for which PieceCounts knows a shorter way, and their pattern.
KNOWN_STEPS = {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}, "post_processor": None}
CUT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PartCounts(dict):
    """A part of plain characters that the tokenizer would cut out -> its tokens, from the tokenizer's merges alone."""

    def __init__(self, model, half: int) -> None:
        self.merge, self.chars, self.half, self.old = model.tokenize, byte_chars(), half, {}

    def __missing__(self, part: str) -> int:
        n = self.old.get(part)
        if n is None:
            n = len(self.merge(part.encode().decode("latin-1").translate(self.chars)))
        if len(part) <= 64:
            if len(self) >= self.half:
                self.old = dict(self)
                self.clear()
            self[part] = n
        return n


class PieceCounts(dict):
    """piece -> tokens; of what is not in `known`, about `bound` pieces used lately are kept."""

    def __init__(self, path: str, known: dict[bytes, int], bound: int) -> None:
        super().__init__(known)
        self.encoder, self.known, self.half, self.old = tokenizer(path), known, len(known) + bound // 2, {}
        steps = json.loads(self.encoder.to_str())
        self.plain = all(steps.get(k) == v for k, v in KNOWN_STEPS.items()) and steps["model"]["type"] == "BPE" and not steps["model"].get("dropout")
        self.whole = tuple(t["content"].encode() for t in steps["added_tokens"])
        self.special = re.compile(b"|".join(re.escape(w[:2]) for w in self.whole) or b"(?!)")
        self.parts = PartCounts(self.encoder.model, bound // 4)

    def tokens_of(self, piece: bytes) -> int:
        """The tokens of one piece: cut here into parts, which many pieces share, where the cuts are known, else by the whole tokenizer."""
        text = piece.decode()
        if self.plain:
            if piece.isalpha() or piece[:1] == b" " and piece[1:].isalpha():  # ASCII letters only
                return self.parts[text]
            if PLAIN.fullmatch(text) and not self.special.search(piece):
                return sum(map(self.parts.__getitem__, CUT.findall(text)))
        return len(self.encoder.encode(text, add_special_tokens=False).ids)

    def __missing__(self, piece: bytes) -> int:
        n = self.old.get(piece)
        if n is None:
            n = self.tokens_of(piece)
        if len(piece) <= 64:
            if len(self) >= self.half:
                self.old = dict(self)
                self.clear()
                self.update(self.known)
            self[piece] = n
        return n

    def count(self, text: str | None, data: bytes) -> int:
        """Tokens of a whole text, given also as bytes."""
        if not data:
            return 0
        if text is not None and OTHER_SPACE.search(text) or any(w in data for w in self.whole):
            return len(self.encoder.encode(data.decode(), add_special_tokens=False).ids)
        return sum(map(self.__getitem__, PIECE.findall(data)))


def frequent_pieces(df: DataFrame, text: str, sample_docs: int, table_size: int) -> list[bytes]:
    """The most frequent pieces of about sample_docs documents, picked by place, so that copies are picked apart.

    It only decides what is precomputed.
    """
    rows = df.select(F.col(f"`{text}`").alias("t"), F.xxhash64(F.monotonically_increasing_id()).alias("u"))
    share = min(1.0, sample_docs / max(1, df.count()))
    picked = rows.filter((F.pmod("u", F.lit(1 << 30)) < int(share * (1 << 30)) + 1) & F.col("t").isNotNull()).select("t")
    schema = T.StructType([T.StructField("piece", T.BinaryType()), T.StructField("n", T.LongType())])

    def run(batches):
        seen: Counter = Counter()
        for b in batches:
            for t in b.column(0).cast(pa.binary()).to_pylist():
                seen.update(p for p in PIECE.findall(t) if len(p) <= 64)
        top = seen.most_common(table_size)
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in top], pa.binary()), pa.array([n for _, n in top], pa.int64())], names=["piece", "n"])

    best = picked.mapInArrow(run, schema).groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(table_size)
    return [bytes(r.piece) for r in best.collect()]


def count_tokens(df: DataFrame, path: str, text: str = "text", sample_docs: int = 5_000, table_size: int = 20_000, cache_size: int = 600_000) -> DataFrame:
    """df with n_tokens: the tokens of each whole text, special strings inside handled as the tokenizer does by default.

    A missing or empty text has 0; a column n_tokens of df is replaced. The broadcast table has at most table_size entries (a piece of at most 64 bytes and
    a count each, so under 3 MB), a worker's cache cache_size; what they don't hold is encoded, so both bound only
    memory. Rows stay where they are.
    """
    known = {}
    frequent = frequent_pieces(df, text, sample_docs, table_size)
    encoder = tokenizer(path)
    for i in range(0, len(frequent), 5_000):
        part = [p for p in frequent[i : i + 5_000]]
        for p, e in zip(part, encoder.encode_batch([p.decode() for p in part], add_special_tokens=False)):
            known[p] = len(e.ids)
    tag = uuid.uuid4().hex
    shared = df.sparkSession.sparkContext.broadcast(known)

    def start():
        counts = held("pieces", (path, tag, cache_size), lambda: PieceCounts(path, shared.value, cache_size))

        def work(batch: pa.RecordBatch) -> list:
            column = batch.column(batch.schema.get_field_index("__text")).cast(pa.binary())
            out = []
            for data in column:
                data = data.as_py() or b""
                out.append(counts.count(None if data.isascii() else data.decode(), data))
            return [out]

        return work

    return annotate(df.withColumn("__text", F.col(f"`{text}`")), FIELDS, start).drop("__text")


def digest(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """The columns of the query over documents."""
    rows = docs.select("doc_id", "text")
    return count_tokens(rows, path).select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
