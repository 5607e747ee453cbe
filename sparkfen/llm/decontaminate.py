"""Benchmark passages in documents, found with one generalised suffix automaton of all test items.

Words are lower-cased (A-Z) runs of digits, letters and non-ASCII characters. The automaton takes a document's words
one by one and tracks the longest match that ends at each; a match of `window` words, or of a whole shorter item, is a
hit. Only stretches whose neighbouring word pairs all occur in some item are streamed, which skips nothing that can match.
"""

from __future__ import annotations

import re
import uuid
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkfen.llm.common import annotate, held

#: Bytes between words become blanks, capitals small letters; bytes of non-ASCII characters stay.
TABLE = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))
PLACED = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(data: bytes | None) -> list[bytes]:
    """The words of a text given as bytes."""
    return data.translate(TABLE).split() if data else []


class Matches:
    """What one document holds: hit (a flag for each word), items (indices) and longest (words of the longest match)."""

    def __init__(self, n: int) -> None:
        self.hit, self.items, self.longest, self.seen = np.zeros(n, bool), set(), 0, set()


class ItemAutomaton:
    """texts: the items; equal items may repeat. Time to build and memory are proportional to the items' words (but for a sort of the
    states by length), time to match to the document's, also where items repeat one word many times."""

    def __init__(self, texts: list[bytes | None], window: int) -> None:
        self.window, self.vocab = window, {}
        self.next, self.link, self.length = [{}], [-1], [0]
        items = [[self.vocab.setdefault(w, len(self.vocab)) for w in words_of(t)] for t in texts]
        for ids in items:
            last = 0
            for w in ids:
                last = self._grow(last, w)
        self.least = min([window, *(len(ids) for ids in items if ids)])
        pairs = {a * len(self.vocab) + b for ids in items for a, b in zip(ids, ids[1:])}
        self.pairs = np.array(sorted(pairs), np.int64)
        self.found: dict[int, set[int]] = {}  # items by the state that holds their windows of full length
        self.short: dict[int, list[tuple[int, int]]] = {}  # (words, item) of shorter items, by their state
        for k, ids in enumerate(items):
            if 0 < len(ids) < window:
                state = 0
                for w in ids:
                    state = self.next[state][w]
                self.short.setdefault(state, []).append((len(ids), k))
        #: For each state, the one among its suffixes that holds those of `window` words (-1: none), and the next with a short item (0: none).
        self.whole, self.brief = array("q", [-1]) * len(self.link), array("q", [0]) * len(self.link)
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            up = self.link[state]
            if self.length[state] >= window:
                self.whole[state] = state if self.length[up] < window else self.whole[up]
            self.brief[state] = state if state in self.short else self.brief[up]
        for k, ids in enumerate(items):
            state = 0
            for i, w in enumerate(ids):
                state = self.next[state][w]
                if i + 1 >= window:
                    self.found.setdefault(self.whole[state], set()).add(k)

    def _grow(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            to = nxt[last][w]
            return to if length[to] == length[last] + 1 else self._split(last, w, to)
        new = self._new({}, -1, length[last] + 1)
        while last >= 0 and w not in nxt[last]:
            nxt[last][w] = new
            last = link[last]
        if last < 0:
            link[new] = 0
        else:
            to = nxt[last][w]
            link[new] = to if length[to] == length[last] + 1 else self._split(last, w, to)
        return new

    def _split(self, at: int, w: int, to: int) -> int:
        copy = self._new(dict(self.next[to]), self.link[to], self.length[at] + 1)
        self.link[to] = copy
        while at >= 0 and self.next[at].get(w) == to:
            self.next[at][w] = copy
            at = self.link[at]
        return copy

    def _new(self, edges: dict, link: int, length: int) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def match(self, words: list[bytes]) -> Matches:
        """Streams a document's words."""
        out = Matches(len(words))
        if not self.vocab or len(words) < self.least:
            return out
        get = self.vocab.get
        ids = np.array([get(w, -1) for w in words], np.int64)
        if self.least > 1:
            both = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
            codes = ids[both] * len(self.vocab) + ids[both + 1]
            at = np.searchsorted(self.pairs, codes)
            at[at == len(self.pairs)] = 0
            both = both[self.pairs[at] == codes] if len(self.pairs) else both[:0]
            need = self.least - 1
        else:
            both, need = np.flatnonzero(ids >= 0), 1
        if len(both) < need:
            return out
        cuts = np.flatnonzero(np.diff(both) > 1)
        for a, b in zip(np.r_[0, cuts + 1], np.r_[cuts, len(both) - 1]):
            if b - a + 1 >= need:
                self._stream(ids, int(both[a]), int(both[b]) + 1 + (self.least > 1), out)
        return out

    def _stream(self, ids: np.ndarray, start: int, end: int, out: Matches) -> None:
        nxt, link, length, window, whole, brief = self.next, self.link, self.length, self.window, self.whole, self.brief
        state = size = 0
        for i, w in enumerate(ids[start:end].tolist(), start):
            while state and w not in nxt[state]:
                state = link[state]
                size = length[state]
            if w in nxt[state]:
                state, size = nxt[state][w], size + 1
            if size < self.least:
                continue
            out.longest = max(out.longest, size)
            if size >= window:
                out.hit[i + 1 - window : i + 1] = True
                at = whole[state]
                if at not in out.seen:
                    out.seen.add(at)
                    out.items |= self.found.get(at, set())
            s = brief[state]
            while s:  # at most one state for each number of words below `window`
                n = self.short[s][0][0]
                if n <= size:
                    out.hit[i + 1 - n : i + 1] = True
                    if s not in out.seen:
                        out.seen.add(s)
                        out.items.update(item for _, item in self.short[s])
                s = brief[link[s]]


FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("item_ids", T.ArrayType(T.StringType())), T.StructField("longest_match", T.LongType())]


def find_items(df: DataFrame, items: DataFrame, window: int = 10, text: str = "text", clean: bool = False, max_item_bytes: int = 16_000_000) -> DataFrame:
    """df with n_words, n_hit (words inside an occurring window), item_ids (strings, sorted, of items with occurring
    windows), longest_match (words, 0 below the shortest window) and, with clean, cleaned (the text without hit spans).

    A missing text has no words and stays missing. Items without words never match; an item without an id counts for
    hits but is not named. Repeated items and rows are fine. The items go to the driver and, as an automaton, to each
    worker, where a word of theirs takes up to about 0.7 kB; so more than max_item_bytes of item text (some 2.5 million
    words and 1.8 GB at the default) is an error. Documents stay where they are, very long ones are streamed like all.
    """
    chosen = items.select(F.col("item_id").cast("string"), F.col("text")).filter("text is not null").distinct()
    size = chosen.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if size > max_item_bytes:
        raise ValueError(f"{size} bytes of items; the bound is {max_item_bytes}")
    rows = sorted((r.item_id or "", r.text, r.item_id is None) for r in chosen.collect())
    names = [None if r[2] else r[0] for r in rows]
    tag = uuid.uuid4().hex
    shared = df.sparkSession.sparkContext.broadcast((names, [r[1].encode() for r in rows], window))
    fields = FIELDS + [T.StructField("cleaned", T.StringType())] * clean

    def start():
        labels, texts, width = shared.value
        automaton = held("items", tag, lambda: ItemAutomaton(texts, width))

        def work(batch: pa.RecordBatch) -> list:
            out: list[list] = [[] for _ in fields]
            for cell in batch.column(batch.schema.get_field_index("__text")).cast(pa.binary()):
                data = cell.as_py()
                words = words_of(data)
                m = automaton.match(words)
                n_hit = int(m.hit.sum())
                row = [len(words), n_hit, sorted({labels[k] for k in m.items if labels[k] is not None}), m.longest]
                if clean:
                    row.append(without(data.decode(), m.hit) if n_hit else None if data is None else data.decode())
                for column, value in zip(out, row):
                    column.append(value)
            return out

        return work

    return annotate(df.withColumn("__text", F.col(f"`{text}`")), fields, start).drop("__text")


def without(text: str, hit: np.ndarray) -> str:
    """The text with every stretch of hit words cut, one blank in its place."""
    out, done, spans = [], 0, [m.span() for m in PLACED.finditer(text)]
    edge = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8)))
    for a, b in zip(edge[::2], edge[1::2]):
        out.append(text[done : spans[a][0]].rstrip())
        done = spans[b - 1][1]
    return " ".join(x for x in [*out, text[done:].lstrip()] if x)


def digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The columns of the query over documents."""
    found = find_items(docs.select("doc_id", "text"), items)
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def clean_documents(docs: DataFrame, items: DataFrame, max_coverage: float = 0.5) -> DataFrame:
    """docs with benchmark spans cut out of text; a document with more than max_coverage of its words hit is dropped.

    n_chars, if there, follows the new text. Documents without a hit, a missing or an empty text among them, are untouched,
    as are all other columns, whatever their names; repeated rows are treated alike.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col("text"))
    found = find_items(rows, items, clean=True)
    kept = found.filter((F.col("n_hit") == 0) | (F.col("n_hit") <= max_coverage * F.col("n_words")))
    hit, old = F.col("n_hit") > 0, lambda c: F.col(f"__row.`{c}`")
    new = {"text": F.when(hit, F.col("cleaned")).otherwise(old("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(hit, F.length("cleaned").cast(docs.schema["n_chars"].dataType)).otherwise(old("n_chars"))
    return kept.select(*[new.get(c, old(c)).alias(c) for c in docs.columns])
