"""Allow and block lists for URLs: a trie over reversed host labels, then over path segments.

A rule fits its host and all subdomains if the path starts with the rule's path. The rule with more host labels wins,
then the one with the longer path, then allow before block.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sparkfen.llm.common import annotate

URL = re.compile(r"://([^/?#]*)([^?#]*)")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
FIELDS = [T.StructField(n, T.StringType()) for n in ("host", "path", "rule", "verdict")]


def parts_of(url: str | None) -> tuple[str, str]:
    """Host and path of a URL; both empty if there is no ://."""
    m = URL.search(url or "")
    return (m[1].translate(LOWER), m[2]) if m else ("", "")


class UrlTrie:
    """rules: (verdict, 'host/path'); a rule without a slash has an empty path and fits every path of its host."""

    def __init__(self, rules: Sequence[tuple[str, str]], default: str = "allow") -> None:
        self.default, self.root = default, {"kids": {}, "paths": None}
        for verdict, text in rules:
            if verdict not in ("allow", "block"):
                raise ValueError(f"unknown verdict {verdict!r}")
            host, slash, path = text.partition("/")
            node = self.root
            for label in reversed(host.translate(LOWER).split(".")):
                node = node["kids"].setdefault(label, {"kids": {}, "paths": None})
            tree = node["paths"] = node["paths"] or {"kids": {}, "ends": {}}
            *whole, last = (slash + path).split("/")
            for segment in whole:
                tree = tree["kids"].setdefault(segment, {"kids": {}, "ends": {}})
            if tree["ends"].get(last, ("block",))[0] == "block":
                tree["ends"][last] = (verdict, text)

    @staticmethod
    def _longest(tree: dict, path: str) -> tuple[str, str] | None:
        best = None
        for segment in path.split("/"):
            ends = tree["ends"]
            if ends:
                found = next((ends[segment[:n]] for n in range(min(len(segment), max(map(len, ends))), -1, -1) if segment[:n] in ends), None)
                best = found or best
            tree = tree["kids"].get(segment)
            if tree is None:
                break
        return best

    def judge(self, host: str, path: str) -> tuple[str | None, str]:
        """The rule that decides, or None, and the verdict."""
        best, node = None, self.root
        for label in reversed(host.split(".")) if host else ():
            node = node["kids"].get(label)
            if node is None:
                break
            if node["paths"]:
                best = self._longest(node["paths"], path) or best
        return (best[1], best[0]) if best else (None, self.default)


def judge_urls(df: DataFrame, rules: Sequence[tuple[str, str]], url: str = "url", default: str = "allow", max_rules: int = 200_000) -> DataFrame:
    """df with host, path, rule (null if none fits) and verdict; columns of df with these names are replaced.

    A missing URL, or one without ://, has an empty host and path, fits no rule and gets the default. The trie is
    broadcast; more than max_rules rules are an error, so its size is bounded (about 100 MB at the default bound).
    Repeated rules count once; an allow and a block entry of the same text leave allow. Very long URLs and repeated rows are
    treated like all others.
    """
    if len(rules) > max_rules:
        raise ValueError(f"{len(rules)} rules; the bound is {max_rules}")
    shared = df.sparkSession.sparkContext.broadcast(UrlTrie(rules, default))
    at = df.columns.index(url) if url in df.columns else None
    if at is None:
        raise ValueError(f"no column {url}")

    def start():
        trie = shared.value

        def work(batch: pa.RecordBatch) -> list:
            rows = []
            for text in batch.column(batch.schema.get_field_index("__url")).to_pylist():
                host, path = parts_of(text)
                rows.append((host, path, *trie.judge(host, path)))
            return list(map(list, zip(*rows))) if rows else [[], [], [], []]

        return work

    return annotate(df.withColumn("__url", df[f"`{url}`"]), FIELDS, start).drop("__url")
