"""Quality rules as a bitmask ledger, in DataFrame operations only.

Every rule is evaluated once for each document. The ledger holds the measurements and a long with one bit for each rule
that failed. A policy is a versioned set of rules: applying it is one bitwise AND, and an ablation counts the distinct
bit patterns (one shuffle of a few rows a task) and works on those counts alone.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfen.llm.common import bind, spaced

#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """bit: its place in the ledger, never reused; failed: SQL over the measurements."""

    bit: int
    name: str
    failed: str


@dataclass(frozen=True)
class Policy:
    """A version and the names of the rules that reject a document."""

    version: str
    rules: tuple[str, ...]


#: The last four are lenient: running prose stays far from their bounds.
RULES = (
    Rule(0, "few_words", "n_words < 10"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > 5 * n_words"),
    Rule(3, "repeated_lines", "10 * n_dup_lines > 5 * n_lines"),
    Rule(4, "shouting", "10 * n_marks > 5 * n_words"),
    Rule(5, "word_length", "word_chars < 2 * n_words or word_chars > 20 * n_words"),
)
BASE = Policy("base", ("few_words", "repeated_windows"))
POLICY = Policy("2025-1", tuple(r.name for r in RULES))


def _count(text: Column, chars: str) -> Column:
    left = text
    for c in chars:
        left = F.replace(left, F.lit(c), F.lit(""))
    return (F.length(text) - F.length(left)).cast("long")


def _covered(hashes: Column) -> Column:
    """Words inside windows that occur twice or more, from the windows' hashes in order."""

    def spread(pos: Column) -> Column:
        gaps = F.transform(pos, lambda x, i: F.least(F.coalesce(F.get(pos, i + 1) - x, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    def repeated(z: Column) -> Column:
        same = lambda x, i: F.coalesce(F.get(z, i)["h"] == x["h"], F.lit(False))
        twice = F.filter(z, lambda x, i: same(x, i + 1) | F.when(i > 0, same(x, i - 1)).otherwise(False))
        return bind(F.sort_array(F.transform(twice, lambda x: x["p"])), spread)

    placed = lambda h: F.sort_array(F.arrays_zip(h.alias("h"), F.sequence(F.lit(0), F.size(h) - 1).alias("p")))
    named = lambda h: placed(h).cast("array<struct<h:bigint,p:int>>")
    return bind(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(bind(named(h), repeated)))


def _repeat_words(words: Column) -> Column:
    n = F.size(words) - (WINDOW - 1)
    windows = F.arrays_zip(*[F.slice(words, k + 1, n) for k in range(WINDOW)])
    return F.when(n > 1, _covered(F.transform(windows, lambda x: F.xxhash64(x)))).otherwise(0).cast("long")


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the measurements n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words and n_marks (long).

    A missing or empty text measures 0 everywhere. Nothing is shuffled and whole texts are read. Columns of df with
    these names are replaced. n_lines counts the lines that have a word.
    """
    out = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_marks")
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))

    def of_words(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).alias("n_repeat_words"))

    def of_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))

    def of_flat(flat: Column) -> Column:
        return F.struct(
            F.length(F.replace(flat, F.lit(" "), F.lit(""))).cast("long").alias("word_chars"),
            bind(F.array_remove(F.split(flat, " "), ""), of_words).alias("w"),
        )

    lines = F.filter(F.split(whole, "\n"), lambda x: F.length(F.trim(spaced(x))) > 0)
    made = df.withColumns({"__flat": bind(spaced(whole), of_flat), "__lines": bind(lines, of_lines)})
    return made.withColumns({
        "n_words": F.col("__flat.w.n_words"), "word_chars": F.col("__flat.word_chars"), "n_symbols": _count(whole, SYMBOLS),
        "n_lines": F.col("__lines.n_lines"), "n_dup_lines": F.col("__lines.n_dup_lines"), "n_repeat_words": F.col("__flat.w.n_repeat_words"), "n_marks": _count(whole, "!"),
    }).select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in out], *out)


def ledger(df: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """measure(df) with fail_bits (long): bit b is set if the rule of that bit failed. Rules see no missing value."""
    if len({r.bit for r in rules}) < len(rules) or any(not 0 <= r.bit < 63 for r in rules):
        raise ValueError("each rule needs a bit of its own from 0 to 62")
    bits = F.lit(0).cast("long")
    for r in rules:
        bits = bits + F.when(F.expr(r.failed), F.lit(1 << r.bit).cast("long")).otherwise(F.lit(0).cast("long"))
    return measure(df, text).withColumn("fail_bits", bits)


def mask_of(policy: Policy, rules: Sequence[Rule] = RULES) -> int:
    """The bits of a policy's rules; an unknown name is an error."""
    by = {r.name: 1 << r.bit for r in rules}
    return sum(by[name] for name in set(policy.rules))


def passes(policy: Policy, rules: Sequence[Rule] = RULES) -> Column:
    """Whether a ledger row passes the policy."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask_of(policy, rules)).cast("long")) == 0


def ablation(led: DataFrame, policy: Policy = POLICY, rules: Sequence[Rule] = RULES) -> DataFrame:
    """For each rule of a policy: n_failed, n_only (documents it alone rejects, which dropping it would regain) and n_docs.

    The ledger is reduced to counts of bit patterns first; a rule without failures has a row of zeros. An empty ledger
    gives n_docs 0.
    """
    spark, mask = led.sparkSession, mask_of(policy, rules)
    hit = led.select(F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")).alias("bits")).groupBy("bits").agg(F.count("*").alias("n"))
    named = spark.createDataFrame([(r.name, 1 << r.bit) for r in rules if r.name in policy.rules], "rule string, bit long")
    sums = []
    for r in (r for r in rules if r.name in policy.rules):
        bit = F.lit(1 << r.bit).cast("long")
        sums += [F.sum(F.when(F.col("bits").bitwiseAND(bit) != 0, F.col("n"))).alias(f"f{r.bit}"), F.sum(F.when(F.col("bits") == bit, F.col("n"))).alias(f"o{r.bit}")]
    row = hit.agg(*sums, F.sum("n").alias("n_docs"))
    cells = F.array(*[F.struct(F.lit(1 << r.bit).cast("long").alias("bit"), F.col(f"f{r.bit}").alias("f"), F.col(f"o{r.bit}").alias("o")) for r in rules if r.name in policy.rules])
    flat = row.select(F.explode(cells).alias("x"), "n_docs").select("x.bit", "x.f", "x.o", "n_docs")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return named.join(flat, "bit").select("rule", zero("f").alias("n_failed"), zero("o").alias("n_only"), zero("n_docs").alias("n_docs"))


def digest(docs: DataFrame) -> DataFrame:
    """The columns of the query over documents."""
    return ledger(docs.select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~passes(BASE)).alias("base_failed"), passes(POLICY).alias("kept"), "fail_bits",
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that the policy keeps, with their own columns."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col("text"))
    return ledger(rows).filter(passes(POLICY)).select("__row.*")
