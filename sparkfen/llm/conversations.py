"""Repair of the structure of conversations: alternating user and assistant turns, after a system turn at most.

A conversation's turns become a string of codes, and the string is aligned to each feasible target, "", "ua", "uaua", ... and
"sua", "suaua", ..., by Wagner and Fischer's table. The cheapest repair so far bounds how far from the diagonal a better one can
be (Ukkonen's band) and which lengths are worth a try; of equal costs the least audit wins, as backtraced from the tables.
Equal strings are aligned once a worker.

Conversations above LONG rows or bytes go another exact way, as the number of targets grows with their length: they are sorted
and cut in segments over all tasks, and a segment is a table of costs between the states of the grammar. The tables of
a conversation, a few numbers for some thousand turns, give the cost from each segment on and the state in which it begins.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkfen.session import remove, scratch_path

BLANKS = "\t\n\x0b\x0c\r "
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
NEVER = 1 << 60
#: Codes of turns: x must go; s, u, a and o (another role) may stay, in capitals at the price of a truncated text.
FREE, ROLES = "suaoSUAO", {"s": "system", "u": "user", "a": "assistant"}
LONG_ROWS, LONG_BYTES = 64, 8 << 20
SEGMENT_ROWS, SEGMENT_BYTES = 4096, 4 << 20


def fit(code: str, want: str) -> int:
    """The cost of making the turn one of the role `want`."""
    if code == "x" or want == "s" and code not in "sS":
        return NEVER
    return (0 if code.lower() == want else REROLE) + (TRUNCATED if code.isupper() else 0)


def align(codes: str, target: str, limit: int) -> tuple[int, str] | None:
    """(cost, least audit) of the cheapest alignment of turns to a target, if it costs `limit` at most."""
    n, m = len(codes), len(target)
    far = lambda d: INSERT * d if d > 0 else -DELETE * d
    band = [d for d in range(-n, m + 1) if far(d) + far(m - n - d) <= limit]
    if not band:
        return None
    low, high = band[0], band[-1]
    table: list[dict[int, int]] = [{} for _ in range(n + 1)]
    for i in range(n, -1, -1):
        here, below = table[i], table[i + 1] if i < n else {}
        for j in range(min(m, i + high), max(0, i + low) - 1, -1):
            if i == n and j == m:
                here[j] = 0
                continue
            best = NEVER
            if i < n:
                best = DELETE + below.get(j, NEVER)
                if j < m:
                    best = min(best, fit(codes[i], target[j]) + below.get(j + 1, NEVER))
            if j < m and target[j] != "s":
                best = min(best, INSERT + here.get(j + 1, NEVER))
            here[j] = best
    if table[0].get(0, NEVER) > limit:
        return None
    i = j = 0
    audit = []
    while i < n or j < m:
        left = table[i][j]
        if i < n and DELETE + table[i + 1].get(j, NEVER) == left:
            audit.append("D")
            i += 1
        elif j < m and target[j] != "s" and INSERT + table[i].get(j + 1, NEVER) == left:
            audit.append("I")
            j += 1
        else:
            audit.append("K" if codes[i].lower() == target[j] else "R")
            i, j = i + 1, j + 1
    return table[0][0], "".join(audit)


@lru_cache(maxsize=50_000)
def repair_of(codes: str) -> tuple[int, str]:
    """(cost, audit) of the cheapest repair, of equal ones the least audit."""
    n, gone = len(codes), codes.count("x")
    best = (DELETE * n, "D" * n)
    most = n + DELETE * n // INSERT + 2
    lengths = [m for m in range(2, most + 1) if m % 2 == 0 or m > 2 and ("s" in codes or "S" in codes)]
    least = lambda m: DELETE * max(gone, n - m) + INSERT * max(0, m - (n - gone))
    for m in sorted(lengths, key=lambda m: (least(m), m)):
        if least(m) > best[0]:
            break
        found = align(codes, "s" * (m % 2) + "ua" * (m // 2), best[0])
        if found and found < best:
            best = found
    return best


def sources_of(audit: str) -> tuple[list[int], list[str]]:
    """For each turn after the repair: the turn it comes from (-1: none) and its new role ("": as it was)."""
    odd = sum(c != "D" for c in audit) % 2
    at, place, sources, roles = 0, 0, [], []
    for c in audit:
        if c != "D":
            role = "s" if odd and place == 0 else "ua"[(place - odd) % 2]
            sources.append(-1 if c == "I" else at)
            roles.append("" if c == "K" else ROLES[role])
            place += 1
        at += c != "I"
    return sources, roles


# --- turns


def damage(df: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, there) of damaged conversations: by crc32 of conv_id:turn, a twentieth each is dropped (there
    is false), emptied, without sentence ends, repeated, or said by the user. Missing values count as one blank, but for turn."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn"))) % 20
    rows = df.select("conv_id", F.col("turn").cast("long").alias("turn"), word("role").alias("role"), word("text").alias("text"), kind.alias("__k"))
    text = F.when(F.col("__k") == 1, "").when(F.col("__k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("__k") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("__k") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("__k") != 0).alias("there"), copies.alias("__c")).drop("__c")


def turns(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", there: str | None = None) -> DataFrame:
    """The columns that repair() works on; missing roles and texts are one blank."""
    word = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    return df.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"), word(role).alias("role"), word(text).alias("text"), (F.col(f"`{there}`") if there else F.lit(True)).alias("there"))


def code_of(role: Column, text: Column, repeated: Column) -> Column:
    """The code of a turn; b and d for blank and repeated ones, which are x in an alignment."""
    said = F.rtrim(text, F.lit(BLANKS))
    first = F.substring(role, 1, 1)
    free = F.when(first.isin("s", "u", "a"), first).otherwise("o")
    ended = F.substring(said, -1, 1).isin(".", "!", "?")
    return F.when(said == "", "b").when(repeated, "d").when(ended, free).otherwise(F.upper(free))


TURN = T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])


def count_of(codes: Column, letters: str) -> Column:
    """How many of the letters a string has."""
    return (F.length(codes) - F.length(F.translate(codes, letters, ""))).cast("long")


def _struct(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, k) for n, k in kinds.items()])


TEXTS, NUMBERS = T.ArrayType(T.StringType()), T.ArrayType(T.IntegerType())


@F.pandas_udf(_struct(cost=T.LongType(), audit=T.StringType(), sources=NUMBERS, roles=TEXTS))
def _repairs(codes: pd.Series) -> pd.DataFrame:
    found = [repair_of(c.replace("b", "x").replace("d", "x")) for c in codes]
    made = [sources_of(audit) for _, audit in found]
    return pd.DataFrame({"cost": [c for c, _ in found], "audit": [a for _, a in found], "sources": [s for s, _ in made], "roles": [r for _, r in made]})


def _short(rows: DataFrame) -> DataFrame:
    """Conversations of LONG_ROWS turns at most, each in one row."""
    grouped = rows.groupBy("conv").agg(F.sort_array(F.collect_list(F.when(F.col("there"), F.struct("turn", "role", "text")))).alias("t"))
    said = grouped.withColumn("said", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))))
    coded = F.transform("t", lambda x, i: code_of(x["role"], x["text"], F.array_position("said", F.element_at("said", i + 1)) <= i))
    known = F.filter(F.transform("t", lambda x: x["turn"]), lambda x: x.isNotNull())
    first = lambda x: F.substring(x["role"], 1, 1)
    pairs = F.zip_with(F.slice("said", 1, F.greatest(F.size("said") - 1, F.lit(0))), F.slice("said", 2, F.greatest(F.size("said") - 1, F.lit(0))), lambda x, y: F.concat(first(x), first(y)))
    row = said.select(
        "conv", "said", F.array_join(coded, "").alias("codes"), F.size(F.filter(pairs, lambda p: ~p.isin("su", "ua", "au"))).cast("long").alias("illegal"),
        F.coalesce(F.array_max(known) - F.array_min(known) + 1 - F.size(F.array_distinct(known)), F.lit(0)).cast("long").alias("gaps"),
    ).withColumn("r", _repairs("codes"))
    text = lambda i: F.when(i >= 0, F.element_at("said", i + 1)["text"]).otherwise("")
    fixed = F.zip_with("r.sources", "r.roles", lambda i, new: F.struct(F.when(new == "", F.element_at("said", F.greatest(i, F.lit(0)) + 1)["role"]).otherwise(new).alias("role"), text(i).alias("text")))
    return row.select("conv", F.lit(0).cast("long").alias("seg"), "gaps", count_of(F.col("codes"), "b").alias("blank"), count_of(F.col("codes"), "d").alias("duplicate"), count_of(F.col("codes"), "SUAO").alias("truncated"), "illegal", "r.cost", "r.audit", fixed.alias("repaired"))


# --- long conversations: states 0 (nothing yet), 1 (after s), 2 (after u), 3 (after a)

GOES = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
ENDS = np.array([0, 2 * INSERT, INSERT, 0], np.int64)


def steps_back(codes: str, after: np.ndarray) -> np.ndarray:
    """The least cost of all that follows, before each turn and in each state; `after` is that behind the last turn."""
    prices = {c: [(q, to, fit(c, w)) for q, go in GOES.items() for w, to in go.items() if fit(c, w) < NEVER] for c in "x" + FREE}
    out, now = np.empty((len(codes) + 1, 4), np.int64), after.tolist()
    out[-1] = now
    for i in range(len(codes) - 1, -1, -1):
        new = [x + DELETE for x in now]
        for q, to, price in prices[codes[i]]:
            new[q] = min(new[q], price + now[to])
        now = inserted(new)
        out[i] = now
    return out


def inserted(now: list[int]) -> list[int]:
    """The costs if turns may be inserted first; more than one round through the states never pays."""
    u, a = min(now[2], INSERT + now[3]), min(now[3], INSERT + now[2])
    return [min(now[0], INSERT + u), min(now[1], INSERT + u), u, a]


def table_of(codes: str) -> list[int]:
    """The least cost between states over a stretch of turns, row by row; turns inserted behind it are the next one's."""
    return [int(x) for end in range(4) for x in np.minimum(steps_back(codes, np.where(np.arange(4) == end, 0, NEVER))[0], NEVER)]


def walk(codes: str, state: int, after: np.ndarray, last: bool) -> tuple[int, str]:
    """(state behind it, least audit) of the cheapest way through a stretch; the last one goes on to the end."""
    left, audit, i, n = steps_back(codes, after), [], 0, len(codes)
    if last:
        left[n] = ENDS
    while i < n or last and left[n][state]:
        now = left[i][state]
        if i < n and DELETE + left[i + 1][state] == now:
            audit.append("D")
            i += 1
            continue
        step = next(((w, to) for w, to in GOES[state].items() if w != "s" and INSERT + left[i][to] == now), None)
        if step:
            audit.append("I")
            state = step[1]
            continue
        w, state = min((("K" if codes[i].lower() == w else "R", to) for w, to in GOES[state].items() if fit(codes[i], w) + left[i + 1][to] == now))
        audit.append(w)
        i += 1
    return state, "".join(audit)


def replay(audit: str, state: int, roles: list[str], texts: list[str]) -> list[dict]:
    """The turns after the edits of a stretch that begins in a state."""
    at, out = 0, []
    for c in audit:
        if c in "KR" or c == "I":
            want = "s" if c == "K" and state == 0 and roles[at][:1] == "s" else "a" if state == 2 else "u"
            out.append({"role": roles[at] if c == "K" else ROLES[want], "text": "" if c == "I" else texts[at]})
            state = GOES[state][want]
        at += c != "I"
    return out


SEGMENT = T.StructType([
    T.StructField("conv", T.StringType()), T.StructField("seg", T.LongType()), T.StructField("codes", T.StringType()), T.StructField("roles", T.ArrayType(T.StringType())), T.StructField("texts", T.ArrayType(T.StringType())),
    T.StructField("costs", T.ArrayType(T.LongType())), T.StructField("first", T.StringType()), T.StructField("last", T.StringType()), T.StructField("illegal", T.LongType()),
    T.StructField("low", T.LongType()), T.StructField("high", T.LongType()), T.StructField("turns", T.LongType()),
])


def _segments(rows: DataFrame) -> DataFrame:
    """The turns of long conversations in order, in segments of SEGMENT_ROWS turns or SEGMENT_BYTES; no conversation is in one task."""
    spark, all_of = rows.sparkSession, ["conv", "turn", "role", "text"]
    once = rows.filter("there").groupBy(*all_of).agg(F.count("*").alias("n"))
    first = once.groupBy("conv", "role", "text").agg(F.min(F.struct(F.col("turn").isNotNull().alias("k"), "turn")).alias("m")).select(*[F.col(c).alias(f"f_{c}") for c in ("conv", "role", "text")], F.col("m.turn").alias("f_turn"))
    same = [F.col(c).eqNullSafe(F.col(f"f_{c}")) for c in all_of]
    marked = once.join(first, same, "left").withColumn("new", F.col("f_role").isNotNull())
    coded = marked.select(*all_of, "n", code_of(F.col("role"), F.col("text"), ~F.col("new")).alias("code"))
    order = [F.asc_nulls_first(c) for c in all_of]
    placed = coded.repartitionByRange(*order).sortWithinPartitions(*order).select(*all_of, "n", "code", F.monotonically_increasing_id().alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, seg, codes, said, seen, size = None, None, [], [], [], 0

        def made() -> pa.RecordBatch:
            text, initials = "".join(codes), [r[:1] for r, _ in said]
            bad = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
            known = [t for t in seen if t is not None]
            row = (conv, seg, text, [r for r, _ in said], [t for _, t in said], table_of(text.replace("b", "x").replace("d", "x")), initials[0], initials[-1], bad, min(known, default=None), max(known, default=None), len(set(known)))
            return pa.RecordBatch.from_pylist([dict(zip(SEGMENT.names, row))], SEGMENT_ARROW)

        for batch in batches:
            for r in batch.to_pylist():
                for copy in range(r["n"]):
                    if codes and (r["conv"] != conv or len(codes) >= SEGMENT_ROWS or size >= SEGMENT_BYTES):
                        yield made()
                        codes, said, seen, size = [], [], [], 0
                    if not codes:
                        conv, seg = r["conv"], (r["at"] << 24) + copy // SEGMENT_ROWS
                    codes.append(r["code"] if copy == 0 or r["code"] == "b" else "d")
                    said.append((r["role"], r["text"]))
                    seen.append(r["turn"])
                    size += len(r["text"])
        if codes:
            yield made()

    path = scratch_path(spark, "segments")
    placed.mapInArrow(run, SEGMENT).write.parquet(path)
    return spark.read.schema(SEGMENT).parquet(path)


SEGMENT_ARROW = pa.schema([(f.name, pa.list_(pa.string()) if f.name in ("roles", "texts") else pa.list_(pa.int64()) if f.name == "costs" else pa.string() if isinstance(f.dataType, T.StringType) else pa.int64()) for f in SEGMENT.fields])


def _back(group: pd.DataFrame) -> pd.DataFrame:
    """The costs behind each segment of a conversation."""
    group = group.sort_values("seg").reset_index(drop=True)
    after, out = ENDS, [None] * len(group)
    for k in range(len(group) - 1, -1, -1):
        out[k] = after.tolist()
        costs = np.array(group.costs[k], np.int64).reshape(4, 4)
        after = np.array(inserted([int(min(min(costs[e][q], NEVER) + after[e] for e in range(4))) for q in range(4)]), np.int64)
    return pd.DataFrame({"conv": group.conv, "seg": group.seg, "after": out, "is_last": [False] * (len(group) - 1) + [True]})


def _ahead(group: pd.DataFrame) -> pd.DataFrame:
    """The state in which each segment begins, and what holds for the whole conversation, on its first segment."""
    group = group.sort_values("seg").reset_index(drop=True)
    state, states = 0, []
    for exits in group.exits:
        states.append(state)
        state = int(exits[state])
    bad = int(group.illegal.sum()) + sum(a + b not in ("su", "ua", "au") for a, b in zip(group["last"], group["first"][1:]))
    known = group.dropna(subset=["low"])
    joined = sum(a == b for a, b in zip(known.high, known.low[1:]))
    gaps = int(known.high.max() - known.low.min() + 1 - (known.turns.sum() - joined)) if len(known) else 0
    zeros = [0] * (len(group) - 1)
    return pd.DataFrame({"conv": group.conv, "seg": group.seg, "state": states, "illegal": [bad, *zeros], "gaps": [gaps, *zeros]})


@F.pandas_udf(_struct(exits=NUMBERS, audits=TEXTS))
def _walks(codes: pd.Series, after: pd.Series, last: pd.Series) -> pd.DataFrame:
    found = [[walk(c.replace("b", "x").replace("d", "x"), q, np.array(a, np.int64), bool(z)) for q in range(4)] for c, a, z in zip(codes, after, last)]
    return pd.DataFrame({"exits": [[q for q, _ in f] for f in found], "audits": [[a for _, a in f] for f in found]})


@F.pandas_udf(T.ArrayType(TURN))
def _replays(audit: pd.Series, state: pd.Series, roles: pd.Series, texts: pd.Series) -> pd.Series:
    return pd.Series([replay(a, int(q), list(r), list(t)) for a, q, r, t in zip(audit, state, roles, texts)])


def cost_of(audit: Column, paid: Column) -> Column:
    """The cost of an audit and of the truncated turns that stay."""
    return count_of(audit, "D") * DELETE + count_of(audit, "I") * INSERT + count_of(audit, "R") * REROLE + paid * TRUNCATED


@F.pandas_udf(T.LongType())
def _paid(codes: pd.Series, audit: pd.Series) -> pd.Series:
    return pd.Series([sum(c.isupper() and e != "D" for c, e in zip(codes, [e for e in a if e != "I"])) for codes, a in zip(codes, audit)], dtype="int64")


def _long(rows: DataFrame) -> DataFrame:
    """Long conversations: a row for each segment, whose counts, costs and strings add up to the conversation's."""
    spark = rows.sparkSession
    segments = _segments(rows.withColumn("conv", F.to_json(F.struct("conv"))))
    behind = segments.select("conv", "seg", "costs").groupBy("conv").applyInPandas(_back, "conv string, seg long, after array<long>, is_last boolean")
    walked = segments.join(behind, ["conv", "seg"]).withColumn("w", _walks("codes", "after", "is_last")).select(*SEGMENT.names, "w.exits", "w.audits")
    path = scratch_path(spark, "walked")
    walked.write.parquet(path)
    walked = spark.read.parquet(path)
    ahead = walked.select("conv", "seg", "exits", "illegal", "first", "last", "low", "high", "turns").groupBy("conv").applyInPandas(_ahead, "conv string, seg long, state int, illegal long, gaps long")
    done = walked.drop("illegal").join(ahead, ["conv", "seg"]).withColumn("audit", F.element_at("audits", F.col("state") + 1))
    kind = rows.schema["conv"].dataType
    return done.select(
        F.from_json("conv", T.StructType([T.StructField("conv", kind)]))["conv"].alias("conv"), "seg", "gaps", count_of(F.col("codes"), "b").alias("blank"), count_of(F.col("codes"), "d").alias("duplicate"), count_of(F.col("codes"), "SUAO").alias("truncated"),
        "illegal", cost_of(F.col("audit"), _paid("codes", "audit")).alias("cost"), "audit", _replays("audit", "state", "roles", "texts").alias("repaired"),
    )


def repair_pieces(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """What repair() returns, of usual conversations (a row each) and of long ones (a row a segment), if there are any."""
    spark = rows.sparkSession
    sizes = rows.filter("there").groupBy("conv").agg(F.count("*").alias("n"), F.sum(F.octet_length("text") + F.octet_length("role")).alias("b"))
    path = scratch_path(spark, "long")
    sizes.filter((F.col("n") > LONG_ROWS) | (F.col("b") > LONG_BYTES)).select(F.col("conv").alias("long_conv")).write.parquet(path)
    long = spark.read.parquet(path)
    if long.isEmpty():
        remove(spark, path)
        return _short(rows), None
    same = F.col("conv").eqNullSafe(F.col("long_conv"))
    return _short(rows.join(long, same, "left_anti")), _long(rows.join(long, same, "left_semi"))


def repair(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", there: str | None = None) -> DataFrame:
    """(conv, seg, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired) of each conversation.

    Turns are taken in the order of `turn`, missing ones first, then of role and text; missing roles and texts are one
    blank, a missing conversation id is a conversation. Rows with a false `there` only name a conversation. An
    empty table has no rows, repeated rows are duplicates, other columns are not looked at. A conversation is one row (seg 0),
    a long one a row for each segment: its numbers are to be added up, its strings and turns joined in the order of seg.
    A group is gathered only up to LONG_ROWS turns and LONG_BYTES; texts never leave Spark but for long ones.
    """
    short, long = repair_pieces(turns(df, conv, turn, role, text, there))
    made = short if long is None else short.unionByName(long)
    return made.withColumnRenamed("conv", conv) if conv != "conv" else made


def digest(df: DataFrame) -> DataFrame:
    """The columns of the query over damaged conversations."""
    rows = turns(damage(df), there="there")
    short, long = repair_pieces(rows)
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    line = lambda x: F.concat(x["role"], F.lit(":"), x["text"])
    out = short.select(F.col("conv").alias("conv_id"), *numbers, "audit", F.sha2(F.array_join(F.transform("repaired", line), "\n"), 256).alias("repaired_sha256"))
    if long is None:
        return out
    schema = T.StructType([rows.select(F.col("conv").alias("conv_id")).schema["conv_id"], *(T.StructField(n, T.LongType()) for n in numbers), T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])
    lines = long.withColumn("line", F.array_join(F.transform("repaired", line), "\n")).withColumn("some", F.size("repaired") > 0).drop("repaired")
    streamed = lines.repartition("conv").sortWithinPartitions("conv", "seg")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One conversation's segments follow each other; their lines are hashed as they come."""
        at = sums = audit = sha = None
        begun = False
        names = schema.names

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v]) if k else pa.array([v], kind) for k, v in enumerate((at[0], *sums, "".join(audit), sha.hexdigest()))], names=names)

        kind = None
        for batch in batches:
            kind = batch.schema.field("conv").type
            for r in batch.to_pylist():
                if at != (r["conv"],):
                    if at:
                        yield made()
                    at, sums, audit, sha, begun = (r["conv"],), [0] * len(numbers), [], hashlib.sha256(), False
                sums = [a + r[n] for a, n in zip(sums, numbers)]
                audit.append(r["audit"])
                if r["some"]:
                    sha.update((b"\n" if begun else b"") + r["line"].encode())
                    begun = True
        if at:
            yield made()

    return out.unionByName(streamed.mapInArrow(run, schema))
