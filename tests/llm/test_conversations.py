"""Repair of conversations against a plain search over all repairs."""

import collections
import hashlib
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkfen.llm import conversations as C
from sparkfen.session import table
from tests.llm.test_operators import DIR

CODE = st.sampled_from("xsuaoSUAO")


def plain(codes):
    """(cost, audit) by Dijkstra-like rounds over (turn, state), costs and least audits together."""
    best = {}
    n = len(codes)

    def settle(i):
        now = {}
        for q in range(4):
            options = [(0, "")] if i == n and q in (0, 3) else []
            if i < n:
                c, a = best[i + 1, q]
                options.append((c + 4, "D" + a))
                for w, to in C.GOES[q].items():
                    if codes[i] != "x" and (w != "s" or codes[i] in "sS"):
                        c, a = best[i + 1, to]
                        same = codes[i].lower() == w
                        options.append((c + (0 if same else 3) + (3 if codes[i].isupper() else 0), ("K" if same else "R") + a))
            now[q] = min(options, default=(10**9, ""))
        for _ in range(4):
            for q in range(4):
                for w, to in C.GOES[q].items():
                    if w != "s":
                        now[q] = min(now[q], (now[to][0] + 3, "I" + now[to][1]))
        for q in range(4):
            best[i, q] = now[q]

    for i in range(n, -1, -1):
        settle(i)
    return best[0, 0]


@given(st.lists(CODE, max_size=9).map("".join))
@settings(max_examples=600, deadline=None)
def test_alignment(codes):
    assert C.repair_of(codes) == plain(codes)
    cost, audit = C.repair_of(codes)
    sources, roles = C.sources_of(audit)
    text = "".join(r[0] if r else codes[s].lower() for s, r in zip(sources, roles))
    assert re.fullmatch("(s?(ua)+)?", text) and sum(c != "I" for c in audit) == len(codes)


@given(st.lists(st.lists(CODE, max_size=5).map("".join), min_size=1, max_size=5))
@settings(max_examples=300, deadline=None)
def test_segments(parts):
    """Costs behind the segments, states between them, and the audits joined."""
    import pandas as pd

    parts = [p for p in parts if p] or ["x"]
    back = C._back(pd.DataFrame({"conv": "c", "seg": range(len(parts)), "costs": [C.table_of(p) for p in parts]}))
    state, audit = 0, ""
    for p, after, last in zip(parts, back.after, back.is_last):
        import numpy as np

        state, a = C.walk(p, state, np.array(after), last)
        audit += a
    assert audit == plain("".join(parts))[1]


def expected(rows):
    """The whole query in plain Python; rows are (conv_id, turn, role, text)."""
    out, convs = {}, collections.defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        convs[conv] += []
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        convs[conv] += [(turn is not None, turn or 0, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    for conv, mine in convs.items():
        mine.sort()
        seen, codes, n = set(), "", collections.Counter()
        for _, _, role, text in mine:
            body = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
            seen.add((role, text))
            n[fault] += 1
            code = role[:1] if role[:1] in ("s", "u", "a") else "o"
            codes += "x" if fault in ("blank", "duplicate") else code.upper() if fault else code
        cost, audit = plain(codes)
        known = [t for there, t, _, _ in mine if there]
        initials = [r[:1] for _, _, r, _ in mine]
        at, state, fixed, odd = 0, 0, [], sum(c != "D" for c in audit) % 2
        for c in audit:
            if c != "D":
                want = "system" if odd and not state else ("user", "assistant")[(state - odd) % 2]
                fixed.append(f"{mine[at][2] if c == 'K' else want}:{'' if c == 'I' else mine[at][3]}")
                state += 1
            at += c != "I"
        out[conv] = (max(known) - min(known) + 1 - len(set(known)) if known else 0, n["blank"], n["duplicate"], n["truncated"], sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(fixed).encode()).hexdigest())
    return out


def got(df):
    rows = C.digest(df).collect()
    out = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows}
    assert len(out) == len(rows)
    return out


def test_table(spark):
    df = table(spark, DIR, "conversations")
    assert got(df) == expected([(r.conv_id, r.turn, r.role, r.text) for r in df.collect()])


ODD = [
    ("a", 0, "system", "Hi."), ("a", 1, "user", "Well?"), ("a", 1, "user", "Well?"), ("a", 5, None, None), ("b", None, "user", "x"), ("b", None, None, "y!"), ("c", 3, "", "empty role."), ("c", 4, "umbrella", "a  \n"), ("c", 9, "assistant", "é."),
    (None, 1, "assistant", "no id."), (None, None, None, None), ("d", 2, "user", "long. " * 200_000), ("e", 1, "tool", "t."), ("f", -4, "system", "late."), ("f", -7, "assistant", "?!"),
]


def rows_of(rng, conv, n):
    return [(conv, rng.choice([None, *range(n)]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", None]), rng.choice(["Yes.", "No", "", " ", f"say {rng.randrange(n)}.", f"ask {rng.randrange(n)}?", None])) for _ in range(n)]


@pytest.mark.parametrize("bound", [C.LONG_ROWS, 3, 0])
def test_odd_rows(spark, monkeypatch, bound):
    """Nulls, ties, repeated rows, unknown roles, clashing columns; the same by segments of long conversations."""
    rng = random.Random(bound)
    rows = ODD * 2 + [r for k in range(25) for r in rows_of(rng, f"r{k}", rng.randrange(1, 12))]
    df = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string").repartition(5).withColumn("there", F.lit("no")).withColumn("cost", F.lit(1))
    monkeypatch.setattr(C, "LONG_ROWS", bound)
    monkeypatch.setattr(C, "SEGMENT_ROWS", 3)
    assert got(df) == expected(rows)
    assert C.digest(df.filter("1=0")).count() == 0


def test_long_conversation(spark):
    """One conversation of a third of all rows, with numbers for ids; and the operator's own outputs."""
    rng = random.Random(9)
    rows = rows_of(rng, 7, 9000) + [r for k in range(100, 700) for r in rows_of(rng, k, rng.randrange(1, 50))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    want = expected(rows)
    assert got(df) == want
    pieces = C.repair(C.damage(df), there="there").filter("conv_id = 7").orderBy("seg").collect()
    assert len(pieces) > 1 and "".join(p.audit for p in pieces) == want[7][6] and sum(p.cost for p in pieces) == want[7][5]
    lines = [f"{t.role}:{t.text}" for p in pieces for t in p.repaired]
    assert hashlib.sha256("\n".join(lines).encode()).hexdigest() == want[7][7]
