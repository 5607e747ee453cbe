"""Near duplicates by an inverted join over MinHash signature coordinates.

1. One Python pass makes each document's shingle set; only its size, a 128-bit key and the signature leave the worker.
   Equal sets have equal keys and are one class from there on, so copies cost one row each. Sets with equal keys are not
   compared, so unlike ones would be taken for equal with a probability of about n * n / 2**129 among n sets.
2. Every class is posted under each (coordinate, value) of its signature. Postings that only one class has are dropped.
3. Two classes with at least `least` of the coordinates in common share one of the `coords - least + 1` rarest postings
   of either (prefix). Only those lists are merged; the longer lists are skipped, and a candidate's total of collisions
   is counted on the two signatures.
   Each posting carries the low four bits of every coordinate, so the join itself counts: equal coordinates have equal
   bits, and the count is never below the true one.
4. Lists are merged in rounds that never pair up a group: each class is joined to one head of the list, and the best
   pair of each class is confirmed on whole sets. What is then in one component is not compared again. Further rounds
   join classes outside a list's largest component to a random member of it; the last round compares what is left across
   components, so that no component is missed: in short lists by pairs, in long ones as a query set against blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkfen.llm.common import annotate, held
from sparkfen.operators.graph import connected_components
from sparkfen.session import cut

COORDS = 64
#: Of 64 coordinates, a pair at similarity 0.8 has 51 in common on average; fewer than 36 happens in about 4 of a million pairs.
LEAST = 36
NIBBLES = 16
BLOCK = 1 << 15
#: Rounds with random heads before the last one.
ROUNDS = 2
#: Lists with more classes than this are compared in blocks of BLOCKED classes in the last round, not by pairs.
LONG = 32
BLOCKED = 1_000


class _Hashes(dict):
    """word -> 64-bit hash, kept for short words up to a bound."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < 300_000 and len(word) <= 32:
            self[word] = h
        return h


def shingles_of(data: bytes | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles of `size` words; fewer words are one shingle, no words none."""
    hashes = held("words", None, _Hashes)
    words = data.lower().split() if data else []
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    width = min(size, n)
    s = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        s = (s ^ h[k : n - width + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        s ^= s >> np.uint64(29)
    s *= np.uint64(0xBF58476D1CE4E5B9)
    s ^= s >> np.uint64(32)
    return np.unique(s)


def key_of(s: np.ndarray) -> bytes:
    """Equal for equal sets."""
    return xxhash.xxh3_128_digest(s.tobytes())


def _constants(coords: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_501)
    return rng.integers(0, 1 << 63, coords, np.uint64)[:, None], (rng.integers(0, 1 << 62, coords, np.uint64) * np.uint64(2) + np.uint64(1))[:, None]


def signature(s: np.ndarray, flips: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """The least 32-bit value of each coordinate."""
    out = np.full(len(flips), 0xFFFFFFFF, np.uint64)
    step = max(1, BLOCK // len(flips))
    for i in range(0, len(s), step):
        out = np.minimum(out, (((s[None, i : i + step] ^ flips) * odds) >> np.uint64(32)).min(axis=1))
    return out.astype(np.uint32).view(np.int32)


def low_bits(sig: np.ndarray) -> np.ndarray:
    """The low four bits of each coordinate, 16 to a long."""
    parts = (sig.view(np.uint32).astype(np.uint64) & np.uint64(15)).reshape(-1, NIBBLES)
    return np.bitwise_or.reduce(parts << (np.arange(NIBBLES, dtype=np.uint64) * np.uint64(4)), axis=1).view(np.int64)


SET_FIELDS = [T.StructField("n_shingles", T.LongType()), T.StructField("set_key", T.BinaryType()), T.StructField("sig", T.ArrayType(T.IntegerType())), T.StructField("bits", T.ArrayType(T.LongType()))]


def sketch(df: DataFrame, text: str, size: int, coords: int = COORDS) -> DataFrame:
    """df with n_shingles, set_key, sig and bits; all but n_shingles (0) are null for a text without words."""

    def start():
        flips, odds = _constants(coords)

        def work(batch: pa.RecordBatch) -> list:
            out = [[], [], [], []]
            for cell in batch.column(batch.schema.get_field_index(text)).cast(pa.binary()):
                s = shingles_of(cell.as_py(), size)
                out[0].append(len(s))
                out[1].append(key_of(s) if len(s) else None)
                made = signature(s, flips, odds) if len(s) else None
                out[2].append(made)
                out[3].append(None if made is None else low_bits(made))
            return out

        return work

    return annotate(df, SET_FIELDS, start)


def _common(a: str, b: str, coords: int) -> Column:
    """Coordinates whose low bits are equal in two postings."""
    ones = F.lit(0x1111111111111111).cast("long")
    differing = F.lit(0)
    for k in range(coords // NIBBLES):
        z = F.col(f"{a}.bits")[k].bitwiseXOR(F.col(f"{b}.bits")[k])
        z = z.bitwiseOR(F.shiftrightunsigned(z, 1))
        z = z.bitwiseOR(F.shiftrightunsigned(z, 2))
        differing = differing + F.bit_count(z.bitwiseAND(ones))
    return F.lit(coords) - differing


def _alike(a: str, b: str, num: int, den: int, coords: int, least: int) -> Column:
    """Whether two postings agree in enough coordinates and have sizes that allow the similarity."""
    return (den * F.least(f"{a}.n", f"{b}.n") >= num * F.greatest(f"{a}.n", f"{b}.n")) & (_common(a, b, coords) >= least)


def _pairs(x: DataFrame, y: DataFrame, more: Column, limits: tuple) -> DataFrame:
    """(a, b, n_same), a < b, once each, of the postings x and y of a token that are alike and fulfil `more`."""
    num, den, coords, least = limits
    both = x.alias("x").join(y.alias("y"), (F.col("x.token") == F.col("y.token")) & more & _alike("x", "y", num, den, coords, least))
    return both.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b"), _common("x", "y", coords).alias("n_same")).distinct()


def _best(pairs: DataFrame) -> DataFrame:
    """The pair with most common coordinates of each class."""
    ends = pairs.select(F.col("a").alias("rep"), "a", "b", "n_same").union(pairs.select(F.col("b").alias("rep"), "a", "b", "n_same"))
    return ends.groupBy("rep").agg(F.max(F.struct("n_same", -F.col("a"), -F.col("b"))).alias("m")).select((-F.col("m.col2")).alias("a"), (-F.col("m.col3")).alias("b")).distinct()


def _confirmed(pairs: DataFrame, texts: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """Of the pairs (a, b), those whose whole sets are similar. texts: (rep, packed)."""
    ends = pairs.select("a", "b", F.explode(F.array(F.col("a"), F.col("b"))).alias("rep"))
    placed = ends.join(texts, "rep").select("a", "b", F.when(F.col("rep") == F.col("a"), F.col("packed")).alias("ta"), F.when(F.col("rep") == F.col("b"), F.col("packed")).alias("tb"))
    whole = placed.groupBy("a", "b").agg(F.max("ta").alias("ta"), F.max("tb").alias("tb"))

    def start():
        unpack = zstandard.ZstdDecompressor().decompress

        def work(batch: pa.RecordBatch) -> list:
            out = []
            for x, y in zip(batch.column(2), batch.column(3)):
                s, t = shingles_of(unpack(x.as_py()), size), shingles_of(unpack(y.as_py()), size)
                both = len(s) + len(t) - len(np.union1d(s, t))
                out.append(den * both >= num * (len(s) + len(t) - both))
            return [out]

        return work

    return annotate(whole, [T.StructField("linked", T.BooleanType())], start).filter("linked").select("a", "b")


def near_duplicates(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text", coords: int = COORDS, least: int = LEAST) -> DataFrame:
    """(key, n_shingles, component_id, kept): a row for each row of docs.

    Two texts are linked if den * |A and B| >= num * |A or B| for their sets of shingles of `size` lower-cased words.
    component_id is the smallest key reachable over links, kept whether it is the row's own. A missing text, or one
    without words, has no shingles and is linked with nothing. A row without a key takes part, is never kept here, and
    has a null component_id if no row with a key is reachable. Repeated rows share a component and are all kept if their key
    is the smallest. Rows that share a key but not a text are texts of their own, which may be in different components.
    Two classes are found with the probability of `least` common coordinates of `coords` (see LEAST); what is found is
    decided on whole sets. Columns of docs besides key and text are not looked at.
    """
    out = _components(docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text")), size, num, den, coords, least)
    component = F.when(F.col("comp").isNull(), F.col("id")).otherwise(F.col("least_id"))
    out = out.select("id", "n_shingles", component.alias("component_id"))
    return out.select(F.col("id").alias(key), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _components(rows: DataFrame, size: int, num: int, den: int, coords: int = COORDS, least: int = LEAST) -> DataFrame:
    """(id, th, n_shingles, comp, least_id) of rows (id, text): a number of the row's component (null without words) and its smallest id.

    th is a hash of the text. Inside, a class of equal sets goes by a row number of one of its rows, `rep`.
    """
    rows = rows.withColumn("th", F.xxhash64("text"))
    sets = cut(sketch(rows.withColumn("rid", F.monotonically_increasing_id()), "text", size, coords).drop("text"))
    limits = (num, den, coords, least)
    one = F.min(F.struct(F.col("id").isNull(), "id", "th"))
    classes = sets.filter("set_key is not null").groupBy("set_key").agg(F.min("rid").alias("rep"), F.min("id").alias("class_id"), one.alias("src"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.first("bits").alias("bits"))
    classes = cut(classes.select("set_key", "rep", "class_id", F.col("src.id").alias("src_id"), F.col("src.th").alias("src_th"), "n", "sig", "bits"))
    smallest = -(-num // max(1, den - num))  # fewer shingles are linked with an equal set only
    reps = classes.filter(F.col("n") >= smallest)
    postings = reps.select("rep", F.posexplode("sig").alias("k", "v")).select("rep", (F.shiftleft(F.col("k").cast("long"), 32) + F.col("v").cast("long").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))).alias("token"))
    lists = postings.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    own = postings.join(lists, "token").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("t"))
    own = own.filter(F.size("t") >= least).join(reps.select("rep", "n", "bits"), "rep")
    prefix = own.select("rep", "n", "bits", F.explode(F.slice("t", F.lit(1), F.size("t") - least + 1)).alias("x"))
    posts = cut(prefix.select("rep", "n", "bits", F.col("x.token").alias("token")))

    heads = posts.groupBy("token").agg(F.min(F.struct("rep", "n", "bits")).alias("h"), F.count("*").alias("m")).filter("m > 1").select("token", "h.*")
    first = cut(_best(_pairs(posts, heads, F.col("x.rep") > F.col("y.rep"), limits)))
    crowded = posts.groupBy("token").agg(F.count("*").alias("m")).filter("m > 2").select("token")
    wanted = first.select(F.explode(F.array("a", "b")).alias("rep")).union(posts.join(crowded, "token", "left_semi").select("rep")).distinct()
    texts = _texts(rows, wanted.join(reps.select("rep", "set_key", "src_id", "src_th"), "rep"), size)
    edges, tried = cut(_confirmed(first, texts, size, num, den)), first
    left = posts
    for turn in range(ROUNDS + 1):
        stars = connected_components(edges, "a", "b").withColumnRenamed("node", "rep")
        # A list that is in one component stays in one, so each round starts from the lists that the last one left.
        placed = cut(left.drop("comp").join(stars, "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component"))
        mixed = placed.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("token")
        left = cut(placed.join(mixed, "token", "left_semi"))
        edges = stars.filter("rep <> component").select(F.col("rep").alias("a"), F.col("component").alias("b"))
        if turn < ROUNDS:
            dice = F.min(F.struct(F.xxhash64("rep", "token", F.lit(turn)).alias("u"), "rep", "n", "bits")).alias("h")
            chosen = left.groupBy("token", "comp").agg(F.count("*").alias("m"), dice).groupBy("token").agg(F.max_by(F.struct("h.rep", "h.n", "h.bits", "comp"), F.struct("m", -F.col("comp"))).alias("c"))
            heads = chosen.select("token", "c.*")
            more = _best(_pairs(left, heads, F.col("x.comp") != F.col("y.comp"), limits).join(tried, ["a", "b"], "left_anti"))
        else:
            edges = cut(edges.union(_blocks(left, texts, size, num, den)))
            left = left.join(left.groupBy("token").agg(F.count("*").alias("m")).filter(F.col("m") <= LONG).select("token"), "token", "left_semi")
            more = _pairs(left, left, (F.col("x.rep") < F.col("y.rep")) & (F.col("x.comp") != F.col("y.comp")), limits).select("a", "b").join(tried, ["a", "b"], "left_anti")
        more = cut(more)
        edges, tried = cut(edges.union(_confirmed(more, texts, size, num, den))), tried.union(more)
    joint = connected_components(edges, "a", "b").withColumnRenamed("node", "rep")
    ids = cut(classes.select("set_key", "rep", "class_id").join(joint, "rep", "left").select("set_key", "class_id", F.coalesce("component", "rep").alias("comp")))
    smallest_id = ids.groupBy("comp").agg(F.min("class_id").alias("least_id"))
    return sets.drop("sig", "bits", "rid").join(ids.join(smallest_id, "comp").drop("class_id"), "set_key", "left").drop("set_key")


def _blocks(left: DataFrame, texts: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """Links (a, b) across components in long lists: the classes outside a list's largest component (the queries)
    against all classes of its lists, in blocks of at most about BLOCKED by BLOCKED classes.

    A block has its sets in one inverted index; for each query it returns one link to each component, never the pairs.
    """
    top = left.groupBy("token", "comp").agg(F.count("*").alias("m")).groupBy("token").agg(F.max_by("comp", F.struct("m", -F.col("comp"))).alias("g"), F.sum("m").alias("m")).filter(F.col("m") > LONG)
    members = left.join(top.select("token", "g"), "token").groupBy("g", "rep", "comp").agg(F.lit(1).alias("one"))
    query = F.col("comp") != F.col("g")
    count = members.groupBy("g").agg(F.ceil(F.count("*") / BLOCKED).cast("int").alias("na"), F.ceil(F.count_if(query) / BLOCKED).cast("int").alias("nq")).filter("nq > 0")
    placed = members.join(count, "g").join(texts, "rep").withColumns({"i": F.pmod(F.hash("rep"), F.col("na")), "j": F.pmod(F.hash("rep", F.lit(1)), F.col("nq"))})
    every = placed.select("g", "rep", "comp", "packed", "i", F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("j"), F.lit(False).alias("q"))
    asked = placed.filter(query).select("g", "rep", "comp", "packed", F.explode(F.sequence(F.lit(0), F.col("na") - 1)).alias("i"), "j", F.lit(True).alias("q"))

    def run(block: pd.DataFrame) -> pd.DataFrame:
        unpack, links = zstandard.ZstdDecompressor().decompress, []
        sets = [shingles_of(unpack(bytes(t)), size) for t in block["packed"]]
        rep, comp, asks = block["rep"].to_numpy(), block["comp"].to_numpy(), block["q"].to_numpy(bool)
        here = np.flatnonzero(~asks)
        if not len(here):
            return pd.DataFrame({"a": [], "b": []}).astype("int64")
        lengths = np.array([len(sets[k]) for k in here])
        flat, owner = np.concatenate([sets[k] for k in here]), np.repeat(np.arange(len(here)), lengths)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        for k in np.flatnonzero(asks):
            first, last = np.searchsorted(flat, sets[k], "left"), np.searchsorted(flat, sets[k], "right")
            both = np.bincount(np.concatenate([owner[x:y] for x, y in zip(first, last)]), minlength=len(here))
            near = (den * both >= num * (lengths + len(sets[k]) - both)) & (comp[here] != comp[k])
            seen = {}
            for x in here[near]:
                seen.setdefault(comp[x], rep[x])
            links += [(min(rep[k], x), max(rep[k], x)) for x in seen.values()]
        return pd.DataFrame(links, columns=["a", "b"]).astype("int64")

    return every.unionByName(asked).groupBy("g", "i", "j").applyInPandas(run, "a long, b long").distinct()


def _texts(rows: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(rep, packed) of the wanted classes, compressed before they are shuffled, written to the shared folder.

    wanted: (rep, set_key, src_id, src_th). A class's text is that of the row with this id and hash of the text; where others
    have the same of both, the set says which it is.
    """

    def pack():
        packer = zstandard.ZstdCompressor(level=1)
        return lambda batch: [[None if t.as_py() is None else packer.compress(t.as_py()) for t in batch.column(batch.schema.get_field_index("text")).cast(pa.binary())]]

    packed = annotate(rows.filter("text is not null"), [T.StructField("packed", T.BinaryType())], pack).drop("text")
    found = packed.join(wanted, (F.col("th") == F.col("src_th")) & F.col("id").eqNullSafe(F.col("src_id"))).dropDuplicates(["rep", "packed"])

    def check():
        unpack = zstandard.ZstdDecompressor().decompress
        at = lambda batch, name: batch.column(batch.schema.get_field_index(name))
        return lambda batch: [[key_of(shingles_of(unpack(t.as_py()), size)) == k.as_py() for t, k in zip(at(batch, "packed"), at(batch, "set_key"))]]

    right = annotate(found.select("rep", "set_key", "packed"), [T.StructField("right", T.BooleanType())], check).filter("right")
    return cut(right.select("rep", "packed").dropDuplicates(["rep"]))


def keep_one(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with one document of each group of near duplicates: that of the smallest doc_id, or without any, of one that has none.

    Of a group's rows that share its smallest doc_id, one stays. Rows without a text or words are in no group and all stay.
    Rows that share a doc_id or have none stay each for its group, so no text is lost that is not near another that
    stays. All columns of docs come back as they were, whatever their names.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*columns).alias("row"), F.col("doc_id").cast("long").alias("id"), "text")
    found = _components(rows.select("id", "text"), size, num, den).filter("comp is not null")
    best = found.groupBy("comp").agg(F.min(F.struct(F.col("id").isNull(), "id", "th")).alias("b")).select(F.coalesce("b.id", F.lit(0)).alias("k"), F.col("b.id").isNull().alias("none"), F.col("b.th").alias("th"))
    words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    keyed = rows.filter(words).select("row", F.coalesce("id", F.lit(0)).alias("k"), F.col("id").isNull().alias("none"), F.xxhash64("text").alias("th"))
    one = keyed.join(best, ["k", "none", "th"], "left_semi").groupBy("k", "none", "th").agg(F.first("row").alias("row")).select("row.*")
    return one.union(rows.filter(~words).select("row.*"))
