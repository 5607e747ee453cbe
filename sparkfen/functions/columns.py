"""Column functions: strings, DNA, bins, labels, geography and bits. All run in the JVM."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values.
EARTH_KM = 6371.0
MISSING = ("nan", "None", "", "NULL", "null")


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once; a plain reuse would be evaluated anew inside each lambda and in filters made from it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def first_present(df: DataFrame, names: Sequence[str]) -> str | None:
    """The first of some column names that a frame has."""
    return next((n for n in names if n in df.columns), None)


def slug(c: Column) -> Column:
    """Slashes, blanks and backslashes as underscores."""
    return F.translate(c, "/ \\", "___")


def shortened(c: Column, n: int) -> Column:
    """At most n characters, an ellipsis in place of the rest."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 3), F.lit("..."))).otherwise(c)


def missing_as_na(c: Column) -> Column:
    """NA for nulls and for texts that stand for them."""
    return F.when(c.isNull() | c.isin(*MISSING), "NA").otherwise(c)


def reverse_complement(c: Column) -> Column:
    """Of a DNA string in capitals."""
    return F.translate(F.reverse(c), "ACGT", "TGCA")


def canonical(c: Column) -> Column:
    """The smaller of a k-mer and its reverse complement."""
    return F.least(c, reverse_complement(c))


def kmers(seq: Column, k: int) -> Column:
    """All windows of k characters, in capitals, as an array; empty for shorter texts."""
    up = F.upper(F.coalesce(seq, F.lit("")))
    made = F.transform(F.sequence(F.lit(1), F.length(up) - (k - 1)), lambda i: F.substr(up, i, F.lit(k)))
    return F.when(F.length(up) >= k, made).otherwise(F.array().cast("array<string>"))


def is_plain_dna(c: Column) -> Column:
    """Only A, C, G and T."""
    return c.rlike("^[ACGT]+$")


def gc_fraction(c: Column) -> Column:
    """Share of G and C; null for an empty text."""
    return F.when(F.length(c) > 0, (F.length(c) - F.length(F.translate(c, "GC", ""))) / F.length(c))


def longest_run(c: Column) -> Column:
    """Length of the longest run of one base; 0 without bases."""
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(c, F.lit("(A+|C+|G+|T+)"), F.lit(1)), lambda x: F.length(x))), F.lit(0))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.atan2(F.sqrt(a), F.sqrt(F.greatest(1 - a, F.lit(0.0))))


def right_closed(c: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label i for edges[i] < c <= edges[i + 1], the lowest edge included; null outside."""
    tests = [((c >= a) if i == 0 else (c > a)) & (c <= b) for i, (a, b) in enumerate(zip(edges, edges[1:]))]
    return F.coalesce(*[F.when(t, n) for t, n in zip(tests, labels)])


def magnitude(c: Column) -> Column:
    """Floor of the decimal logarithm of a positive number."""
    return F.when(c > 0, F.floor(F.log10(c))).cast("int")


def significance(p: Column) -> Column:
    """Stars for a p value."""
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")


def strength(r: Column) -> Column:
    """Words for the size of a correlation."""
    a = F.abs(r)
    return F.when(a >= 0.7, "strong").when(a >= 0.4, "moderate").when(a >= 0.2, "weak").otherwise("negligible")


def direction(r: Column) -> Column:
    """positive, negative or none."""
    return F.when(r > 0, "positive").when(r < 0, "negative").otherwise("none")


def robustness(spread: Column) -> Column:
    """A word for the range of a correlation over settings."""
    return F.when(spread < 0.1, "very robust").when(spread < 0.2, "robust").when(spread < 0.3, "moderate").otherwise("sensitive")


def amplicon_class(c: Column) -> Column:
    """One of five marker classes, the first that fits."""
    return F.when(c.ilike("%16s%"), "16S").when(c.ilike("%18s%"), "18S").when(c.ilike("%its%"), "ITS").when(c.ilike("%coi%") | c.ilike("%co1%"), "COI").otherwise("other")


def signature(columns: Sequence[str], width: int = 50) -> Column:
    """name=value pairs joined by |, values cut to width, nulls left out."""
    return F.concat_ws("|", *[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}="), F.substring(F.col(c).cast("string"), 1, width))) for c in columns])


def spurious_hashes(coverage: Column, error: float) -> Column:
    """Chance that one wrong base repeats: half the square of coverage * error / 3."""
    return F.pow(coverage * error / 3, 2) / 2


def birthday_bound(n: Column, bits: int = 64) -> Column:
    """Expected collisions of n hashes."""
    return n.cast("double") * n.cast("double") / (2 * 2.0**bits)


def leading_zeros(h: Column) -> Column:
    """Leading zero bits of a long taken as unsigned."""
    return F.when(h == 0, 64).otherwise(64 - F.length(F.bin(h))).cast("int")


def unsigned(h: Column) -> Column:
    """A long taken as unsigned, as decimal(20, 0)."""
    d = h.cast("decimal(20,0)")
    return F.when(h < 0, d + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(d).cast("decimal(20,0)")


def attributes_map(attributes: Column, drop: Sequence[str] = ("primary_search",)) -> Column:
    """array<struct<k, v>> as a map; of repeated keys the first wins."""
    kept = F.filter(attributes, lambda a: ~a["k"].isin(*drop) & a["k"].isNotNull())
    keys = F.array_distinct(F.transform(kept, lambda a: a["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(kept, lambda a: a["k"] == k), 1)["v"]))


def biome_of(attributes: Column) -> Column:
    """The value of the first tag with biome, or with environment but not environmental; else unknown."""
    fits = lambda a: F.lower(a["k"]).contains("biome") | (F.lower(a["k"]).contains("environment") & ~F.lower(a["k"]).contains("environmental"))
    return F.coalesce(F.get(F.filter(attributes, fits), 0)["v"], F.lit("unknown"))


def any_of(tests: Sequence[Column]) -> Column:
    """Logical or of several tests."""
    return reduce(lambda a, b: a | b, tests)


def point_of_ewkb(hex_text: Column) -> Column:
    """struct(lon, lat) of a little-endian EWKB point with SRID in hexadecimal; null for anything shorter.

    The IEEE doubles are put together from their bits, in the JVM.
    """

    def double_at(first: int) -> Column:
        little = F.substring(hex_text, 2 * first + 1, 16)
        big = F.concat(*[F.substring(little, 15 - 2 * i, 2) for i in range(8)])
        high, low = F.conv(F.substring(big, 1, 8), 16, 10).cast("long"), F.conv(F.substring(big, 9, 8), 16, 10).cast("long")
        sign = F.when(high >= 1 << 31, -1.0).otherwise(1.0)
        exponent = F.shiftright(high, 20).bitwiseAND(F.lit(0x7FF).cast("long"))
        fraction = (high.bitwiseAND(F.lit(0xFFFFF).cast("long")).cast("double") * 4294967296.0 + low.cast("double")) / 4503599627370496.0
        return F.when(exponent == 0, sign * fraction * F.pow(F.lit(2.0), F.lit(-1022.0))).otherwise(sign * (1 + fraction) * F.pow(F.lit(2.0), exponent - 1023))

    return F.when(F.length(hex_text) >= 50, F.struct(double_at(9).alias("lon"), double_at(17).alias("lat")))
