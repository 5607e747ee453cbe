"""Correlations, regressions, tests and corrections, one grouped pass for all categories."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkfen.functions import special
from sparkfen.operators.ranks import joined, least_above, mid_ranks, parts_for, percentiles, ranged, value_counts
from sparkfen.session import cut


def p_of_r(r: str, n: str) -> Column:
    """Two-sided p of a correlation, for the few rows of a result."""

    @F.pandas_udf("double")
    def p(r: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([special.p_of_r(a, b) for a, b in zip(r, n)])

    return p(F.col(r), F.col(n))


def p_of(kind: str, *columns: str) -> Column:
    """The p value of a score "z" (two-sided) or of "chi2" and its degrees of freedom, for the few rows of a result."""
    tail = {"z": special.p_of_z, "chi2": special.p_of_chi2}[kind]

    @F.pandas_udf("double")
    def p(*values: pd.Series) -> pd.Series:
        return pd.Series([tail(*(None if pd.isna(v) else v for v in row)) for row in zip(*values)])

    return p(*columns)


def by_category(df: DataFrame, variables: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """(variable, category, keep...): a row for each variable's non-null category, so one pass serves all variables."""
    cells = F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).cast("string").alias("category")) for v in variables])
    return df.select(F.explode(cells).alias("c"), *keep).select("c.variable", "c.category", *keep).filter("category is not null")


def moments(df: DataFrame, by: Sequence[str], x: str = "x", y: str = "y", least: int = 30) -> DataFrame:
    """By group of at least `least` complete pairs: n, means, Pearson r, OLS slope, intercept and R squared, in one grouped pass."""
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    a = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y"), F.corr("x", "y").alias("pearson"),
        F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r2"),
    )
    return a.filter(F.col("n") >= least)


def spearman(df: DataFrame, by: Sequence[str], x: str = "x", y: str = "y", least: int = 30) -> DataFrame:
    """(by..., n, spearman) of groups of at least `least` complete pairs, from ranks with ties at their mean."""
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    ranked = mid_ranks(mid_ranks(rows, by, "x", "rx"), by, "y", "ry")
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), F.corr("rx", "ry").alias("spearman")).filter(F.col("n") >= least)


def correlations(df: DataFrame, by: Sequence[str], x: str = "x", y: str = "y", least: int = 30) -> DataFrame:
    """The columns of moments(), and spearman."""
    return joined(moments(df, by, x, y, least), spearman(df, by, x, y, least).drop("n"), by)


def kendall(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """(by..., n, kendall_tau, p_kendall): tie-corrected tau-b over all complete pairs of each group, and its normal p.

    Exact, and no task holds a group: values of x and of y are dealt into ranges. Discordant pairs in other ranges of both are
    counted from the ranges' sums; those that share a range of x within it, and those that share one of y within that by their
    ranges of x, so that no cell of two ranges is a group of its own.
    """
    by = list(by)
    return _tau(cut(_counts(df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()), by, x, y)), by)


def _counts(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """(by..., x, y, c): how often each pair occurs in its group."""
    return df.groupBy(*by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).agg(F.count("*").alias("c"))


def _tau(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """kendall() of counted pairs (by..., x, y, c)."""
    parts = parts_for(rows.count())
    cells = cut(ranged(ranged(rows, "x", "xb", parts), "y", "yb", parts))
    kinds = ", ".join(f"{k} {t}" for k, t in cells.dtypes if k in by)

    def inside(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["first", "y"])
        r = np.unique(g["y"], return_inverse=True)[1]
        c = g["c"].to_numpy(float)
        return pd.DataFrame([[*g.iloc[0][by], float(c @ special.dominated(r.max() - r, c[:, None])[:, 0])]])

    def across(g: pd.DataFrame) -> pd.DataFrame:
        m = np.zeros((g["xb"].max() + 1, g["yb"].max() + 1))
        m[g["xb"], g["yb"]] = g["m"]
        before = m.cumsum(0) - m  # earlier ranges of x
        later = before[:, ::-1].cumsum(1)[:, ::-1] - before  # and later ones of y
        return pd.DataFrame([[*g.iloc[0][by], float((m * later).sum())]])

    def within(place: str, first: str) -> DataFrame:
        # A range of one value of either has no discordant pair.
        w = W.partitionBy(*by, place)
        rows = cells.select(*by, place, F.col(first).cast("double").alias("first"), "y", "c")
        some = rows.withColumns({"x0": F.min("first").over(w), "x1": F.max("first").over(w), "y0": F.min("y").over(w), "y1": F.max("y").over(w)}).filter("x0 < x1 and y0 < y1").select(*by, place, "first", "y", "c")
        return some.groupBy(*by, place).applyInPandas(inside, f"{kinds}, d double")

    sums = cells.groupBy(*by, "xb", "yb").agg(F.sum("c").cast("double").alias("m")).groupBy(*by).applyInPandas(across, f"{kinds}, d double")
    parts = sums.union(within("xb", "x")).union(within("yb", "xb"))
    discordant = parts.groupBy(*by).agg(F.sum("d").alias("d"))

    def ties(column: str, name: str) -> DataFrame:
        t = cells.groupBy(*by, column).agg(F.sum("c").cast("double").alias("t")) if column else cells.select(*by, F.col("c").cast("double").alias("t"))
        f = F.col("t") * (F.col("t") - 1)
        return t.groupBy(*by).agg(F.sum(f).alias(f"{name}1"), F.sum(f * (F.col("t") - 2)).alias(f"{name}2"), F.sum(f * (2 * F.col("t") + 5)).alias(f"{name}3"))

    n = cells.groupBy(*by).agg(F.sum("c").alias("n"))
    a = n.join(ties("x", "p"), by).join(ties("y", "q"), by).join(ties("", "r"), by).join(discordant, by)
    pairs, m = F.col("n") * (F.col("n") - F.lit(1.0)), F.col("n").cast("double")
    score = (pairs - F.col("p1") - F.col("q1") + F.col("r1")) / 2 - 2 * F.col("d")
    bottom = F.sqrt((pairs - F.col("p1")) / 2) * F.sqrt((pairs - F.col("q1")) / 2)
    spread = (pairs * (2 * m + 5) - F.col("p3") - F.col("q3")) / 18 + F.col("p1") * F.col("q1") / (2 * pairs) + F.when(m > 2, F.col("p2") * F.col("q2") / (9 * pairs * (m - 2))).otherwise(0.0)
    a = a.select(*by, "n", F.when(bottom > 0, score / bottom).alias("kendall_tau"), F.when((spread > 0) & (m > 2) & (bottom > 0), score / F.sqrt(spread)).alias("z"))
    return a.withColumn("p_kendall", p_of("z", "z")).drop("z")


def grouped(df: DataFrame, by: Sequence[str], x: str, y: str, key: Sequence[str] = (), most: int | None = None, seed: int = 42) -> DataFrame:
    """(by..., n, n_used, kendall_tau, p_kendall, distance_corr, mic) of complete pairs of each group.

    All are those of all pairs. Only where `most` is given, the last two are those of n_used pairs: all, or of groups larger than it about
    `most` by a seeded hash of the key columns (by default x and y, so that equal pairs go together). A task holds a
    group's distinct pairs and how often each occurs, sorted first, so results do not depend on the order of rows. The distance correlation
    and the two directions of the information coefficient are tasks of their own.
    """
    by, key = list(by), key or (x, y)
    complete = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    rows = cut(_counts(complete, by, x, y))
    tau = cut(_tau(rows, by))
    if most is not None:
        hashed = complete.select(*by, x, y, F.xxhash64(*key, F.lit(seed)).alias("h")).join(tau.select(*by, "n"), by)
        rows = _counts(hashed.filter((F.col("n") <= most) | (F.pmod("h", F.lit(1 << 30)) < F.lit(float(most) * (1 << 30)) / F.col("n"))), by, x, y)
    kinds = ", ".join(f"{k} {t}" for k, t in rows.dtypes if k in by)

    def run(group: tuple, g: pa.Table) -> pa.Table:
        a, c, m = (g.column(k).to_numpy() for k in "xyc")
        order, job = np.lexsort((c, a)), group[-1].as_py()
        a, c, m = a[order], c[order], m[order]
        distance = special.distance_correlation(a, c, m) if job == 0 else None
        along = special.information_along(a, c, times=m) if job == 1 else special.information_along(c, a, times=m) if job == 2 else None
        found = [pa.array([v], t) for v, t in ((int(m.sum()), pa.int64()), (distance, pa.float64()), (along, pa.float64()))]
        return pa.Table.from_arrays([*(g.column(k).slice(0, 1) for k in by), *found], [*by, "n_used", "distance_corr", "mic"])

    # A number of partitions that is given is not reduced, so that no task has many of these jobs.
    jobs = rows.withColumn("job", F.explode(F.array(*map(F.lit, range(3))))).repartition(min(2000, 18 * max(1, tau.count())), *by, "job")
    found = jobs.groupBy(*by, "job").applyInArrow(run, f"{kinds}, n_used long, distance_corr double, mic double").groupBy(*by).agg(*[F.max(k).alias(k) for k in ("n_used", "distance_corr", "mic")])
    return tau.join(found, by).select(*by, "n", "n_used", "kendall_tau", "p_kendall", "distance_corr", "mic")


def battery(df: DataFrame, by: Sequence[str], x: str, y: str, key: Sequence[str] = (), least: int = 30) -> DataFrame:
    """The correlations of each group with their p values: Pearson, Spearman, Kendall, distance correlation, information
    coefficient and regression, with the corrected p of Pearson's over all rows of the result."""
    c = correlations(df, by, x, y, least).withColumns({"p": p_of_r("pearson", "n"), "p_spearman": p_of_r("spearman", "n")})
    return corrected(cut(c.join(grouped(df, by, x, y, key).drop("n"), list(by))))


def corrected(df: DataFrame, p: str = "p", within: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """df with p_bonferroni, p_fdr (Benjamini-Hochberg) and rejected, over rows with a p value in each part of `within`.

    df is a table of tests, one row a test, of any size: a value's last rank counts, so ties share one corrected p, and the running
    minimum from above is taken in ranges of p.
    """
    tests = df.filter(F.col(p).isNotNull())
    v = value_counts(tests, within, p)
    v = joined(v, tests.groupBy(*within).agg(F.count("*").alias("__m")), within)
    v = least_above(v.withColumn("__q", F.col(p) * F.col("__m") / (F.col("below") + F.col("c"))), within, p, "__q", "__fdr")
    out = joined(tests, v.select(*within, p, "__m", "__fdr"), [*within, p])
    one = F.lit(1.0)
    return out.withColumns({"p_bonferroni": F.least(F.col(p) * F.col("__m"), one), "p_fdr": F.least("__fdr", one)}).withColumn("rejected", F.col("p_fdr") <= alpha).drop("__m", "__fdr")


def residuals(df: DataFrame, x: str, y: str) -> DataFrame:
    """df with expected, excess and excess_ratio from a regression over the whole frame."""
    fit = df.agg(F.regr_slope(y, x).alias("__a"), F.regr_intercept(y, x).alias("__b"))
    e = F.col("__a") * F.col(x) + F.col("__b")
    return df.crossJoin(F.broadcast(fit)).withColumn("expected", e).withColumns({"excess": F.col(y) - e, "excess_ratio": F.when(e != 0, F.col(y) / e)}).drop("__a", "__b")


def contingency(df: DataFrame, a: str, b: str, top: int = 100) -> DataFrame:
    """One row: n, rows, cols, chi2, dof, p, cramers_v of two categories, each kept to its `top` most frequent values.

    Chi squared comes from the non-empty cells alone: n * (sum of O**2 / (R * C) - 1). With one degree of freedom each
    deviation is brought nearer to 0 by a half, as Yates has it; cramers_v is that of this chi squared.
    """
    rows = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b"))
    for c in ("a", "b"):
        best = rows.groupBy(c).count().orderBy(F.desc("count"), c).limit(top).select(c)
        rows = rows.join(best, c, "left_semi")
    cells = rows.groupBy("a", "b").agg(F.count("*").cast("double").alias("o"))
    ra, cb = cells.groupBy("a").agg(F.sum("o").alias("r")), cells.groupBy("b").agg(F.sum("o").alias("c"))
    total = cells.agg(F.sum("o").alias("t"))
    s = cells.join(ra, "a").join(cb, "b").crossJoin(F.broadcast(total)).agg(
        F.sum("o").alias("n"), F.countDistinct("a").alias("rows"), F.countDistinct("b").alias("cols"), F.sum(F.col("o") * F.col("o") / (F.col("r") * F.col("c"))).alias("s"),
        F.max(F.abs(F.col("o") - F.col("r") * F.col("c") / F.col("t"))).alias("off"),
    )
    dof = (F.col("rows") - 1) * (F.col("cols") - 1)
    near = F.when(F.col("off") > 0, F.greatest(F.col("off") - 0.5, F.lit(0.0)) / F.col("off")).otherwise(0.0)
    chi = F.when(dof > 0, F.greatest(F.col("n") * (F.col("s") - 1), F.lit(0.0)) * F.when(dof == 1, near * near).otherwise(1.0)).otherwise(0.0)
    small = F.least("rows", "cols") - 1
    out = s.select(F.col("n").cast("long").alias("n"), "rows", "cols", chi.alias("chi2"), dof.alias("dof"), F.when(small > 0, F.sqrt(chi / (F.col("n") * small))).alias("cramers_v"))
    return out.withColumn("p", p_of("chi2", "chi2", "dof"))


def mann_whitney(df: DataFrame, group: Column, x: str) -> DataFrame:
    """One row: n1, n2, u, z, p: two-sided, tie-corrected, with continuity. Ranks are made from counts by value, not by row."""
    rows = df.filter(F.col(x).isNotNull()).select(group.cast("int").alias("g"), F.col(x).cast("double").alias("x"))
    values = value_counts(rows, [], "x", [F.count_if(F.col("g") == 1).alias("c1")])
    ranked = values.withColumn("mid", F.col("below") + (F.col("c") + 1) / 2)
    s = ranked.agg(F.sum("c1").alias("n1"), (F.sum("c") - F.sum("c1")).alias("n2"), F.sum(F.col("c1") * F.col("mid")).alias("r1"), F.sum(F.col("c").cast("double") * F.col("c") * F.col("c") - F.col("c")).alias("t"))
    n1, n2, n = F.col("n1").cast("double"), F.col("n2").cast("double"), (F.col("n1") + F.col("n2")).cast("double")
    u = F.col("r1") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("t") / (n * (n - 1))))
    top = F.greatest(u, n1 * n2 - u)
    return s.select("n1", "n2", u.alias("u"), ((top - n1 * n2 / 2 - 0.5) / sd).alias("z")).withColumn("p", F.least(p_of("z", "z"), F.lit(1.0)))


def group_comparison(df: DataFrame, inside: Column, variables: Sequence[str]) -> DataFrame:
    """(variable, n1, n2, median_in, median_out, percent, direction, u, z, p, p_bonferroni, p_fdr, rejected): rows in and out of a group, for each variable."""
    out = None
    for v in variables:
        rows = df.select(inside.alias("__in"), F.col(v).cast("double").alias("x")).filter("x is not null and __in is not null")
        halves = percentiles(rows, ["__in"], "x", (0.5,))
        m = halves.agg(F.max(F.when(F.col("__in"), F.col("q0"))).alias("median_in"), F.max(F.when(~F.col("__in"), F.col("q0"))).alias("median_out"))
        percent = F.when(F.col("median_out") != 0, 100 * (F.col("median_in") - F.col("median_out")) / F.col("median_out"))
        direction = F.when(F.col("median_in") > F.col("median_out"), "higher").when(F.col("median_in") < F.col("median_out"), "lower").otherwise("equal")
        row = mann_whitney(rows, F.col("__in"), "x").crossJoin(F.broadcast(m)).select(F.lit(v).alias("variable"), "n1", "n2", "median_in", "median_out", percent.alias("percent"), direction.alias("direction"), "u", "z", "p")
        out = row if out is None else out.unionByName(row)
    return corrected(out)


def sparse_fields(df: DataFrame, by: str, fields: Sequence[str], zeros: float = 0.95, known: float = 0.5) -> DataFrame:
    """(field, n_cells, n_zero, n_groups, n_with_data, skipped): fields whose table of values by group has more than `zeros` empty
    cells, while fewer than `known` of the groups have a value at all, are to be skipped."""
    groups = df.select(by).filter(F.col(by).isNotNull()).distinct().agg(F.count("*").alias("n_groups"))
    out = None
    for f in fields:
        cells = df.filter(F.col(f).isNotNull() & F.col(by).isNotNull()).groupBy(by, F.col(f).alias("v")).agg(F.lit(1).alias("one"))
        a = cells.agg(F.count("*").alias("filled"), F.countDistinct("v").alias("n_values"), F.countDistinct(by).alias("n_with_data")).crossJoin(F.broadcast(groups))
        row = a.select(F.lit(f).alias("field"), (F.col("n_values") * F.col("n_groups")).alias("n_cells"), (F.col("n_values") * F.col("n_groups") - F.col("filled")).alias("n_zero"), "n_groups", "n_with_data")
        out = row if out is None else out.union(row)
    return out.withColumn("skipped", (F.col("n_zero") > zeros * F.col("n_cells")) & (F.col("n_with_data") < known * F.col("n_groups")))


def enrichment(df: DataFrame, flag: Column, category: str, least: int = 10) -> DataFrame:
    """(category, a, b, c, d, enrichment, odds_ratio, p_fisher): flagged and other rows inside and outside each category."""
    counts = df.filter(F.col(category).isNotNull()).groupBy(F.col(category).alias("category")).agg(F.count_if(flag).alias("a"), F.count("*").alias("k"))
    total = counts.agg(F.sum("a").alias("ta"), F.sum("k").alias("tk"))
    t = counts.crossJoin(F.broadcast(total)).filter(F.col("k") >= least).select("category", "a", (F.col("k") - F.col("a")).alias("b"), (F.col("ta") - F.col("a")).alias("c"), (F.col("tk") - F.col("k") - F.col("ta") + F.col("a")).alias("d"), ((F.col("a") / F.col("k")) / (F.col("ta") / F.col("tk"))).alias("enrichment"))

    @F.pandas_udf("odds_ratio double, p_fisher double")
    def fisher(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([special.fisher_exact(*map(int, v)) for v in zip(a, b, c, d)], columns=["odds_ratio", "p_fisher"])

    return t.withColumn("f", fisher("a", "b", "c", "d")).select("*", "f.*").drop("f")
