"""Queries on correlations and tests."""

from pyspark.sql import functions as F

from sparkfen.functions import columns as c
from sparkfen.operators import ranks
from sparkfen.operators import statistics as s
from sparkfen.operators.membership import unmapped_index
from sparkfen.plans.catalog import query
from sparkfen.plans.timeline import rounded
from sparkfen.session import cut

CORR = """with l as (unpivot (select platform, organism, x, y from xy) on platform, organism into name variable value category),
k as (select *, rank() over (partition by variable, category order by x) + (count(*) over (partition by variable, category, x) - 1) / 2.0::double as rx, rank() over (partition by variable, category order by y) + (count(*) over (partition by variable, category, y) - 1) / 2.0::double as ry from l)
select variable, category, count(*) as n, {} from k group by 1, 2 having count(*) >= 30"""


def _categories(b):
    return s.by_category(b.xy, ["platform", "organism"], ["x", "y"])


@query("pearson_by_category", CORR.format("round(corr(x, y), 6) as pearson"), "xy")
def pearson_by_category(b):
    """T01, T08, F15."""
    return rounded(s.moments(_categories(b), ["variable", "category"]).select("variable", "category", "n", "pearson"), 6)


@query("spearman_by_category", CORR.format("round(corr(rx, ry), 6) as spearman"), "xy")
def spearman_by_category(b):
    """T02, W03."""
    return rounded(s.spearman(_categories(b), ["variable", "category"]), 6)


@query("ols_by_category", CORR.format("round(avg(x), 6) as mean_x, round(avg(y), 4) as mean_y, round(regr_slope(y, x), 4) as slope, round(regr_intercept(y, x), 2) as intercept, round(regr_r2(y, x), 6) as r2"), "xy")
def ols_by_category(b):
    """T06, T08."""
    d = s.moments(_categories(b), ["variable", "category"])
    r = lambda x, k: F.round(x, k).alias(x)
    return d.select("variable", "category", "n", r("mean_x", 6), r("mean_y", 4), r("slope", 4), r("intercept", 2), r("r2", 6))


@query("category_statistics")
def category_statistics(b):
    """The whole battery with p values, labels and corrections."""
    d = s.battery(s.by_category(cut(b.xy), ["platform", "organism"], ["x", "y", "acc"]), ["variable", "category"], "x", "y", key=["acc"])
    return d.withColumns({"stars": c.significance(F.col("p_fdr")), "strength": c.strength(F.col("pearson")), "direction": c.direction(F.col("pearson"))})


@query("skipped_fields", " union all ".join(f"select '{f}' as field, n_values * n_groups as n_cells, n_values * n_groups - filled as n_zero, n_groups, n_with_data, (n_values * n_groups - filled > 0.95 * (n_values * n_groups)) and n_with_data < 0.5 * n_groups as skipped from (select count(*) as filled, count(distinct {f}) as n_values, count(distinct component_id) as n_with_data from (select distinct component_id, {f} from groups where {f} is not null)), (select count(distinct component_id) as n_groups from groups)" for f in ("lang", "source", "quality")), "groups")
def skipped_fields(b):
    """F21."""
    return s.sparse_fields(b.groups, "component_id", ["lang", "source", "quality"])


@query("coverage_sweep", "with r as (select sample_id, v as cov, count(distinct tax_id)::double as d, count(*)::double as h from profiles, (select unnest([0, 2, 4, 6, 8]) as v) where cov >= v group by 1, 2) select cov, count(*) as n, round(corr(d, h), 6) as pearson, round(regr_slope(h, d), 6) as slope from r group by 1", "profiles")
def coverage_sweep(b):
    """The coverage is part of the grouping key."""
    p = b.profiles.withColumn("v", F.explode(F.array(*[F.lit(v) for v in (0, 2, 4, 6, 8)]))).filter("cov >= v")
    r = p.groupBy("sample_id", F.col("v").alias("cov")).agg(F.countDistinct("tax_id").cast("double").alias("d"), F.count("*").cast("double").alias("h"))
    return r.groupBy("cov").agg(F.count("*").alias("n"), F.round(F.corr("d", "h"), 6).alias("pearson"), F.round(F.regr_slope("h", "d"), 6).alias("slope"))


@query("coverage_robustness", "with r as (select sample_id, v as cov, count(distinct tax_id)::double as d, count(*)::double as h from profiles, (select unnest([0, 2, 4, 6, 8]) as v) where cov >= v group by 1, 2), k as (select cov, corr(d, h) as r from r group by 1) select arg_max(cov, abs(r)) as best, arg_min(cov, abs(r)) as worst, round(max(r) - min(r), 6) as spread, case when max(r) - min(r) < 0.1 then 'very robust' when max(r) - min(r) < 0.2 then 'robust' when max(r) - min(r) < 0.3 then 'moderate' else 'sensitive' end as label from k", "profiles")
def coverage_robustness(b):
    """A33, X27."""
    p = b.profiles.withColumn("v", F.explode(F.array(*[F.lit(v) for v in (0, 2, 4, 6, 8)]))).filter("cov >= v")
    r = p.groupBy("sample_id", F.col("v").alias("cov")).agg(F.countDistinct("tax_id").cast("double").alias("d"), F.count("*").cast("double").alias("h"))
    k = r.groupBy("cov").agg(F.corr("d", "h").alias("r"))
    spread = F.max("r") - F.min("r")
    return k.agg(F.max_by("cov", F.abs("r")).alias("best"), F.min_by("cov", F.abs("r")).alias("worst"), F.round(spread, 6).alias("spread"), spread.alias("x")).select("best", "worst", "spread", c.robustness(F.col("x")).alias("label"))


@query("bh_fdr", "with t as (select s_suppkey as id, (abs(s_acctbal) + 1) / 12000 * (case when s_suppkey % 3 = 0 then 0.01::double else 1.0::double end) as p from supplier), r as (select *, count(*) over () as m, row_number() over (order by p) as i from t), q as (select *, p * m / i as q from r) select id, round(least(p * m, 1), 9) as p_bonferroni, round(least(min(q) over (order by i desc rows between unbounded preceding and current row), 1), 9) as p_fdr, least(min(q) over (order by i desc rows between unbounded preceding and current row), 1) <= 0.05 as rejected from q")
def bh_fdr(b):
    """T09, T10 over a made column of p values."""
    t = b.t("supplier").select(F.col("s_suppkey").alias("id"), ((F.abs("s_acctbal") + 1) / 12000 * F.when(F.col("s_suppkey") % 3 == 0, 0.01).otherwise(1.0)).alias("p"))
    return rounded(s.corrected(t).drop("p"))


@query("ols_residuals", "with f as (select regr_slope(y, x) as a, regr_intercept(y, x) as b from xy) select acc, round(a * x + b, 2) as expected, round(y - (a * x + b), 2) as excess, round(y / (a * x + b), 6) as excess_ratio from xy, f", "xy")
def ols_residuals(b):
    """T07."""
    d = s.residuals(b.xy, "x", "y")
    return d.select("acc", F.round("expected", 2).alias("expected"), F.round("excess", 2).alias("excess"), F.round("excess_ratio", 6).alias("excess_ratio"))


@query("chi2_cramers_v", "with c as (select center as a, platform as b, count(*)::double as o from meta group by 1, 2), k as (select *, sum(o) over (partition by a) as r, sum(o) over (partition by b) as c from c), s as (select sum(o) as n, count(distinct a) as nr, count(distinct b) as nc, sum(o * o / (r * c)) as s from k) select n::bigint as n, nr as rows, nc as cols, round(n * (s - 1), 6) as chi2, (nr - 1) * (nc - 1) as dof, round(sqrt(n * (s - 1) / (n * (least(nr, nc) - 1))), 9) as cramers_v from s", "meta")
def chi2_cramers_v(b):
    """T11, P16."""
    d = s.contingency(b.meta, "center", "platform")
    return d.select("n", "rows", "cols", F.round("chi2", 6).alias("chi2"), "dof", F.round("cramers_v", 9).alias("cramers_v"))


@query("mannwhitney_u", "with r as (select organism = 'BUILDING' as g, y, rank() over (order by y) + (count(*) over (partition by y) - 1) / 2.0::double as k, count(*) over (partition by y) as t from xy), a as (select count(*) filter (g) as n1, count(*) filter (not g) as n2, sum(k) filter (g) as r1, sum(t::double * t - 1) as t from r), u as (select *, r1 - n1 * (n1 + 1) / 2.0::double as u, (n1 + n2)::double as n from a) select n1, n2, round(u, 3) as u, round((greatest(u, n1 * n2 - u) - n1 * n2 / 2.0::double - 0.5) / sqrt(n1 * n2 / 12.0::double * ((n + 1) - t / (n * (n - 1)))), 6) as z from u", "xy")
def mannwhitney_u(b):
    """T13, T15."""
    d = s.mann_whitney(b.xy, F.col("organism") == "BUILDING", "y")
    return d.select("n1", "n2", F.round("u", 3).alias("u"), F.round("z", 6).alias("z"))


@query("group_comparison", "select round(median(y) filter (organism = 'BUILDING'), 4) as median_in, round(median(y) filter (organism <> 'BUILDING'), 4) as median_out, round(100 * (median(y) filter (organism = 'BUILDING') - median(y) filter (organism <> 'BUILDING')) / median(y) filter (organism <> 'BUILDING'), 6) as percent, case when median(y) filter (organism = 'BUILDING') > median(y) filter (organism <> 'BUILDING') then 'higher' else 'lower' end as direction from xy", "xy")
def group_comparison(b):
    """T15."""
    halves = ranks.percentiles(b.xy.select((F.col("organism") == "BUILDING").alias("inside"), "y"), ["inside"], "y", (0.5,))
    g = halves.agg(F.max(F.when(F.col("inside"), F.col("q0"))).alias("i"), F.max(F.when(~F.col("inside"), F.col("q0"))).alias("o"))
    return g.select(F.round("i", 4).alias("median_in"), F.round("o", 4).alias("median_out"), F.round(100 * (F.col("i") - F.col("o")) / F.col("o"), 6).alias("percent"), F.when(F.col("i") > F.col("o"), "higher").otherwise("lower").alias("direction"))


@query("fisher_enrichment")
def fisher_enrichment(b):
    """Outliers by centre, with Fisher's p and its correction; enrichment_ratio and odds_ratio have the parts that SQL has."""
    d = unmapped_index(b.sig, b.ref).join(b.meta, F.col("acc") == F.col("accession"))
    return s.corrected(s.enrichment(d, F.col("dmi") > 0.9, "center"), "p_fisher")


@query("enrichment_ratio", "with d as (select center, dmi > 0.9 as f from dmi join meta on acc = accession), t as (select count(*) filter (f) as ta, count(*) as tk from d) select center as category, count(*) filter (f) as a, count(*) filter (not f) as b, any_value(ta) - count(*) filter (f) as c, any_value(tk) - count(*) - any_value(ta) + count(*) filter (f) as d, round((count(*) filter (f)::double / count(*)) / (any_value(ta)::double / any_value(tk)), 9) as enrichment from d, t group by 1 having count(*) >= 10", "dmi", "meta")
def enrichment_ratio(b):
    """D18."""
    d = unmapped_index(b.sig, b.ref).join(b.meta, F.col("acc") == F.col("accession"))
    return rounded(s.enrichment(d, F.col("dmi") > 0.9, "center").drop("odds_ratio", "p_fisher"))


@query("kendall_distance_mic")
def kendall_distance_mic(b):
    """T03 to T05 by category."""
    return s.grouped(s.by_category(cut(b.xy), ["platform", "organism"], ["x", "y", "acc"]), ["variable", "category"], "x", "y", key=["acc"])


@query("odds_ratio", "with d as (select center, dmi > 0.9 as f from dmi join meta on acc = accession), t as (select count(*) filter (f) as ta, count(*) as tk from d), k as (select center as category, (count(*) filter (f))::double as a, count(*)::double as k from d group by 1 having count(*) >= 10) select category, round(case when (k - a) * (ta - a) > 0 then a * (tk - k - ta + a) / ((k - a) * (ta - a)) when a * (tk - k - ta + a) > 0 then 'inf'::double else 'nan'::double end, 9) as odds_ratio from k, t", "dmi", "meta")
def odds_ratio(b):
    """T12 without its p."""
    d = unmapped_index(b.sig, b.ref).join(b.meta, F.col("acc") == F.col("accession"))
    return rounded(s.enrichment(d, F.col("dmi") > 0.9, "center").select("category", "odds_ratio"))


@query("tests_with_p")
def tests_with_p(b):
    """T11, T13, T15 with their p values: each test a row."""
    chi = s.contingency(b.meta, "center", "platform").select(F.lit("chi2").alias("test"), F.col("chi2").alias("statistic"), "p")
    two = s.contingency(b.xy.select((F.col("organism") == "BUILDING").alias("g"), (F.col("platform") == "1-URGENT").alias("h")), "g", "h").select(F.lit("chi2 of two by two").alias("test"), F.col("chi2").alias("statistic"), "p")
    u = s.group_comparison(b.xy, F.col("organism") == "BUILDING", ["x", "y"]).select(F.concat(F.lit("rank sum of "), "variable").alias("test"), F.col("z").alias("statistic"), "p")
    return chi.union(two).union(u)


@query("chi2_two_by_two", "with t as (select count(*)::double as n, count(*) filter (g and h)::double as a, count(*) filter (g and not h)::double as b, count(*) filter (not g and h)::double as c, count(*) filter (not g and not h)::double as d from (select organism = 'BUILDING' as g, platform = '1-URGENT' as h from xy)) select n::bigint as n, round(n * power(greatest(abs(a * d - b * c) - n / 2, 0), 2) / ((a + b) * (c + d) * (a + c) * (b + d)), 6) as chi2, 1::bigint as dof from t", "xy")
def chi2_two_by_two(b):
    """T11 with the correction for continuity."""
    d = s.contingency(b.xy.select((F.col("organism") == "BUILDING").alias("g"), (F.col("platform") == "1-URGENT").alias("h")), "g", "h")
    return d.select("n", F.round("chi2", 6).alias("chi2"), "dof")
