"""Queries on richness, diversity, percentiles, modes and top lists."""

from pyspark.sql import functions as F

from sparkfen.functions import columns as c
from sparkfen.operators import measures as m
from sparkfen.operators import ranks
from sparkfen.operators.membership import per_megabase, ratio, unmapped_index
from sparkfen.plans.catalog import query
from sparkfen.plans.timeline import rounded

LEVELS = (10, 8, 6, 5, 4, 2, 1, 0)


@query("richness_per_sample", "select sample_id, greatest(count(distinct organism_id), count(distinct tax_id)) as alpha_diversity from profiles where cov >= 5 group by 1", "profiles")
def richness_per_sample(b):
    """D13, A07."""
    return m.richness(b.profiles, 5)


@query("richness_density", "with r as (select sample_id, greatest(count(distinct organism_id), count(distinct tax_id)) as alpha_diversity from profiles where cov >= 5 group by 1), m as (select bioproject, sum(mbases) as mbases from meta group by 1) select sample_id, alpha_diversity, round(mbases, 6) as mbases, round(case when mbases > 0 then alpha_diversity::double / mbases end, 6) as alpha_diversity_per_mb from r left join m on bioproject = sample_id", "profiles", "meta")
def richness_density(b):
    """D13, J08, P03, P04."""
    mb = b.meta.groupBy(F.col("bioproject").alias("sample_id")).agg(F.sum("mbases").alias("mbases"))
    return rounded(per_megabase(m.richness(b.profiles, 5).join(mb, "sample_id", "left"), ["alpha_diversity"]), 6)


@query("richness_by_coverage", "select sample_id, " + ", ".join(f"count(distinct case when cov >= {v} then tax_id end) as taxa_coverage_{v}" for v in LEVELS) + " from profiles group by 1", "profiles")
def richness_by_coverage(b):
    """D14, A06, J07."""
    return m.richness_by_coverage(b.profiles, LEVELS)


@query("functional_diversity", "with p as (select *, abundance / sum(abundance) over (partition by sample_id) as p from ko where abundance > 0), a as (select sample_id, count(*) as richness, -sum(p * ln(p)) as shannon, sum(p * p) as simpson, max(p) as berger_parker from p group by 1) select sample_id, richness, round(shannon, 9) as shannon, round(simpson, 9) as simpson, round(1 - simpson, 9) as gini_simpson, round(1 / simpson, 6) as hill_2, round(berger_parker, 9) as berger_parker, round(case when richness > 1 then shannon / ln(richness) end, 9) as pielou from a", "ko")
def functional_diversity(b):
    """D16, A14."""
    d = m.diversity(b.ko)
    return d.select(*[F.round(x, 6 if x == "hill_2" else 9).alias(x) if k == "double" else x for x, k in d.dtypes])


@query("robust_yearly_summary", """with d as (select sample_id, """ + ", ".join(f"count(distinct case when cov >= {v} then tax_id end) as c{v}" for v in (8, 4, 0)) + """ from profiles group by 1),
l as (select release_year, cov, v::double as x from (select distinct bioproject, release_year from meta) join (unpivot d on c8, c4, c0 into name cov value v) on sample_id = bioproject),
r as (select *, row_number() over (partition by release_year, cov order by x) as i, count(*) over (partition by release_year, cov) as n from l), k as (select *, floor(n * 0.1) as k from r)
select release_year, cov, max(n) as n, round(avg(x), 9) as mean, median(x) as median, round(exp(avg(ln(x)) filter (x > 0)), 9) as geometric, round(avg(x) filter (i > k and i <= n - k), 9) as trimmed,
round((sum(x) filter (i > k and i <= n - k) + max(k) * (max(x) filter (i = k + 1) + max(x) filter (i = n - k))) / max(n), 9) as winsorised, round(stddev_samp(x), 9) as sd, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) as iqr, round(stddev_samp(x) / sqrt(max(n)), 9) as sem, round(1.96 * stddev_samp(x) / sqrt(max(n)), 9) as ci95 from k group by 1, 2""", "profiles", "meta")
def robust_yearly_summary(b):
    """D15, P14, A15, A16."""
    d = m.richness_by_coverage(b.profiles, (8, 4, 0)).toDF("sample_id", "c8", "c4", "c0").unpivot(["sample_id"], ["c8", "c4", "c0"], "cov", "x")
    years = b.meta.select(F.col("bioproject").alias("sample_id"), "release_year").distinct()
    return rounded(m.robust_means(d.join(years, "sample_id"), ["release_year", "cov"], "x"))


@query("corpus_totals", "select count(*) as n, count(distinct bioproject) as n_projects, round(sum(mbases), 3) as total_mb, min(mbases) as least_mb, max(mbases) as most_mb, round(avg(mbases), 6) as mean_mb, round(median(mbases), 6) as median_mb from meta", "meta")
def corpus_totals(b):
    """D20, A01, A05."""
    median = ranks.percentiles(b.meta, [], "mbases", (0.5,)).select(F.round("q0", 6).alias("median_mb"))
    sums = b.meta.agg(F.count("*").alias("n"), F.countDistinct("bioproject").alias("n_projects"), F.round(F.sum("mbases"), 3).alias("total_mb"), F.min("mbases").alias("least_mb"), F.max("mbases").alias("most_mb"), F.round(F.avg("mbases"), 6).alias("mean_mb"))
    return sums.crossJoin(F.broadcast(median))


@query("top_values", "select center, count(*) as n from meta group by 1 order by n desc, center limit 10", "meta")
def top_values(b):
    """A08, A11, W04, L01, L03."""
    return m.top_counts(b.meta, "center", 10)


@query("by_year", "select release_year, platform, count(*) as n from meta where release_year is not null group by all", "meta")
def by_year(b):
    """D20, F02, P02, X15."""
    return b.meta.filter("release_year is not null").groupBy("release_year", "platform").agg(F.count("*").alias("n"))


@query("rare_category_other", "with c as (select center, count(*) as n from meta group by 1) select case when n >= 600 then center else 'Other' end as center, sum(n)::bigint as n from c group by 1", "meta")
def rare_category_other(b):
    """A19."""
    return m.other_below(b.meta, "center", 600)


@query("topn_other", "with t as (select center from meta group by 1 order by count(*) desc, center limit 5) select coalesce(t.center, 'other') as center, count(*) as n from meta left join t on t.center = meta.center group by 1", "meta")
def topn_other(b):
    """A20."""
    return m.top_or_other(b.meta, "center", 5).groupBy("center").agg(F.count("*").alias("n"))


@query("ilike_class", "select case when text ilike '%16s%' then '16S' when text ilike '%18s%' then '18S' when text ilike '%its%' then 'ITS' when text ilike '%coi%' or text ilike '%co1%' then 'COI' else 'other' end as class, count(*) as n from documents where text ilike '%the%' and not (text ilike '%zz%' or text ilike 'a%') group by 1")
def ilike_class(b):
    """X03, F06."""
    d = b.t("documents").filter(F.col("text").ilike("%the%") & ~(F.col("text").ilike("%zz%") | F.col("text").ilike("a%")))
    return d.groupBy(c.amplicon_class(F.col("text")).alias("class")).agg(F.count("*").alias("n"))


@query("json_keys_top_values", "with k as (select unnest(json_keys(props)) as key, props from events), v as (select key, json_extract_string(props, '$.\"' || key || '\"') as value from k), n as (select key, count(*) as n_key from v group by 1 having count(*) > 100), c as (select key, value, count(*) as n, row_number() over (partition by key order by count(*) desc, value) as r from v group by 1, 2) select c.key, n_key, value, n, r as rank from c join n on n.key = c.key where r <= 20")
def json_keys_top_values(b):
    """One pass over all keys."""
    from pyspark.sql import Window as W

    e = b.t("events").select(F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))
    counts = e.groupBy("key", "value").agg(F.count("*").alias("n"))
    keys = counts.groupBy("key").agg(F.sum("n").alias("n_key")).filter("n_key > 100")
    ranked = counts.withColumn("rank", F.row_number().over(W.partitionBy("key").orderBy(F.desc("n"), "value")).cast("long"))
    return ranked.filter("rank <= 20").join(keys, "key").select("key", "n_key", "value", "n", "rank")


@query("binned_distribution", "select case when mbases >= 0 and mbases <= 50 then '0-50' when mbases > 50 and mbases <= 100 then '50-100' when mbases > 100 and mbases <= 200 then '100-200' when mbases > 200 and mbases <= 1000 then '200+' end as bin, count(*) as n, round(avg(mbases), 6) as mean_mb from meta group by 1", "meta")
def binned_distribution(b):
    """X13, A17."""
    bins = c.right_closed(F.col("mbases"), (0, 50, 100, 200, 1000), ("0-50", "50-100", "100-200", "200+"))
    return b.meta.groupBy(bins.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("mbases"), 6).alias("mean_mb"))


@query("quartile_bins", "with q as (select quantile_cont(mbases, 0.25) as a, quantile_cont(mbases, 0.5) as b, quantile_cont(mbases, 0.75) as c from meta) select case when mbases <= a then 'Q1' when mbases <= b then 'Q2' when mbases <= c then 'Q3' else 'Q4' end as bin, count(*) as n from meta, q group by 1", "meta")
def quartile_bins(b):
    """Edges from exact percentiles, right-closed."""
    q, x = ranks.percentiles(b.meta.select("mbases"), [], "mbases", (0.25, 0.5, 0.75)).drop("n"), F.col("mbases")
    return b.meta.select("mbases").crossJoin(F.broadcast(q)).groupBy(F.when(x <= F.col("q0"), "Q1").when(x <= F.col("q1"), "Q2").when(x <= F.col("q2"), "Q3").otherwise("Q4").alias("bin")).agg(F.count("*").alias("n"))


@query("percentile_grid", "select " + ", ".join(f"round(quantile_cont(mbases, {p / 100}), 6) as p{p:02d}" for p in (1, 5, 25, 50, 75, 95, 99)) + " from meta", "meta")
def percentile_grid(b):
    """A10."""
    ps = (1, 5, 25, 50, 75, 95, 99)
    g = ranks.percentiles(b.meta.select("mbases"), [], "mbases", [p / 100 for p in ps])
    return g.select(*[F.round(f"q{i}", 6).alias(f"p{p:02d}") for i, p in enumerate(ps)])


@query("equal_width_histogram", "select least(floor((mbases - 0) / 12.5), 19)::int as bin, count(*) as n from meta where mbases between 0 and 250 group by 1", "meta")
def equal_width_histogram(b):
    """A17."""
    return m.histogram(b.meta, "mbases", 0.0, 250.0, 20)


@query("density_grid", "select floor(x / 20)::bigint as gx, floor(y / 25000)::bigint as gy, count(*) as n, round(log10(count(*)), 9) as log_n from xy group by 1, 2", "xy")
def density_grid(b):
    """A34."""
    return rounded(m.density_grid(b.xy, "x", "y", 20, 25000))


@query("outlier_cohort", "with q as (select quantile_cont(x, 0.75) as hx, quantile_cont(y, 0.25) as ly from xy) select acc, x, y from xy, q where x > hx and y < hx * 1000 and y > ly", "xy")
def outlier_cohort(b):
    """flags against percentiles of the whole frame."""
    q = ranks.percentiles(b.xy, [], "x", (0.75,)).select(F.col("q0").alias("hx")).crossJoin(ranks.percentiles(b.xy, [], "y", (0.25,)).select(F.col("q0").alias("ly")))
    return b.xy.crossJoin(F.broadcast(q)).filter("x > hx and y < hx * 1000 and y > ly").select("acc", "x", "y")


@query("dark_cohort_by_group", "with q as (select quantile_cont(dmi, 0.9) as d, quantile_cont(unmapped_hashes::double, 0.9) as u from dmi) select organism, count(*) as n, round(avg(dmi), 9) as mean_dmi, max(unmapped_hashes) as most from dmi join meta on acc = accession, q where dmi >= d and unmapped_hashes >= u group by 1", "dmi", "meta")
def dark_cohort_by_group(b):
    """D19, F14, A18."""
    d = unmapped_index(b.sig, b.ref)
    q = ranks.percentiles(d, [], "dmi", (0.9,)).select(F.col("q0").alias("d")).crossJoin(ranks.percentiles(d, [], "unmapped_hashes", (0.9,)).select(F.col("q0").alias("u")))
    rows = d.crossJoin(F.broadcast(q)).filter("dmi >= d and unmapped_hashes >= u").join(b.meta, F.col("acc") == F.col("accession"))
    return rows.groupBy("organism").agg(F.count("*").alias("n"), F.round(F.avg("dmi"), 9).alias("mean_dmi"), F.max("unmapped_hashes").alias("most"))


@query("cohort_partition", "with q as (select quantile_cont(dmi, 0.9) as d, quantile_cont(total_hashes::double, 0.75) as t from dmi) select case when dmi > d then 'dark' when total_hashes > t then 'outlier' else 'normal' end as kind, count(*) as n from dmi, q group by 1", "dmi")
def cohort_partition(b):
    """O08."""
    d = unmapped_index(b.sig, b.ref)
    q = ranks.percentiles(d, [], "dmi", (0.9,)).select(F.col("q0").alias("d")).crossJoin(ranks.percentiles(d, [], "total_hashes", (0.75,)).select(F.col("q0").alias("t")))
    return d.crossJoin(F.broadcast(q)).groupBy(F.when(F.col("dmi") > F.col("d"), "dark").when(F.col("total_hashes") > F.col("t"), "outlier").otherwise("normal").alias("kind")).agg(F.count("*").alias("n"))


@query("provenance", "with g as (select bioproject, center, count(*) as n, median(mbases) as median_mb from meta group by 1, 2) select center, count(*) as n_projects, sum(n)::bigint as n, round(max(n)::double / sum(n), 9) as top_share, max(n)::double / sum(n) >= 0.5 as warned, round(max(median_mb), 6) as top_median from g group by 1", "meta")
def provenance(b):
    """D26, A18, A33."""
    by = ["bioproject", "center"]
    medians = ranks.percentiles(b.meta, by, "mbases", (0.5,)).select(*by, F.col("q0").alias("median_mb"))
    g = ranks.joined(b.meta.groupBy(*by).agg(F.count("*").alias("n")), medians, by, "left")
    share = ratio(F.max("n"), F.sum("n"))
    return g.groupBy("center").agg(F.count("*").alias("n_projects"), F.sum("n").alias("n"), F.round(share, 9).alias("top_share"), (share >= 0.5).alias("warned"), F.round(F.max("median_mb"), 6).alias("top_median"))


@query("decomposition_shares", "select platform, round(avg(mapped_hashes) / avg(total_hashes), 9) as mapped_share, round(sum(mapped_hashes)::double / sum(total_hashes), 9) as pooled from dmi join meta on acc = accession group by 1", "dmi", "meta")
def decomposition_shares(b):
    """A29."""
    d = unmapped_index(b.sig, b.ref).join(b.meta, F.col("acc") == F.col("accession"))
    return d.groupBy("platform").agg(F.round(F.avg("mapped_hashes") / F.avg("total_hashes"), 9).alias("mapped_share"), F.round(ratio(F.sum("mapped_hashes"), F.sum("total_hashes")), 9).alias("pooled"))


@query("median_element", "with t as (select center from meta group by 1 order by count(*) desc, center limit 5), r as (select center, acc, row_number() over (partition by center order by mbases, acc) as i, count(*) over (partition by center) as n from meta where center in (from t)) select center, acc from r where i = n // 2 + 1", "meta")
def median_element(b):
    """The element at position n // 2 of each of the top groups."""
    t = m.top_counts(b.meta, "center", 5).select("center")
    rows = b.meta.select("center", "acc", "mbases").join(t, "center", "left_semi")
    r = ranks.joined(ranks.ordinal(rows, ["center"], "mbases", "i", then=["acc"]), rows.groupBy("center").agg(F.count("*").alias("n")), ["center"])
    return r.filter(F.col("i") == F.floor(F.col("n") / 2) + 1).select("center", "acc")


@query("nearest_rank_quartiles", "with r as (select platform, mbases, row_number() over (partition by platform order by mbases) - 1 as i, count(*) over (partition by platform) as n from meta) select platform, max(mbases) filter (i = n // 4) as q1, max(mbases) filter (i = (3 * n) // 4) as q3 from r group by 1", "meta")
def nearest_rank_quartiles(b):
    """A31."""
    return ranks.at_positions(b.meta, ["platform"], "mbases", {"q1": lambda n: F.floor(n / 4), "q3": lambda n: F.floor(3 * n / 4)}).drop("n")


@query("extreme_categories", "with c as (select center, avg(mbases) as a from meta group by 1) select arg_max(center, a) as best, arg_min(center, a) as worst from c", "meta")
def extreme_categories(b):
    """A33."""
    g = b.meta.groupBy("center").agg(F.avg("mbases").alias("a"))
    return g.agg(F.max_by("center", "a").alias("best"), F.min_by("center", "a").alias("worst"))


@query("listed_values", "with c as (select bioproject, platform as v, count(*) as c from meta group by 1, 2), r as (select *, row_number() over (partition by bioproject order by c desc, v) as i, count(*) over (partition by bioproject) as m from c) select bioproject, string_agg(v || '(' || c || ')', ', ' order by i) filter (i <= 3) || case when max(m) > 3 then ' (+' || (max(m) - 3) || ' more)' else '' end as text from r group by 1", "meta")
def listed_values(b):
    """A25."""
    return m.listed(["bioproject"], b.meta, "platform", 3)


@query("cube_counts", "select organism, platform, count(*) as n from meta group by cube (organism, platform)", "meta")
def cube_counts(b):
    """A32."""
    return b.meta.cube("organism", "platform").agg(F.count("*").alias("n"))
