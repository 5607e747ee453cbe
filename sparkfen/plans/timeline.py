"""Queries on time."""

from pyspark.sql import functions as F

from sparkfen.operators import timeline as t
from sparkfen.plans.catalog import query


def life(b):
    """hash_life of the bindings."""
    return t.hash_life(b.sig, b.years)


def _novelty(b):
    lines = b.lines.select(F.col("l_orderkey").alias("sample_id"), F.col("hash").alias("min_hash"))
    return t.own_novelty(lines, b.years, lines.count())


def rounded(df, digits=9):
    """Doubles rounded, so that the order of sums does not show."""
    return df.select(*[F.round(c, digits).alias(c) if k == "double" else c for c, k in df.dtypes])


@query("hash_life", "select * from life", "life")
def hash_life(b):
    """D01, J01, A02."""
    return life(b)


@query("hash_life_merged", "select * from life", "life")
def hash_life_merged(b):
    """D01 from two parts of the samples, as increments."""
    return t.merge_life(t.hash_life(b.sig, b.years.filter("release_year < 1998")), t.hash_life(b.sig, b.years.filter("release_year >= 1998")))


@query("sample_novelty", "select sample_id, release_year, total_hashes, new_hashes, round(fraction_new, 9) as fraction_new from novelty", "novelty")
def sample_novelty(b):
    """D02, J02, A03."""
    return rounded(_novelty(b))


@query("cumulative_by_year", "select birth_year as year, count(*) as new_hashes, sum(count(*)) over (order by birth_year rows between unbounded preceding and current row)::bigint as cumulative_hashes from life group by 1", "life")
def cumulative_by_year(b):
    """D03, W01."""
    return t.cumulative_by_year(life(b))


@query("yearly_novelty", "select release_year, count(*) as n_samples, round(avg(total_hashes), 9) as avg_total, round(avg(new_hashes), 9) as avg_new, quantile_cont(new_hashes::double, 0.25) as p25_new, quantile_cont(new_hashes::double, 0.5) as p50_new, quantile_cont(new_hashes::double, 0.75) as p75_new, round(quantile_cont(fraction_new, 0.25), 9) as p25_fraction, round(quantile_cont(fraction_new, 0.5), 9) as p50_fraction, round(quantile_cont(fraction_new, 0.75), 9) as p75_fraction, round(quantile_cont(fraction_new, 0.95), 9) as p95_fraction, round(avg(fraction_new), 9) as mean_of_ratios, round(sum(new_hashes)::double / sum(total_hashes), 9) as ratio_of_sums from novelty group by 1", "novelty")
def yearly_novelty(b):
    """D04, A09."""
    return rounded(t.yearly_novelty(_novelty(b)))


@query("life_counts", "select * from lifecounts", "lifecounts")
def life_counts(b):
    """D05, P07."""
    return t.life_counts(life(b))


KM = """with s as (select *, case when death_year < (select max(death_year) from lifecounts) then n_hashes else 0 end as gone from lifecounts),
e as (select {by} duration, sum(n_hashes)::bigint as exits, sum(gone)::bigint as events from s group by all),
r as (select *, sum(exits) over (partition by {part} order by duration rows between current row and unbounded following)::bigint as at_risk from e)
select {by} duration, at_risk, events, round(case when max((events = at_risk)::int) over w = 1 then 0.0::double else exp(sum(case when events < at_risk then ln(1 - events::double / at_risk) else 0 end) over w) end, 9) as survival from r
window w as (partition by {part} order by duration rows between unbounded preceding and current row)"""


@query("survival", KM.format(by="", part="1"), "lifecounts")
def survival(b):
    """D06, W02."""
    return rounded(t.survival(t.life_counts(life(b))))


@query("survival_by_birth", KM.format(by="birth_year,", part="birth_year"), "lifecounts")
def survival_by_birth(b):
    """D06, W02 by birth year."""
    return rounded(t.survival(t.life_counts(life(b)), ["birth_year"]))


@query("transience", "with m as (select max(death_year) as last from lifecounts) select sum(n_hashes)::bigint as n_hashes, coalesce(sum(n_hashes) filter (duration = 0), 0)::bigint as n_single_year, coalesce(sum(n_hashes) filter (duration > 0), 0)::bigint as n_multi_year, coalesce(sum(n_hashes) filter (death_year = last), 0)::bigint as n_persisting, round(sum(n_hashes) filter (duration = 0)::double / sum(n_hashes), 9) as single_share, round(sum(n_hashes) filter (death_year = last)::double / sum(n_hashes), 9) as persisting_share from lifecounts, m", "lifecounts")
def transience(b):
    """D07."""
    return rounded(t.transience(t.life_counts(life(b))))


@query("birth_death_grid", "select birth_year, death_year, round(log10(n_hashes + 1), 9) as log_n from lifecounts", "lifecounts")
def birth_death_grid(b):
    """P17."""
    return rounded(t.birth_death_grid(t.life_counts(life(b))))
