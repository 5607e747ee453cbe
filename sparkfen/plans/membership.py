"""Queries on set membership."""

from pyspark.sql import functions as F

from sparkfen.operators import membership as m
from sparkfen.operators import ranks
from sparkfen.plans.catalog import query
from sparkfen.session import scratch_path
from sparkfen.sources import readers, sinks, sorted_files


@query("dmi", "select accession, total_hashes, unmapped_hashes, mapped_hashes, round(dmi, 9) as dmi from dmi", "dmi")
def dmi(b):
    """D09, J03, A03."""
    return m.unmapped_index(b.sig, b.ref).withColumn("dmi", F.round("dmi", 9))


@query("dmi_host_filtered", """with f as (select sample_id, host.hash is not null as h, ref.hash is not null as r from sig left join host on host.hash = min_hash left join ref on ref.hash = min_hash),
a as (select sample_id as accession, count(*) as n, count_if(h) as hn, count_if(not h and r) as mp, count_if(h and r) as hr from f group by 1)
select accession, n as total_hashes_original, hn as host_hashes, round(hn::double / n, 9) as host_fraction, n - hn as total_hashes_host_filtered, n - hn - mp as unmapped_hashes_host_filtered, mp as mapped_hashes_host_filtered,
round(case when n > hn then (n - hn - mp)::double / (n - hn) end, 9) as dmi_host_filtered, round(case when n > hn then mp::double / (n - hn) end, 9) as mapped_fraction_host_filtered, hr as host_in_reference,
round(case when mbases > 0 then n::double / mbases end, 6) as total_hashes_original_per_mb, round(case when mbases > 0 then hn::double / mbases end, 6) as host_hashes_per_mb, round(case when mbases > 0 then (n - hn - mp)::double / mbases end, 6) as unmapped_hashes_host_filtered_per_mb,
round(case when mbases > 0 then mp::double / mbases end, 6) as mapped_hashes_host_filtered_per_mb from a left join meta on acc = accession""", "sig", "ref", "host", "meta")
def dmi_host_filtered(b):
    """D10, J04, A04, P03."""
    d = m.host_filtered_index(b.sig, b.ref, b.host).join(b.meta.select(F.col("acc").alias("accession"), "mbases"), "accession", "left")
    d = m.per_megabase(d, ["total_hashes_original", "host_hashes", "unmapped_hashes_host_filtered", "mapped_hashes_host_filtered"]).drop("mbases")
    return d.select(*[F.round(c, 6 if c.endswith("_mb") else 9).alias(c) if k == "double" else c for c, k in d.dtypes])


@query("dark_hash_export", "select sample_id, min_hash, ref.hash is null as is_dark from sig left join ref on ref.hash = min_hash where min_hash not in (select hash from host)", "sig", "ref", "host")
def dark_hash_export(b):
    """D25, J05, O04."""
    return m.export_hashes(b.sig, b.ref, b.host)


@query("dark_hash_reconciliation", "with f as (select sample_id, count(*) filter (ref.hash is null) as n from sig left join ref on ref.hash = min_hash where min_hash not in (select hash from host) group by 1), x as (select sample_id, count(*) filter (ref.hash is null) as n from sig left join ref on ref.hash = min_hash group by 1) select sample_id, coalesce(f.n, 0) as found, coalesce(x.n, 0) as expected from f full join x using (sample_id) where coalesce(f.n, 0) <> coalesce(x.n, 0)", "sig", "ref", "host")
def dark_hash_reconciliation(b):
    """Exported counts against the index without host removal: the samples that lost dark hashes to the host."""
    found = m.export_hashes(b.sig, b.ref, b.host).groupBy("sample_id").agg(F.count_if("is_dark").alias("n"))
    expected = m.unmapped_index(b.sig, b.ref).select(F.col("accession").alias("sample_id"), F.col("unmapped_hashes").alias("n"))
    return m.reconciled(found, expected, "sample_id", "n")


@query("dmi_one_sample", "select * from dmi where accession = 7", "dmi")
def dmi_one_sample(b):
    """One sample by parameter."""
    b.sig.createOrReplaceTempView("sig_of_one")
    one = b.spark.sql("select * from sig_of_one where sample_id = :id", args={"id": 7})
    return m.unmapped_index(one, b.ref)


@query("dmi_by_lookup", "select accession, total_hashes, unmapped_hashes, mapped_hashes, round(dmi, 9) as dmi from dmi", "dmi")
def dmi_by_lookup(b):
    """All samples against the reference in a sorted binary file, which is searched and not shuffled."""
    path = scratch_path(b.spark, "reference")
    sinks.sorted_hashes(b.ref, path)
    return m.unmapped_index(b.sig, sorted_files.present(b.sig, path, "min_hash")).withColumn("dmi", F.round("dmi", 9))


@query("reference_merge", "select distinct hash from lines", "lines")
def reference_merge(b):
    """Sorted runs of the sets kept apart by return flag, merged into one without a sort."""
    runs = [scratch_path(b.spark, f"run-{f}") for f in ("A", "N", "R")]
    for f, path in zip(("A", "N", "R"), runs):
        sinks.sorted_hashes(b.lines.filter(F.col("l_returnflag") == f), path)
    out = scratch_path(b.spark, "merged")
    sorted_files.merge_runs(b.spark, runs, out)
    return readers.hash_file(b.spark, out)


@query("reference_union", "select distinct hash from lines", "lines")
def reference_union(b):
    """The union of sets kept apart by return flag."""
    return m.union_of([b.lines.filter(F.col("l_returnflag") == f) for f in ("A", "N", "R")])


@query("set_overlap", "select (select count(*) from ref) as n_a, (select count(*) from host) as n_b, (select count(*) from ref semi join host using (hash)) as n_both, (select count(*) from ref anti join host using (hash)) as n_only_a, (select count(*) from host anti join ref using (hash)) as n_only_b, (select count(*) from (select hash from ref union select hash from host)) as n_union", "ref", "host")
def set_overlap(b):
    """O05, O06, J14."""
    return m.overlap(b.ref, b.host)


@query("global_distinct", "select count(distinct sample_id) as n_samples, count(distinct min_hash) as n_distinct from sig where sample_id in (select acc from years where release_year >= 1998)", "sig", "years")
def global_distinct(b):
    """D30, A24, J06."""
    return m.global_distinct(b.sig, b.years.filter("release_year >= 1998").select(F.col("acc").alias("sample_id")))


@query("overlap_rate", "select sample_id, count(*) as n, count_if(hash is not null) as n_in, round(count_if(hash is not null)::double / count(*), 9) as rate from sig left join host on hash = min_hash group by 1", "sig", "host")
def overlap_rate(b):
    """A28, D27."""
    return m.overlap_rate(b.sig, b.host).withColumn("rate", F.round("rate", 9))


@query("assembly_verdict", """with f as (select (ref.hash is null) as dark, (host.hash is not null) as hit from sig left join ref on ref.hash = min_hash left join host on host.hash = min_hash),
r as (select count_if(dark and hit)::double / count_if(dark) as dark_rate, count_if(not dark and hit)::double / count_if(not dark) as mapped_rate from f)
select round(dark_rate, 9) as dark_rate, round(mapped_rate, 9) as mapped_rate, round(mapped_rate / dark_rate, 6) as ratio, case when mapped_rate / dark_rate >= 10 then 'strong' when mapped_rate / dark_rate >= 3 then 'moderate' else 'weak' end as verdict from r""", "sig", "ref", "host")
def assembly_verdict(b):
    """Rates by hash class, their ratio and a verdict."""
    f = m.flagged(m.flagged(b.sig, b.ref, "r"), b.host, "h")
    r = f.agg(m.ratio(F.count_if(~F.col("r") & F.col("h")), F.count_if(~F.col("r"))).alias("d"), m.ratio(F.count_if(F.col("r") & F.col("h")), F.count_if(F.col("r"))).alias("m"))
    x = F.col("m") / F.col("d")
    return r.select(F.round("d", 9).alias("dark_rate"), F.round("m", 9).alias("mapped_rate"), F.round(x, 6).alias("ratio"), F.when(x >= 10, "strong").when(x >= 3, "moderate").otherwise("weak").alias("verdict"))


@query("dmi_distribution", "select case when dmi < 0.2 then '0.0-0.2' when dmi < 0.4 then '0.2-0.4' when dmi < 0.6 then '0.4-0.6' when dmi < 0.8 then '0.6-0.8' else '0.8-1.0' end as bucket, count(*) as n, round(avg(dmi), 9) as mean_dmi from dmi group by 1", "dmi")
def dmi_distribution(b):
    """D12, A17."""
    d = m.unmapped_index(b.sig, b.ref)
    cut = F.when(F.col("dmi") < 0.2, "0.0-0.2").when(F.col("dmi") < 0.4, "0.2-0.4").when(F.col("dmi") < 0.6, "0.4-0.6").when(F.col("dmi") < 0.8, "0.6-0.8").otherwise("0.8-1.0")
    return d.groupBy(cut.alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg("dmi"), 9).alias("mean_dmi"))


@query("dmi_ranking", "select organism, count(*) as n, round(avg(dmi), 9) as mean_dmi, round(median(dmi), 9) as median_dmi, round(sum(unmapped_hashes)::double / sum(total_hashes), 9) as pooled from dmi join meta on acc = accession group by 1 having count(*) >= 10 order by mean_dmi desc, organism limit 10", "dmi", "meta")
def dmi_ranking(b):
    """D12, A18, A29, F12, L03."""
    d = m.unmapped_index(b.sig, b.ref).join(b.meta, F.col("acc") == F.col("accession"))
    a = d.groupBy("organism").agg(F.count("*").alias("n"), F.round(F.avg("dmi"), 9).alias("mean_dmi"), F.round(m.ratio(F.sum("unmapped_hashes"), F.sum("total_hashes")), 9).alias("pooled"))
    medians = ranks.percentiles(d, ["organism"], "dmi", (0.5,)).select("organism", F.round("q0", 9).alias("median_dmi"))
    return ranks.joined(a.filter("n >= 10"), medians, ["organism"]).orderBy(F.desc("mean_dmi"), "organism").limit(10)
