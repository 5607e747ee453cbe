"""Queries on single relational operators: projections, filters, joins, sorts, samples and set operations."""

from pyspark.sql import functions as F

from sparkfen.functions import columns as c
from sparkfen.operators import filters as f
from sparkfen.operators import ranks
from sparkfen.operators.membership import per_megabase
from sparkfen.plans.bindings import surrogate
from sparkfen.plans.catalog import query
from sparkfen.plans.timeline import rounded


@query("filter_dsl", "select acc, organism, platform, round(mbases, 6) as mbases from meta where organism = 'BUILDING' and mbases > 100 and (platform <> '5-LOW' or platform is null)", "meta")
def filter_dsl(b):
    """F08, P12, F01."""
    tests = ["organism=BUILDING", "mbases>100", "platform!=5-LOW", "nothing=1", "organism>a"]
    return rounded(b.meta.filter(f.predicate(b.meta, tests)).select("acc", "organism", "platform", "mbases"), 6)


@query("quality_thresholds", "select acc from meta where mbases >= 50 and lower(organism) in ('building', 'machinery') and release_year in (1996, 1997) and bioproject is not null", "meta")
def quality_thresholds(b):
    """F03, F07, F09, F10, F11."""
    return f.select_samples(b.meta, {"mbases": 50, "absent": 3}, "release_year in (1996, 1997) and bioproject is not null", ["Building", "MACHINERY", "building"]).select("acc")


@query("semi_join_list", "select * from sig where sample_id in (select o_orderkey from orders where o_orderstatus = 'F')", "sig")
def semi_join_list(b):
    """A long list of ids as a semi join."""
    return b.sig.join(b.t("orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("sample_id")), "sample_id", "left_semi")


@query("unnest_parameter", "select s.sample_id, min_hash from sig s join (select unnest([1, 2, 3, 7]) as sample_id) p on p.sample_id = s.sample_id", "sig")
def unnest_parameter(b):
    """S05, X19."""
    ids = b.spark.range(1).select(F.explode(F.array(*[F.lit(i).cast("long") for i in (1, 2, 3, 7)])).alias("sample_id"))
    return b.sig.join(F.broadcast(ids), "sample_id")


@query("projection_rename", "select acc as accession, upper(organism) as organism, round(mbases * 2, 6) as double_mb, replace(platform, '-', '/') as platform, translate('a/b c', '/ ', '__') as slug from meta", "meta")
def projection_rename(b):
    """P01, P11, X01, X02, S07."""
    d = b.meta.drop("center").withColumnRenamed("acc", "accession")
    return d.select("accession", F.upper("organism").alias("organism"), F.round(F.col("mbases") * 2, 6).alias("double_mb"), F.replace("platform", F.lit("-"), F.lit("/")).alias("platform"), c.slug(F.lit("a/b c")).alias("slug"))


@query("derived_indices", "select acc, round(x / y, 12) as efficiency, round(case when y > 0 then x / y end * 1e6, 6) as scaled, x > 100 as large, (case when y > 100000 then 1 else 0 end)::int as flag from xy", "xy")
def derived_indices(b):
    """P05, P06, P07, P08."""
    e = F.when(F.col("y") > 0, F.col("x") / F.col("y"))
    return b.xy.select("acc", F.round(e, 12).alias("efficiency"), F.round(e * 1e6, 6).alias("scaled"), (F.col("x") > 100).alias("large"), F.when(F.col("y") > 100000, 1).otherwise(0).alias("flag"))


@query("composite_key", "select platform || ' | ' || organism as combo, concat_ws('|', 'platform=' || left(platform, 50), 'organism=' || left(organism, 50)) as key, count(*) as n from meta group by all", "meta")
def composite_key(b):
    """P09, P10."""
    return b.meta.groupBy(F.concat_ws(" | ", "platform", "organism").alias("combo"), c.signature(["platform", "organism"]).alias("key")).agg(F.count("*").alias("n"))


@query("pivot_counts", "select release_year, count(*) filter (o_orderstatus = 'F') as f, count(*) filter (o_orderstatus = 'O') as o, count(*) filter (o_orderstatus = 'P') as p from orders join years on acc = o_orderkey group by 1", "years")
def pivot_counts(b):
    """P15, P17."""
    d = b.t("orders").join(b.years, F.col("acc") == F.col("o_orderkey")).groupBy("release_year").pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)
    return d.select("release_year", F.col("F").alias("f"), F.col("O").alias("o"), F.col("P").alias("p"))


@query("melt", "select acc, name, round(value, 6) as value from (unpivot (select acc, x, y from xy) on x, y into name name value value) where value is not null", "xy")
def melt(b):
    """P14, X20."""
    return b.xy.select("acc", "x", "y").unpivot(["acc"], ["x", "y"], "name", "value").filter(F.col("value").try_cast("double").isNotNull()).withColumn("value", F.round("value", 6))


@query("explode_nest", "select component_id, count(*) as n, string_agg(sample_id::varchar, ',' order by sample_id) as members from groups group by 1", "groups")
def explode_nest(b):
    """P18, P19, K09."""
    g = b.groups.groupBy("component_id").agg(F.sort_array(F.collect_list("sample_id")).alias("m"))
    again = g.select("component_id", F.posexplode("m").alias("pos", "sample_id")).groupBy("component_id").agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "sample_id"))), lambda s: s["sample_id"].cast("string")), ",").alias("members"))
    return again


@query("attributes_map", "select event_id, event_type, event_type || '-x' as biome from events")
def attributes_map(b):
    """The first of repeated keys wins; dropped keys stay out."""
    kv = lambda k, v: F.struct(F.lit(k).alias("k"), v.alias("v"))
    attrs = F.array(kv("primary_search", F.lit("no")), kv("type", F.col("event_type")), kv("type", F.lit("later")), kv("environmental_x", F.lit("no")), kv("Environment", F.concat("event_type", F.lit("-x"))))
    d = b.t("events").withColumn("a", attrs)
    return d.select("event_id", F.element_at(c.attributes_map(F.col("a")), "type").alias("event_type"), c.biome_of(F.col("a")).alias("biome"))


@query("left_chain", "select o_orderkey, c_name, n_name, r_name as region_loc from orders left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey")
def left_chain(b):
    """J08, J09, S02."""
    d = b.t("orders").join(b.t("customer"), F.col("o_custkey") == F.col("c_custkey"), "left").join(b.t("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(b.t("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return d.select("o_orderkey", "c_name", "n_name", F.col("r_name").alias("region_loc"))


@query("json_lateral", "select key, count(*) as n from (select unnest(json_keys(props)) as key from events) group by 1")
def json_lateral(b):
    """J15."""
    b.t("events").createOrReplaceTempView("events_of_json")
    return b.spark.sql("select key, count(*) as n from events_of_json lateral view explode(json_object_keys(props)) t as key group by key")


@query("json_number", "select event_id, json_extract_string(props, '$.k')::double as k from events")
def json_number(b):
    """X16, X20."""
    return b.t("events").select("event_id", F.get_json_object("props", "$['k']").try_cast("double").alias("k"))


@query("sorted_top", "select acc, organism, round(mbases, 6) as mbases from meta order by organism desc, mbases, acc limit 50", "meta")
def sorted_top(b):
    """L01, L02, L03."""
    return rounded(b.meta.orderBy(F.desc("organism"), "mbases", "acc").limit(50).select("acc", "organism", "mbases"), 6)


@query("systematic_sample", "select acc from (select acc, row_number() over (partition by platform order by acc) as i from meta) where i % 10 = 0", "meta")
def systematic_sample(b):
    """L06."""
    return ranks.ordinal(b.meta.select("platform", "acc"), ["platform"], "acc", "i").filter("i % 10 = 0").select("acc")


@query("bernoulli_sample", "select * from sig where ('0x' || substr(md5(concat_ws('-', 42, sample_id, min_hash)), 1, 15))::bigint % 1000 < 100", "sig")
def bernoulli_sample(b):
    """Each row by a seeded hash of its own."""
    return b.sig.filter(surrogate(F.concat_ws("-", F.lit(42), "sample_id", "min_hash")) % 1000 < 100)


@query("seeded_sample", "select acc from meta order by md5('42' || acc), acc limit 100", "meta")
def seeded_sample(b):
    """An exact number of rows by a seeded hash."""
    return b.meta.orderBy(F.md5(F.concat(F.lit("42"), F.col("acc").cast("string"))), "acc").limit(100).select("acc")


@query("set_operations", "select 'both' as kind, count(*) as n from (select hash from ref intersect select hash from host) union all select 'ref_only', count(*) from (select hash from ref except select hash from host) union all select 'all', count(*) from (select hash from ref union all select hash from host)", "ref", "host")
def set_operations(b):
    """O03, O04, O05."""
    n = lambda kind, d: d.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
    return n("both", b.ref.intersect(b.host)).union(n("ref_only", b.ref.subtract(b.host))).union(n("all", b.ref.unionByName(b.host)))


@query("merge_suffix", "select acc, round(mbases, 6) as mbases_x, round(mbases / 2, 6) as mbases_y from meta", "meta")
def merge_suffix(b):
    """The explicit form of clashing columns after a join, found again by first_present."""
    d = b.meta.select("acc", F.col("mbases").alias("mbases_x")).join(b.meta.select("acc", (F.col("mbases") / 2).alias("mbases_y")), "acc")
    assert c.first_present(d, ["mbases", "mbases_x", "mbases_y"]) == "mbases_x"
    return rounded(per_megabase(d, []), 6)


@query("drop_missing", "select doc_id, quality from documents left join labels using (doc_id) where quality is not null and lang is not null")
def drop_missing(b):
    """F18, X21."""
    return b.t("documents").join(b.t("labels"), "doc_id", "left").na.drop(subset=["quality", "lang"]).select("doc_id", "quality")
