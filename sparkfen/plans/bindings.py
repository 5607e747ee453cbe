"""The driver's tables seen as the engine's inputs, in Spark and, under the same names, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfen.functions import hashing
from sparkfen.session import spread, table


class Bound:
    """The inputs of one folder; each property is a lazy frame."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def t(self, name: str) -> DataFrame:
        """A raw table."""
        return table(self.spark, self.dir, name)

    @property
    def lines(self) -> DataFrame:
        """lineitem with the hash of each line."""
        return self.t("lineitem").withColumn("hash", F.col("l_partkey") * 1000 + F.col("l_suppkey"))

    @property
    def sig(self) -> DataFrame:
        """(sample_id, min_hash)."""
        return self.lines.select(F.col("l_orderkey").alias("sample_id"), F.col("hash").alias("min_hash")).distinct()

    @property
    def ref(self) -> DataFrame:
        """(hash) of returned lines."""
        return self.lines.filter("l_returnflag = 'R'").select("hash").distinct()

    @property
    def host(self) -> DataFrame:
        """(hash) of one brand's parts."""
        return self.lines.join(self.t("part").filter("p_brand = 'Brand#12'"), F.col("l_partkey") == F.col("p_partkey"), "left_semi").select("hash").distinct()

    @property
    def years(self) -> DataFrame:
        """(acc, release_year)."""
        return self.t("orders").select(F.col("o_orderkey").alias("acc"), F.year("o_orderdate").cast("long").alias("release_year"))

    @property
    def meta(self) -> DataFrame:
        """(acc, platform, organism, center, bioproject, mbases, release_year)."""
        o = self.t("orders").join(self.t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(self.t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        return o.select(
            F.col("o_orderkey").alias("acc"), F.col("o_orderpriority").alias("platform"), F.col("c_mktsegment").alias("organism"), F.col("n_name").alias("center"),
            F.col("o_custkey").alias("bioproject"), (F.col("o_totalprice") / 1000).alias("mbases"), F.year("o_orderdate").cast("long").alias("release_year"),
        )

    @property
    def profiles(self) -> DataFrame:
        """(sample_id, organism_id, tax_id, cov): the coverage as whole hundredths."""
        o = self.lines.join(self.t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        return o.select(F.col("o_custkey").alias("sample_id"), F.col("l_partkey").alias("organism_id"), F.col("l_suppkey").alias("tax_id"), F.round(F.col("l_discount") * 100).cast("int").alias("cov"))

    @property
    def ko(self) -> DataFrame:
        """(sample_id, ko_id, abundance)."""
        o = self.lines.join(self.t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(self.t("part").select("p_partkey", "p_type", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
        return o.groupBy(F.col("o_custkey").alias("sample_id"), F.concat("p_type", "p_brand").alias("ko_id")).agg(F.sum("l_quantity").alias("abundance"))

    @property
    def xy(self) -> DataFrame:
        """(acc, platform, organism, x, y) for correlations: quantity and price of an order."""
        sums = self.lines.groupBy(F.col("l_orderkey").alias("acc")).agg(F.sum("l_quantity").alias("x"), F.round(F.sum("l_extendedprice"), 2).alias("y"))
        return sums.join(self.meta.select("acc", "platform", "organism"), "acc")

    @property
    def shingle_sets(self) -> DataFrame:
        """(sample_id, hashes): the distinct three-word shingles of documents, hashed by md5, as ascending lists."""
        words = F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z0-9]+", " "))
        d = spread(self.t("documents").select("doc_id", "text")).select(F.col("doc_id").alias("sample_id"), words.alias("words"))
        return hashing.shingle_sets(d, 3)

    @property
    def shingles(self) -> DataFrame:
        """(sample_id, hash): the same, a row a shingle."""
        return self.shingle_sets.select("sample_id", F.explode("hashes").alias("hash"))

    @property
    def groups(self) -> DataFrame:
        """(component_id, sample_id, lang, source, quality): documents that share their text, at least two."""
        d = self.t("documents").select("doc_id", "lang", "source", F.md5("text").alias("h"))
        g = d.groupBy("h").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n")).filter("n > 1")
        return d.join(g, "h").join(self.t("labels").select("doc_id", "quality"), "doc_id", "left").select("component_id", F.col("doc_id").alias("sample_id"), "lang", "source", "quality")


def surrogate(text):
    """A 60-bit hash that SQL has too: the first 15 hexadecimal digits of md5."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


SQL = {
    "lines": "select *, l_partkey * 1000 + l_suppkey as hash from lineitem",
    "sig": "select distinct l_orderkey as sample_id, hash as min_hash from lines",
    "ref": "select distinct hash from lines where l_returnflag = 'R'",
    "host": "select distinct hash from lines where l_partkey in (select p_partkey from part where p_brand = 'Brand#12')",
    "years": "select o_orderkey as acc, year(o_orderdate)::bigint as release_year from orders",
    "meta": "select o_orderkey as acc, o_orderpriority as platform, c_mktsegment as organism, n_name as center, o_custkey as bioproject, o_totalprice / 1000 as mbases, year(o_orderdate)::bigint as release_year from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey",
    "profiles": "select o_custkey as sample_id, l_partkey as organism_id, l_suppkey as tax_id, round(l_discount * 100)::int as cov from lineitem join orders on l_orderkey = o_orderkey",
    "ko": "select o_custkey as sample_id, p_type || p_brand as ko_id, sum(l_quantity) as abundance from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey group by all",
    "xy": "select s.acc, platform, organism, x, y from (select l_orderkey as acc, sum(l_quantity) as x, round(sum(l_extendedprice), 2) as y from lineitem group by all) s join meta on meta.acc = s.acc",
    "words": "select doc_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')), ' ') as w from documents",
    "shingles": "select sample_id, ('0x' || substr(md5(g), 1, 15))::bigint as hash from (select distinct doc_id as sample_id, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) as g from words where len(w) >= 3)",
    "groups": "select component_id, d.doc_id as sample_id, lang, source, quality from documents d join (select md5(text) as h, min(doc_id) as component_id from documents group by 1 having count(*) > 1) g on md5(d.text) = g.h left join labels l on l.doc_id = d.doc_id",
    "life": "select min_hash, min(release_year) as birth_year, max(release_year) as death_year from sig join years on acc = sample_id group by 1",
    "novelty": "select sample_id, release_year, count(*) as total_hashes, count_if(birth_year = release_year) as new_hashes, count_if(birth_year = release_year)::double / count(*) as fraction_new from sig join years on acc = sample_id join life using (min_hash) group by all",
    "lifecounts": "select birth_year, death_year, count(*) as n_hashes, death_year - birth_year as duration from life group by all",
    "dmi": "select sample_id as accession, count(*) as total_hashes, count_if(hash is null) as unmapped_hashes, count_if(hash is not null) as mapped_hashes, count_if(hash is null)::double / count(*) as dmi from sig left join ref on hash = min_hash group by 1",
}
NEEDS = {
    "sig": ("lines",), "ref": ("lines",), "host": ("lines",), "xy": ("meta",), "shingles": ("words",), "life": ("sig", "years"), "novelty": ("sig", "years", "life"), "lifecounts": ("life",), "dmi": ("sig", "ref"),
}


def sql(body: str, *names: str) -> str:
    """body with the named inputs, and what they need, in front of it. body may go on with further ones after a comma."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, ()):
            add(n)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    head = ", ".join(f"{n} as ({SQL[n]})" for n in order)
    recursive = "recursive " if "recursive:" in body else ""
    body = body.replace("recursive:", "").replace("count_if(", "count(*) filter (")
    head = head.replace("count_if(", "count(*) filter (")
    return (f"with {recursive}{head} {body}" if head else body) if not body.lstrip().startswith("with ") or not head else f"with {recursive}{head}, {body.lstrip()[5:]}"
