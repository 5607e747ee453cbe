import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkfen.functions import columns as c
from sparkfen.functions import hashing, special
from sparkfen.operators import clusters, filters, intervals, similarity, sketches, statistics
from sparkfen.operators.graph import connected_components
from sparkfen.sources import readers, sinks


def test_murmur_known_values():
    assert hashing.murmur3_low64([b""], 0)[0] == 0
    assert hashing.murmur3_low64([b"hello"], 0)[0] == 0xCBD8A7B341BD9B02
    assert sketches.threshold(0.001) == 18446744073709552


def test_murmur_is_independent_of_batching():
    texts = [bytes([i % 251]) * (i % 40) for i in range(200)]
    assert hashing.murmur3_low64(texts).tolist() == [hashing.murmur3_low64([t])[0] for t in texts]


@pytest.mark.parametrize("r, n, p", [(0.5, 30, 0.0048996), (0.0, 10, 1.0), (1.0, 10, 0.0)])
def test_p_of_r(r, n, p):
    assert special.p_of_r(r, n) == pytest.approx(p, abs=1e-5)


def test_tails():
    assert special.p_of_chi2(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert special.p_of_chi2(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-9)
    odds, p = special.fisher_exact(8, 2, 1, 5)
    assert odds == 20 and p == pytest.approx(0.03496503496503495)


@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6)), min_size=2, max_size=40))
@settings(max_examples=60, deadline=None)
def test_kendall_against_pairs(pairs):
    x, y = map(np.array, zip(*pairs))
    con = dis = tx = ty = 0
    for i in range(len(x)):
        for j in range(i):
            a, b = np.sign(x[i] - x[j]), np.sign(y[i] - y[j])
            con, dis, tx, ty = con + (a * b > 0), dis + (a * b < 0), tx + (a != 0), ty + (b != 0)
    want = (con - dis) / math.sqrt(tx * ty) if tx and ty else math.nan
    got = special.kendall_tau_b(x, y)
    assert got == pytest.approx(want) or (math.isnan(got) and math.isnan(want))


def test_distance_correlation_of_a_line():
    x = np.arange(20.0)
    assert special.distance_correlation(x, 3 * x + 1) == pytest.approx(1.0)


def test_linkage_heights():
    d = np.array([[0, 1, 4, 5], [1, 0, 4, 5], [4, 4, 0, 2], [5, 5, 2, 0]], float)
    assert [h for _, _, h in clusters.linkage(d)] == [1.0, 2.0, 4.5]


def test_components_of_random_graphs(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_columns(spark):
    r = spark.createDataFrame([("ACGTT", 10.0, None)], "s string, x double, n string").select(
        c.reverse_complement(F.col("s")), c.canonical(F.lit("TTTA")), c.kmers(F.lit("acgt"), 3), c.kmers(F.lit("a"), 3), c.gc_fraction(F.col("s")), c.longest_run(F.lit("AACCCG")),
        c.right_closed(F.col("x"), (0, 10, 20), ("low", "high")), c.missing_as_na(F.col("n")), c.leading_zeros(F.lit(-1).cast("long")), c.unsigned(F.lit(-1).cast("long")).cast("string"),
    ).first()
    assert list(r) == ["AACGT", "TAAA", ["ACG", "CGT"], [], 0.4, 3, "low", "NA", 0, "18446744073709551615"]
    p = spark.range(1).select(c.point_of_ewkb(F.lit(readers.ewkb(-122.25, 37.5))).alias("p")).first().p
    assert (p.lon, p.lat) == (-122.25, 37.5)


def test_filter_language(spark):
    df = spark.createDataFrame([("a", 5.0), (None, 7.0), ("b", None)], "k string, v double")
    keep = lambda *t: df.filter(filters.predicate(df, t)).count()
    assert (keep("k!=a"), keep("v>=5"), keep("v<=5", "k=a"), keep("zz=1"), keep("k>x"), keep()) == (2, 2, 1, 3, 3, 3)
    assert filters.parse("a>=3") == ("a", ">=", 3.0) and filters.parse("a") is None


def test_intervals(spark):
    df = spark.createDataFrame([(1, 1, 5), (1, 6, 8), (1, 20, 12), (2, 3, 3)], "k int, s long, e long")
    assert sorted(map(tuple, intervals.coverage(df, "k").collect())) == [(1, 2, 17, 9), (2, 1, 1, 1)]


def test_fdr_is_monotone(spark):
    t = spark.createDataFrame([(float(p),) for p in (0.01, 0.04, 0.03, 0.5)], "p double")
    rows = sorted((r.p, r.p_fdr) for r in statistics.corrected(t).collect())
    assert [q for _, q in rows] == pytest.approx([0.04, 4 / 75, 4 / 75, 0.5])


def test_sketch_estimates(spark):
    rows = spark.range(3000).select((F.col("id") % 2).alias("sample_id"), F.xxhash64((F.col("id") / 2).cast("long")).alias("hash")).distinct()
    mh = sketches.min_hash(rows, 64)
    a, b = (mh.filter(F.col("sample_id") == k).select("idx", F.col("hash").alias(f"h{k}")) for k in (0, 1))
    assert a.join(b, "idx").filter("h0 = h1").count() == 64
    assert sketches.bottom_k(rows, 7).groupBy("sample_id").count().filter("count = 7").count() == 2
    assert sketches.capacities(3, 0.5) == [2, 4, 8]


def test_search_of_empty_sets(spark):
    empty = spark.createDataFrame([], "sample_id long, hash long")
    assert similarity.similar_pairs(empty, 0.5).count() == 0 and similarity.identical_groups(empty).count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">s1 ka:f:32.5 x\nACGT\nAC\n>s2\nTT\n")
    assert [tuple(r) for r in readers.fasta(spark, str(tmp_path / "a.fa")).select("seq_id", "ka", "seq").collect()] == [("s1", 32.5, "ACGTAC"), ("s2", None, "TT")]
    (tmp_path / "a.fq").write_text("@r1 x\nACG\n+\nIII\n@r2\nTT\n+\nII\n")
    assert [r.seq for r in readers.fastq(spark, str(tmp_path / "a.fq")).collect()] == ["ACG", "TT"]
    (tmp_path / "l.txt").write_text("# no\n\nHomo sapiens \nx\n")
    assert [r.value for r in readers.list_file(spark, str(tmp_path / "l.txt")).collect()] == ["Homo sapiens", "x"]
    np.save(tmp_path / "m.npy", np.array([[0, 2.0], [3.0, 0]]))
    assert sorted(map(tuple, readers.matrix(spark, str(tmp_path / "m.npy")).collect())) == [(0, 1, 2.0), (1, 0, 3.0)]
    (tmp_path / "c.json").write_text('{"component_1": ["a", "b"], "component_2": []}')
    assert readers.component_json(spark, str(tmp_path / "c.json")).count() == 2
    (tmp_path / "s.sig").write_text('[{"name": "x", "signatures": [{"ksize": 31, "seed": 42, "max_hash": 100, "mins": [1, 18446744073709551615], "md5sum": "q"}]}]')
    assert sorted(r.hash for r in readers.signatures(spark, str(tmp_path / "s.sig"), 31).collect()) == [-1, 1]
    (tmp_path / "b.txt").write_text("Query= q1 x\n\nLength=9\n\n> s1\n Score = 5\n Identities = 8/9 (88%)\n\nQuery  3  ACGT  6\nSbjct  1  ACGT  4\n")
    assert [tuple(r) for r in readers.blast(spark, str(tmp_path / "b.txt")).collect()] == [("q1", "s1", 8, 9, 3, 6)]
    (tmp_path / "y").mkdir()
    (tmp_path / "y" / "alpha_2019.csv").write_text("accession,taxa_coverage_0_5,taxa_coverage_1\na,3,2\n")
    d = readers.yearly_csv(spark, str(tmp_path / "y"))
    assert d.first().release_year == 2019 and readers.coverage_columns(d.columns) == ["taxa_coverage_1", "taxa_coverage_0_5"]


def test_sketch_files(spark, tmp_path):
    df = spark.createDataFrame([(1, 5), (1, -1), (2, 7)], "sample_id long, hash long")
    header = sinks.sketch_header("FracMinHash", 31, 42, scale=0.001, threshold=18446744073709552)
    assert header == ["# sketch_version=1", "# algo=FracMinHash", "# kmer_size=31", "# hash_seed=42", "# hash_function=MurmurHash3_x64_128_low64", "# params.scale=0.001", "# params.threshold=18446744073709552", "# fields: hash"]
    lines = [r.value for r in sinks.sketch_lines(df, header).filter("sample_id = 1").orderBy("part").collect()]
    assert lines == [*header, "5", "18446744073709551615"]
    sinks.write_sketches(df, str(tmp_path / "sk"), header)
    back = readers.sketch_text(spark, str(tmp_path / "sk" / "sample_id=1")).collect()
    assert [r.fields for r in back] == [["5"], ["18446744073709551615"]] and back[0].params["params.scale"] == "0.001"
    geom = spark.createDataFrame([(1, 2, -1, 3, 4), (1, 1, 9, 8, 1)], "sample_id long, bucket long, hash long, tail long, freq long")
    made = sinks.sketch_lines(geom, sinks.sketch_header("MaxGeom", 31, 42, b=4, w=12), ("bucket", "hash", "tail", "freq")).orderBy("part").collect()
    assert [r.value for r in made][-3:] == ["# fields: bucket_index,h,hprime,freq", "1,9,8,1", "2,18446744073709551615,3,4"]
    one, other = (dict(x[2:].split("=") for x in sinks.sketch_header("MaxGeom", k, 42, b=4, w=12)[:-1]) for k in (31, 21))
    assert sinks.incompatible(one, dict(one)) is None and sinks.incompatible(one, other) == "kmer_size"
    assert sinks.incompatible(one, one | {"params.w": "11"}) == "params.w" and sinks.incompatible(one, one | {"algo": "BottomK"}) == "algo"
    with pytest.raises(ValueError):
        sinks.sketch_header("BottomK", 31, 42, b=4)


def test_hash_files(spark, tmp_path):
    rng = random.Random(3)
    values = [rng.randrange(2**64) for _ in range(5000)] + [0, 2**63, 2**64 - 1, 1, 1]
    signed = [(v - 2**64 if v >= 2**63 else v,) for v in values]
    df = spark.createDataFrame(signed, "hash long").repartition(4)
    for _ in range(2):
        sinks.sorted_hashes(df, str(tmp_path / "h"))
        files = sorted((tmp_path / "h").glob("*.bin"))
        assert np.concatenate([np.fromfile(f, "<u8") for f in files]).tolist() == sorted(set(values)) and not list((tmp_path / "h").glob("_*"))
    got = readers.hash_file(spark, str(tmp_path / "h"), numbers=700)
    assert got.rdd.getNumPartitions() >= 8 and sorted(r.hash for r in got.collect()) == sorted({s[0] for s in signed})
    (tmp_path / "odd.bin").write_bytes(b"123")
    with pytest.raises(Exception, match="multiple of 8"):
        readers.hash_file(spark, str(tmp_path / "odd.bin")).count()
    with pytest.raises(Exception, match="files already"):
        df.select("hash").write.format("hashfile").mode("append").save(str(tmp_path / "h"))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 5), (1, -1), (2, 7)], "sample_id long, hash long")
    sinks.csv_report(df, str(tmp_path / "c"))
    assert readers.csv_table(spark, str(tmp_path / "c")).count() == 3 and len(list((tmp_path / "c").glob("*.csv"))) == 1
    with pytest.raises(ValueError):
        sinks.csv_report(df, str(tmp_path / "c"), most=2)
    assert sinks.auto_name("x", test=True, limit=None, where="a b") == "x_test-True_where-a_b"
    with pytest.raises(Exception, match="max_hash"):
        sinks.signature_records(df, 31, 100).collect()
    sinks.parquet(df, str(tmp_path / "p"), {"hash": "h", "sample_id": "s"}, by=["s"])
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "p")).select("h", "s").collect())) == [(-1, 1), (5, 1), (7, 2)]
    sinks.by_key(df, str(tmp_path / "k"), "sample_id")
    assert sorted(p.name for p in (tmp_path / "k").glob("sample*")) == ["sample_id=1", "sample_id=2"] and readers.csv_table(spark, str(tmp_path / "k"), sep="\t").count() == 3
    sinks.nested_json(df.selectExpr("sample_id", "struct(hash) as s"), str(tmp_path / "j"))
    assert {r.s.hash for r in spark.read.json(str(tmp_path / "j")).collect()} == {5, -1, 7}
    sinks.fasta(spark.createDataFrame([("s1", "n", "ACGT")], "seq_id string, note string, seq string"), str(tmp_path / "f"))
    assert [tuple(r) for r in readers.fasta(spark, str(tmp_path / "f")).select("header", "seq").collect()] == [("s1 n", "ACGT")]
    members = spark.createDataFrame([(1, 1), (2, 1), (7, 7)], "node long, component long")
    lines = sinks.components_json(members)
    assert {(r.component, r.json) for r in lines.collect()} == {(1, "[1,2]"), (7, "[7]")} and sorted(map(tuple, sinks.components_of_json(lines).collect())) == [(1, 1), (1, 2), (7, 7)]
    assert sorted(map(tuple, sinks.membership(members).collect())) == [(1, 1, 2), (2, 1, 2), (7, 7, 1)]
    assert sinks.invalid_components(spark.createDataFrame([("a", 1), ("", 2), (None, 3), ("b", None)], "component string, member int")).count() == 3


def test_stages_and_views(spark, tmp_path):
    spark.sql("drop table if exists stage_of_tests")
    made = []
    build = lambda: made.append(1) or spark.range(3)
    assert sinks.stage(spark, "stage_of_tests", build).count() == 3 and sinks.stage(spark, "stage_of_tests", build).count() == 3 and len(made) == 1
    sinks.append(spark.range(2), "stage_of_tests")
    assert spark.table("stage_of_tests").count() == 5 and sinks.stage(spark, "stage_of_tests", build, resume=False).count() == 3
    spark.sql("drop table stage_of_tests")
    readers.attach(spark, {"seen": spark.range(4)})
    assert spark.sql("select count(*) as n from seen").first().n == 4
    readers.detach(spark, "seen")
    assert not spark.catalog.tableExists("seen")


def test_more_readers(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "r1_hits.csv").write_text("a,b\n1,2\n")
    (tmp_path / "d" / "r2_hits.csv").write_text("a,b\n3,4\n")
    assert sorted((r.key, r.a) for r in readers.keyed_csv(spark, str(tmp_path / "d"), "_hits.csv").collect()) == [("r1", 1), ("r2", 3)]
    (tmp_path / "n.tsv").write_text("x\t1\ny\t2\n")
    assert [tuple(r) for r in readers.csv_table(spark, str(tmp_path / "n.tsv"), "k string, v int", header=False, sep="\t").collect()] == [("x", 1), ("y", 2)]
    (tmp_path / "c.json").write_text('[{"set_id": "right", "name": "a", "ksize": 31}, {"set_id": "right", "name": "b", "ksize": null}, {"set_id": "right", "name": "c", "ksize": 21}, {"set_id": "left", "name": "d", "ksize": 31}]')
    assert [r.name for r in readers.config_json(spark, str(tmp_path / "c.json"), ksize=31).collect()] == ["a", "b"] and readers.config_json(spark, str(tmp_path / "c.json")).count() == 3
    (tmp_path / "m.csv").write_text("id,x,y\na,0,1.5\nb,2,\n")
    assert sorted(map(tuple, readers.labelled_matrix(spark, str(tmp_path / "m.csv")).collect())) == [("a", "y", 1.5), ("b", "x", 2.0)]
    np.savez(tmp_path / "m.npz", indptr=np.array([0, 1, 1, 3]), indices=np.array([2, 0, 1]), data=np.array([1.0, 2.0, 3.0]))
    assert sorted(map(tuple, readers.matrix(spark, str(tmp_path / "m.npz")).collect())) == [(0, 2, 1.0), (2, 0, 2.0), (2, 1, 3.0)]
    many = '[{"name": "x", "signatures": [{"ksize": 21, "max_hash": 18446744073709552, "mins": [9]}, {"ksize": 31, "max_hash": 18446744073709552, "mins": [1]}, {"ksize": 31, "max_hash": 18446744073709552, "mins": [2]}]}]'
    (tmp_path / "s.sig").write_text(many)
    assert sorted(r.hash for r in readers.signatures(spark, str(tmp_path / "s.sig"), 31, scaled=1000).collect()) == [1, 2]
    for ksize, scaled, message in ((31, 100, "scale"), (51, 1000, "ksize")):
        with pytest.raises(Exception, match=message):
            readers.signatures(spark, str(tmp_path / "s.sig"), ksize, scaled).collect()
    (tmp_path / "bad.fq").write_text("@r1\nACG\nIII\n")
    with pytest.raises(Exception, match="malformed"):
        readers.fastq(spark, str(tmp_path / "bad.fq")).collect()
    line = "ATOM      1  CA  ALA A   1      11.104   6.134  -6.504  1.00 {:5.2f}           C"
    pdb = spark.createDataFrame([("f", line.format(90)), ("f", line.format(90).replace("A   1 ", "A   2 ").replace("90.00", "70.00")), ("f", "TER")], "file string, value string")
    assert readers.plddt(pdb).first().mean_plddt == 80.0


def test_experiment(spark):
    """Estimates of a whole set have no error; those of 64 permutations have the error that theory gives."""
    exact = lambda sets: sketches.by_pair(similarity.similar_classes(sets, similarity.classes(sets), 0.01))
    sizes, seeds = [(50, 25, 25), (80, 0, 20)], range(8)
    got = {r.n: r for r in sketches.experiment(spark, sizes, seeds, exact).collect()}
    assert (got[50].mean, got[50].mse, got[80].mean, got[80].n_seeds) == (pytest.approx(0.5), pytest.approx(0.0), pytest.approx(0.8), 8)

    def minimal(sets):
        m = sketches.min_hash(sets, 64)
        return sketches.by_pair(sketches.min_hash_similarities(m, m, 64))

    near = {r.n: r for r in sketches.experiment(spark, sizes, seeds, minimal).collect()}
    assert abs(near[50].mean - 0.5) < 0.1 and near[50].mse < 4 * 0.25 / 64 and abs(near[80].mean - 0.8) < 0.1


def test_hash_values():
    """Known values: SplitMix64 from state 0, its mixing step, and a 31-mer of a published collision table."""
    assert [int(x) for x in hashing.splitmix64(np.array([0], np.uint64))] == [0xE220A8397B1DCDAF]
    assert int(hashing.mix64(np.uint64(0x9E3779B97F4A7C15))) == 0xE220A8397B1DCDAF
    assert int(hashing.mix64(np.uint64(0))) == 0


def test_classes_of_equal_sets(spark):
    rng = random.Random(6)
    base = [set(rng.sample(range(300), rng.randrange(5, 40))) for _ in range(12)]
    sets = {i: base[i % 12] if i < 36 else base[i % 12] - {min(base[i % 12])} | {1000 + i} for i in range(60)}
    df = spark.createDataFrame([(i, h) for i, v in sets.items() for h in v], "sample_id long, hash long")
    members = {r.sample_id: (r.rep, r.n) for r in similarity.classes(df).collect()}
    assert members == {i: (min(j for j in sets if sets[j] == v), len(v)) for i, v in sets.items()}
    reps = sorted({r for r, _ in members.values()})
    for t in (0.3, 0.8, 1.0):
        want = {(a, b): j for a in reps for b in reps if a < b and (j := len(sets[a] & sets[b]) / len(sets[a] | sets[b])) >= t}
        got = similarity.similar_pairs(df, t).collect()
        assert {(r.a, r.b): r.jaccard for r in got if r.b in reps} == pytest.approx(want)
        assert {(r.a, r.b) for r in got if r.b not in reps} == {(r, i) for i, (r, _) in members.items() if r != i}


def test_ranks(spark):
    from sparkfen.operators import ranks

    rng = random.Random(4)
    rows = [(rng.choice("ab"), i, float(rng.randrange(12))) for i in range(500)] + [("c", 900, 2.0), ("a", 901, None)]
    df = spark.createDataFrame(rows, "k string, i long, x double")
    by = {k: sorted(x for g, _, x in rows if g == k and x is not None) for k in "abc"}
    got = {r.i: r.r for r in ranks.mid_ranks(df, ["k"], "x", "r").collect()}
    assert got == {i: None if x is None else sum(y < x for y in by[k]) + (by[k].count(x) + 1) / 2 for k, i, x in rows}
    q = {r.k: (r.n, r.q0, r.q1) for r in ranks.percentiles(df, ["k"], "x", (0.25, 0.9)).collect()}
    assert q == {k: (len(v), *np.percentile(v, [25, 90])) for k, v in by.items()}
    order = sorted((x if x is not None else -1.0, i) for k, i, x in rows if k == "a")
    at = {r.i: r.p for r in ranks.ordinal(df, ["k"], "x", "p", then=["i"]).filter("k = 'a'").collect()}
    assert at == {i: n for n, (_, i) in enumerate(order, 1)}
    total = {r.i: r.s for r in ranks.ordinal(df, ["k"], "i", "s", weight=F.col("i")).filter("k = 'b'").collect()}
    ids = sorted(i for k, i, _ in rows if k == "b")
    assert total == dict(zip(ids, np.cumsum(ids).tolist()))


def test_tables_of_two_by_two(spark):
    """Yates's correction and tails, with values of a statistics package."""
    rows = [("a", "x")] * 10 + [("a", "y")] * 20 + [("b", "x")] * 30 + [("b", "y")] * 15
    r = statistics.contingency(spark.createDataFrame(rows, "g string, h string"), "g", "h").first()
    assert (r.n, r.dof) == (75, 1) and r.chi2 == pytest.approx(75 * (abs(10 * 15 - 20 * 30) - 37.5) ** 2 / (30 * 45 * 40 * 35)) and r.p == pytest.approx(math.erfc(math.sqrt(r.chi2 / 2)))
    assert special.p_of_z(1.959963984540054) == pytest.approx(0.05)


def test_group_comparison(spark):
    rows = [(True, float(v)) for v in (19, 22, 16, 29, 24)] + [(False, float(v)) for v in (20, 11, 17, 12)] + [(None, 3.0)]
    r = statistics.group_comparison(spark.createDataFrame(rows, "g boolean, x double"), F.col("g"), ["x"]).first()
    assert (r.n1, r.n2, r.u, r.median_in, r.median_out, r.direction) == (5, 4, 17.0, 22.0, 14.5, "higher") and r.p == pytest.approx(0.11134688653314041)


def test_stream_equals_batch(spark, tmp_path):
    from sparkfen.operators.timeline import hash_life
    from sparkfen.plans.bindings import Bound
    from sparkfen.streaming.incremental import keep_life

    b = Bound(spark, "/root/testdata/sf0.001")
    dated = b.sig.join(b.years.withColumnRenamed("acc", "sample_id"), "sample_id").select("min_hash", "release_year")
    for i in range(3):
        dated.filter(F.pmod(F.xxhash64("min_hash", "release_year"), F.lit(3)) == i).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{i}"))
    stream = spark.readStream.schema(dated.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    keep_life(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    last = max((tmp_path / "out").iterdir(), key=lambda p: int(p.name[1:]))
    assert sorted(map(tuple, spark.read.parquet(str(last)).collect())) == sorted(map(tuple, hash_life(b.sig, b.years).collect()))
