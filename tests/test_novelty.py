"""Novelty of samples in parts whose number follows the rows, and its yearly summary from one reading."""

from sparkfen.operators import timeline


def inputs(spark):
    lines = spark.createDataFrame([(i % 40, i * 7919 % 90) for i in range(600)] + [(41, 5), (41, 5), (42, None), (43, 1)], "sample_id long, min_hash long").repartition(3)
    years = spark.createDataFrame([(i, None if i % 9 == 4 else 1990 + i % 7) for i in range(43)], "acc long, release_year long")
    return lines, years


def test_parts_follow_the_rows(spark):
    """The same rows as with the life of the hashes joined, in as many parts as asked; hashes that are null are of no use."""
    lines, years = inputs(spark)
    known = lines.filter("min_hash is not null")
    sig = known.distinct()
    want = sorted(map(repr, timeline.sample_novelty(sig, years, timeline.hash_life(sig, years)).collect()))
    for rows, part in ((604, 10), (604, 500_000)):
        got = timeline.own_novelty(lines, years, rows, part)
        assert sorted(map(repr, got.collect())) == want and len(want) == 41
    plan = timeline.own_novelty(lines, years, 1_000_000_000)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(", 2000") >= 3


def test_stats_are_read_once(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for g in batches:
            made.add(len(g))
            yield g

    lines, years = inputs(spark)
    stats = timeline.own_novelty(lines, years, 604)
    assert timeline.yearly_novelty(stats.mapInPandas(counted, stats.schema)).count() == 8 and made.value == 41
