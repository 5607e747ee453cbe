"""Field summaries and comparison of components against counting by hand."""

from collections import Counter

from sparkfen.operators import drilldown

ROWS = [(1, "a", "x", "2019-01-02"), (1, "a", None, "1999"), (1, "b", "x", None), (1, None, "y", "2021/5"), (2, "b", None, "n/a"), (2, "c", None, ""), (3, None, None, "2005")]


def frame(spark):
    return spark.createDataFrame(ROWS, "g long, p string, `q.r` string, d string")


def test_distributions(spark):
    got = {(r.g, r.field, r.place): (r.size, r.n_filled, r.n_values, r.value, r.n, r.coverage, r.share) for r in drilldown.distributions(frame(spark), "g", ["p", "q.r"], 1).collect()}
    assert got == {(1, "p", 1): (4, 3, 2, "a", 2, 0.75, 2 / 3), (1, "q.r", 1): (4, 3, 2, "x", 2, 0.75, 2 / 3), (2, "p", 1): (2, 2, 2, "b", 1, 1.0, 0.5)}


def test_many_values_keep_their_places(spark):
    values = [i % 700 if i % 3 else i % 7 for i in range(4000)]
    df = spark.createDataFrame([(9, v) for v in values], "g long, v long")
    got = [(r.value, r.n) for r in drilldown.distributions(df, "g", ["v"], 25).orderBy("place").collect()]
    assert got == sorted(((str(v), n) for v, n in Counter(values).items()), key=lambda p: (-p[1], p[0]))[:25]


def test_comparison(spark):
    """A value that only one side has, a field that one side has not, a group without values."""
    got = {(r.g, r.field, r.value): (r.n, r.share, r.n_one, r.share_one, r.common) for r in drilldown.compared(frame(spark), "g", ["p", "q.r"], 1).collect()}
    nothing = (0, 0.0)
    assert got == {
        (2, "p", "a"): (*nothing, 2, 0.5, 0.25), (2, "p", "b"): (1, 0.5, 1, 0.25, 0.25), (2, "p", "c"): (1, 0.5, *nothing, 0.25),
        (2, "q.r", "x"): (*nothing, 2, 0.5, 0.0), (2, "q.r", "y"): (*nothing, 1, 0.25, 0.0),
        (3, "p", "a"): (*nothing, 2, 0.5, 0.0), (3, "p", "b"): (*nothing, 1, 0.25, 0.0), (3, "q.r", "x"): (*nothing, 2, 0.5, 0.0), (3, "q.r", "y"): (*nothing, 1, 0.25, 0.0),
    }
    assert {(r.n_one, r.common) for r in drilldown.compared(frame(spark), "g", ["p"], 77).collect()} == {(0, 0.0)}


def test_years(spark):
    assert {tuple(r) for r in drilldown.years(frame(spark), "g", ["d"]).collect()} == {(1, 2019, 2021, 2, 2), (3, 2005, 2005, 0, 1)}
