from weft.operators.skew import heavy_groups
from weft.operators.versions import latest


def test_latest(spark):
    rows = [(1, 5, None, "a"), (1, 5, 1, "b"), (1, None, 9, "z"), (2, 1, 1, "x"), (2, 1, 1, "x"), (None, 9, 9, "q")]
    df = spark.createDataFrame(rows, "key int, u int, l int, v string")
    assert sorted(map(tuple, latest(df, "key", ["u", "l"], ["v"]).collect())) == [(1, "b"), (2, "x")]
    assert latest(df.limit(0), "key", ["u"], ["v", "u"]).columns == ["key", "v", "u"]


def test_heavy_groups_are_bounded(spark):
    counts = spark.createDataFrame([(f"k{i}", 10 + i) for i in range(100)], "k string, n bigint")
    assert heavy_groups(counts, ["k"], 1000) is None
    big = heavy_groups(counts, ["k"], 50).collect()
    assert sorted(r.n for r in big) == list(range(50, 110)) and {r.parts for r in big} == {1, 2, 3}
    assert sorted(r.n for r in heavy_groups(counts, ["k"], 50, most=7).collect()) == list(range(103, 110))
