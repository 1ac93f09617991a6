from pathlib import Path

from pyspark.sql import functions as F

from weft.operators.skew import copied, heavy_groups, part_of, salted, without
from weft.plans.stage import shared_folder, temporary, written


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def counts(df):
    return df.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def test_parts_cover_all_rows_and_null_is_a_key(spark):
    data = [("x", 1, i) for i in range(25)] + [(None, 1, i) for i in range(12)] + [("y", None, i) for i in range(3)] + [("x", 2, 0)]
    df = spark.createDataFrame(data, "a string, b int, i int")
    heavy = heavy_groups(counts(df), ["a", "b"], 10)
    assert rows(heavy.select("a", "b", "n", "parts")) == [("x", 1, 25, 3), (None, 1, 12, 2)] and part_of(heavy) == 5
    hot = salted(df, heavy, ["a", "b"], "nr", by=F.xxhash64("i"))
    assert rows(without(df, heavy, ["a", "b"]).unionAll(hot.select("a", "b", "i"))) == rows(df)
    assert {(r.a, r.salt) for r in hot.collect()} <= {("x", 0), ("x", 1), ("x", 2), (None, 0), (None, 1)}
    other = spark.createDataFrame([("x", 1, "one"), (None, 1, "two"), ("y", None, "three")], "a string, b int, w string")
    assert copied(other, heavy, ["a", "b"]).count() == 5
    assert rows(hot.where("a = 'x'").join(copied(other, heavy, ["a", "b"]), ["a", "b", "salt"]).groupBy("w").count()) == [("one", 25)]


def test_equal_rows_are_spread(spark):
    df = spark.createDataFrame([("x", 1, 0)] * 40, "a string, b int, i int").coalesce(1)
    hot = salted(df, heavy_groups(counts(df), ["a", "b"], 10), ["a", "b"])
    assert rows(hot.groupBy("salt").count()) == [(i, 10) for i in range(4)]


def test_bounded_and_empty(spark):
    df = spark.createDataFrame([(str(i % 5), 1, i) for i in range(50)], "a string, b int, i int")
    assert rows(heavy_groups(counts(df), ["a", "b"], 10, most=2).select("a")) == [("0",), ("1",)]
    assert heavy_groups(counts(df), ["a", "b"], 11) is None and part_of(None) == 0
    assert rows(without(df, None, ["a"])) == rows(df)


def test_temporary_tables_go_with_their_block(spark):
    kept = written(spark.range(3), "kept")
    files = lambda: {p for p in Path(shared_folder(spark), "weft").iterdir()}
    before = files()
    with temporary():
        assert written(spark.range(5), "inside").count() == 5 and len(files()) == len(before) + 1
    assert files() == before and kept.count() == 3
