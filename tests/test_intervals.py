import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from weft.operators.intervals import IntervalMap, gaps, periods, spans

T0 = datetime(2020, 1, 1)


def brute(rows):
    out = {}
    for k in {r[0] for r in rows}:
        merged = []
        for s, e in sorted((s, e) for x, s, e in rows if x == k):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out[k] = [tuple(m) for m in merged]
    return out


def test_map_takes_insertions_in_any_order():
    rnd = random.Random(1)
    for _ in range(200):
        rows = [("a", s := rnd.randint(0, 60), s + rnd.randint(0, 6)) for _ in range(30)]
        m = IntervalMap()
        for _, s, e in rows:
            m.insert(s, e)
        assert list(zip(m.starts, m.ends)) == brute(rows)["a"]


def test_spans_wrap_and_leave_out(spark):
    df = spark.createDataFrame(
        [("a", T0, T0 + timedelta(hours=1), 1), ("a", T0 + timedelta(hours=23), T0 + timedelta(hours=2), 2), (None, T0, T0, 3), ("a", None, T0, 4), ("a", T0, None, 5), ("a", T0 + timedelta(days=9), T0, 6)],
        "who string, s timestamp_ntz, e timestamp_ntz, entity int",
    )
    got = spans(df, F.col("who"), "s", "e").collect()
    assert sorted((r.e - r.s) / 3.6e9 for r in got) == [1, 3]
    assert len(spans(df, F.col("who"), "s", "e", None).collect()) == 1


def test_slices_agree_with_brute_force(spark):
    rnd = random.Random(2)
    rows = [("hot", s := rnd.randint(0, 4000), s + rnd.choice([0, 1, 2, 3, 300 if rnd.random() < 0.01 else 4])) for _ in range(900)]
    rows += [(f"e{rnd.randint(0, 20)}", s := rnd.randint(0, 300), s + rnd.randint(0, 9)) for _ in range(400)]
    for extra in ([], [("hot", 500, 3300)], [("hot", 0, 9000)]):
        every = rows + extra
        df = spark.createDataFrame(every, "entity string, s bigint, e bigint")
        want = brute(every)
        for slice_rows in (10**9, 100):
            got = {}
            for r in periods(df, slice_rows).collect():
                got.setdefault(r.entity, []).append((r.period_start, r.period_end))
            assert {k: sorted(v) for k, v in got.items()} == want
            gap = sorted(map(tuple, gaps(df, slice_rows).collect()))
            assert gap == sorted((k, a[1], b[0]) for k, v in want.items() for a, b in zip(v, v[1:]))


def test_crowded_starts_are_spread(spark):
    """Most spans of an entity start within a moment, many at once."""
    rnd = random.Random(3)
    rows = [("hot", s := 10**9 + rnd.randint(0, 40) * 3, s + rnd.randint(0, 1)) for _ in range(400)] + [("hot", s := rnd.randint(0, 10**12), s + 5) for _ in range(50)]
    df = spark.createDataFrame(rows, "entity string, s bigint, e bigint")
    want = brute(rows)["hot"]
    assert sorted((r.period_start, r.period_end) for r in periods(df, 50).collect()) == want
    assert sorted((r.gap_start, r.gap_end) for r in gaps(df, 50).collect()) == [(a[1], b[0]) for a, b in zip(want, want[1:])]


def test_map_keeps_the_gaps(spark):
    m = IntervalMap([0, 20], [10, 30])
    assert list(m.gaps()) == [(10, 20)]
    m.insert(12, 15)
    assert list(m.gaps()) == [(10, 12), (15, 20)]
    m.insert(15, 20)
    assert list(m.gaps()) == [(10, 12)] and m.before == [None, 10]


def test_empty(spark):
    df = spark.createDataFrame([], "entity string, s bigint, e bigint")
    assert gaps(df).collect() == [] and periods(df).collect() == []
