import random

import pytest

from weft.llm.topn import top_n


def brute(rows, n):
    out = set()
    groups = {}
    for g, s, i in rows:
        if None not in (g, s, i) and s == s:
            groups.setdefault(g, []).append((-(s + 0.0), i))
    for g, own in groups.items():
        out |= {(g, -s, i, k + 1) for k, (s, i) in enumerate(sorted(own)[:n])}
    return out


@pytest.mark.parametrize("options", [{}, {"chunk": 20}, {"chunk": 20, "flush_rows": 15}, {"chunk": 20, "group_rows": 15, "bounds": 3}])
def test_agrees_with_brute_force(spark, options):
    rnd = random.Random(7)
    rows = [("hot" if i % 3 == 0 else rnd.choice(["a", "b", "", None, *map(str, range(50))]), rnd.choice([None, float("nan"), float("inf"), -0.0, 0.0, 5.0, 5.0, rnd.random()]), i) for i in range(900)]
    rows += [("hot", 5.0, None)]
    df = spark.createDataFrame([(*r, "x", True) for r in rows], "dept string, pay double, id bigint, g string, bound boolean").repartition(5)
    got = {(r.dept, r.pay, r.id, r.place) for r in top_n(df, "dept", "pay", "id", 5, **options).collect()}
    assert got == brute(rows, 5)


def test_repeats_and_empty(spark):
    df = spark.createDataFrame([("a", 1.0, 1)] * 4, "dept string, pay double, id bigint")
    assert [r.place for r in top_n(df, "dept", "pay", "id", 3).collect()] == [1, 2, 3]
    assert top_n(df.limit(0), "dept", "pay", "id", 3).collect() == []
