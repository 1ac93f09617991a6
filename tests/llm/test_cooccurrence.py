import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from weft.llm.cooccurrence import _sorted_runs, book_numbers, pairs

SCHEMA = "basket bigint, items array<bigint>, n int, code string"


def brute(rows, least):
    baskets = {}
    for b, items in rows:
        if b is not None and (own := {i for i in items or () if i is not None}):
            baskets.setdefault(b, set()).update(own)
    one = Counter(i for v in baskets.values() for i in v)
    two = Counter(p for v in baskets.values() for p in combinations(sorted(v), 2))
    n = len(baskets)
    return {(a, b): (c, one[a], one[b], n, c * n / (one[a] * one[b]), (c + 0.5) * (n - one[a] - one[b] + c + 0.5) / ((one[a] - c + 0.5) * (one[b] - c + 0.5))) for (a, b), c in two.items() if c >= least}


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3)
    return {(r.item_a, r.item_b): tuple(r)[2:] for r in pairs(df, "basket", F.col("items"), **options).collect()}


@pytest.mark.parametrize("options", [{}, {"min_together": 3}, {"min_together": 3, "broadcast_items": 2}, {"wide_basket": 3}, {"min_together": 2, "wide_basket": 4}, {"broadcast_items": 3}])
def test_agrees_with_brute_force(spark, options):
    rnd = random.Random(8)
    rows = [(rnd.choice([None, *range(60)]), [rnd.choice([0, 1, 1, 7, (1 << 31) - 1, None, *range(30)]) for _ in range(rnd.randint(0, 7))]) for _ in range(120)]
    rows += [(99, None), (98, []), (97, list(range(40)))]
    got, want = run(spark, rows, **options), brute(rows, options.get("min_together", 1))
    assert set(got) == set(want)
    assert all(got[p] == pytest.approx(want[p]) for p in want)


def test_books(spark):
    df = spark.createDataFrame([(" B4|b17 |b004||x1|b4 ",), (None,), ("",)], "books string")
    assert [r[0] for r in df.select(book_numbers(F.col("books"))).collect()] == [[4, 17], None, []]


def test_bad_items_and_empty(spark):
    assert run(spark, []) == {}
    with pytest.raises(Exception, match="2\\^31"):
        run(spark, [(1, [-1, 2])])


def test_small_runs():
    import pyarrow as pa

    batch = pa.record_batch([pa.array([[1, 2, 3], [1, 2]], pa.list_(pa.int64())), pa.array([0, 0], pa.int32()), pa.array([3, 2], pa.int32())], names=["items", "first", "last"])
    total = Counter()
    for out in _sorted_runs(1)(iter([batch])):
        total.update(dict(zip(*(c.to_pylist() for c in out.columns))))
    assert total == {(1 << 32) | 2: 2, (2 << 32) | 3: 1, (1 << 32) | 3: 1}
