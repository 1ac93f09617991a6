import math
import random

import numpy as np
import pytest

from weft.llm.percentiles import decode, encode, encoded, percentiles, summary, union_of

PS = {"low": 0.1, "mid": 0.5, "top": 0.99}


def brute(rows):
    groups = {}
    for a, b, v in rows:
        if v is not None and v == v:
            groups.setdefault((a, b), []).append(v + 0.0)
    return {k: (len(v), *(sorted(v)[max(1, math.ceil(round(p * len(v), 9))) - 1] for p in PS.values())) for k, v in groups.items()}


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "a string, b int, v double, code string, n int")


def got(df):
    return {(r.a, r.b): (r.n, r.low, r.mid, r.top) for r in df.collect()}


def data():
    rnd = random.Random(6)
    rows = [("hot", 1, rnd.choice([rnd.gauss(0, 1e3), 5.0, -0.0, 1e12])) for _ in range(900)]
    rows += [(rnd.choice(["x", "y", None]), rnd.choice([1, None, *range(40)]), rnd.choice([None, float("nan"), -1.5, float("inf"), rnd.random()])) for _ in range(600)]
    return rows


def test_codes_keep_the_order():
    v = np.array([-np.inf, -1e300, -2.0, -5e-324, -0.0, 0.0, 5e-324, 1.0, np.inf])
    assert (np.diff(encode(v)) >= 0).all() and encode(v)[4] == encode(v)[5]
    assert (decode(encode(v)) == v).all()


@pytest.mark.parametrize("heavy_rows", [10**6, 100, 4])
def test_exact(spark, heavy_rows):
    rows = data()
    out = percentiles(encoded(frame(spark, rows), ["a", "b"], "v"), ["a", "b"], PS, heavy_rows=heavy_rows)
    assert got(out) == brute(rows)
    assert {r.max_rel_error for r in out.collect()} == {0.0}


def test_loads_combine(spark):
    rows = data()
    parts = [summary(frame(spark, rows[i::3]), ["a", "b"], "v") for i in range(3)]
    assert got(percentiles(union_of(parts), ["a", "b"], PS)) == brute(rows)


def test_bounded_error(spark):
    rows = [("a", 1, random.Random(i).uniform(1, 1e6)) for i in range(500)]
    coarse = summary(frame(spark, rows), ["a", "b"], "v", drop_bits=46)
    assert coarse.count() < 64 * 20
    out = percentiles(coarse, ["a", "b"], PS, drop_bits=46).first()
    for x, y in zip((out.low, out.mid, out.top), brute(rows)["a", 1][1:]):
        assert abs(x - y) <= out.max_rel_error * y


def test_empty(spark):
    assert got(percentiles(encoded(frame(spark, []), ["a", "b"], "v"), ["a", "b"], PS)) == {}
