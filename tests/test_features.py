import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from weft.operators.features import event_features, slugs

T0 = datetime(2020, 1, 1)
SCHEMA = "who string, status string, id bigint, s timestamp_ntz, e timestamp_ntz, entity string, kind int"


def brute(rows):
    out, seen = {}, set()
    for who, status, i, s, e, *_ in rows:
        if who is None:
            continue
        status = status or "none"
        own = out.setdefault(who, {})
        if i is not None and (who, status, i) in seen:
            continue
        seen.add((who, status, i))
        n, last, total = own.get(status, (0, None, 0.0))
        length = 0.0
        if s is not None and e is not None:
            length = max(0.0, ((e + timedelta(days=1) if e < s else e) - s).total_seconds())
        own[status] = (n + 1, s if last is None else last if s is None else max(last, s), total + length)
    return out


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA)
    return event_features(df, F.col("who"), F.col("status"), "id", "s", "e", **options)


def same(got, rows):
    want = brute(rows)
    types = sorted({t for v in want.values() for t in v})
    assert {r.entity for r in got} == set(want) and len(got) == len(want)
    for r in got:
        for t, slug in zip(types, slugs(types)):
            assert (r[f"{slug}_n"], r[f"{slug}_last"], r[f"{slug}_total_s"]) == want[r.entity].get(t, (0, None, 0.0))


def test_streaming_salting_and_chunks_agree_with_brute_force(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(1200):
        s = T0 + timedelta(minutes=rnd.randint(0, 9000))
        e = s + timedelta(minutes=rnd.randint(-30, 60))
        who = "hot" if i % 3 == 0 else f"e{rnd.randint(0, 40)}"
        rows.append((who, rnd.choice(["ok", "failed/1", "failed 1", None]), rnd.choice([i, i, i, None]), rnd.choice([s, s, None]), rnd.choice([e, e, None]), "x", 1))
        if rnd.random() < 0.1:
            rows.append(rows[-1])
    for options in ({}, {"salt_rows": 50, "chunk": 3}):
        same(run(spark, rows, **options).collect(), rows)


def test_defined_cases(spark):
    assert run(spark, []).columns == ["entity"] and run(spark, []).collect() == []
    assert run(spark, [(None, "ok", 1, T0, T0, "x", 1)]).collect() == []
    assert slugs(["a b", "a/b", "c"]) == ["a_b", "a_b_2", "c"]
    with pytest.raises(ValueError):
        run(spark, [("a", str(i), i, T0, T0, "x", 1) for i in range(5)], max_types=4)
