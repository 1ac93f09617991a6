import random
from datetime import datetime, timedelta

from weft.operators.orphans import Reference, orphan_counts, orphan_references, orphan_rows

DAY = datetime(2021, 1, 1)
FACT = "orderid bigint, productid string, ts timestamp_ntz, note string, begin string"
DIM = "product_id string, created timestamp_ntz, deleted timestamp_ntz, productid string, key string"


def at(n):
    return DAY + timedelta(days=n)


def rows(df):
    return sorted(map(tuple, df.collect()))


def sides(spark, facts, dims):
    f = spark.createDataFrame([(*r, "x", "y") for r in facts], FACT)
    d = spark.createDataFrame([(*r, "other", None) for r in dims], DIM)
    return f, [Reference("productid", d, "product_id", "created", "deleted")]


def test_defined_cases(spark):
    facts = [(1, "P1", at(5)), (1, "P1", at(5)), (2, " p001 ", at(5)), (3, "P9", at(5)), (4, None, at(5)), (5, " ", at(5)), (6, "", at(5)), (7, "P1", None), (8, "P2", at(1)), (9, "P2", at(25)), (10, "tbd", at(3)), (11, "P0", at(3))]
    dims = [("P1", at(0), None), ("P1", at(0), None), ("P2", at(2), at(10)), ("p02", at(8), at(20)), (None, at(0), None), ("tbd", None, None), ("P0", at(0), at(0))]
    f, refs = sides(spark, facts, dims)
    found = orphan_references(f, refs, "orderid", "ts")
    assert rows(found.select("id", "ref_field", "key")) == [(3, "productid", "p9"), (7, "productid", "p1"), (8, "productid", "p2"), (9, "productid", "p2"), (10, "productid", "tbd"), (11, "productid", "p0")]


def test_empty_tables(spark):
    f, refs = sides(spark, [], [("P1", at(0), None)])
    assert rows(orphan_references(f, refs, "orderid", "ts")) == []
    assert rows(orphan_counts(f, refs, "orderid", "ts")) == []
    f, refs = sides(spark, [(1, "P1", at(5))], [])
    assert len(rows(orphan_references(f, refs, "orderid", "ts"))) == 1
    assert [tuple(r)[2:] for r in orphan_counts(f, refs, "orderid", "ts").collect()] == [(1, 1)]


def test_heavy_and_light_keys_agree_with_brute_force(spark):
    rnd = random.Random(3)
    facts = [(i, "P1" if i % 3 == 0 else f"P{rnd.randint(2, 30)}", at(rnd.randint(0, 90))) for i in range(1500)]
    dims = [(f"P{k}", at(s := rnd.randint(0, 60)), None if rnd.random() < 0.3 else at(s + rnd.randint(0, 40))) for k in range(1, 26) for _ in range(3)]
    want = {o for o, k, t in facts if not any(k == d and c <= t and (e is None or e > t) for d, c, e in dims)}
    f, refs = sides(spark, facts, dims)
    # all groups by broadcast; the large ones by broadcast and the rest shuffled; all shuffled; large keys by salt
    for options in ({}, {"heavy_rows": 20, "broadcast_rows": 40}, {"heavy_rows": 10**6, "broadcast_rows": 0}, {"heavy_rows": 20, "salt_rows": 20, "broadcast_rows": 3}):
        found = orphan_references(f, refs, "orderid", "ts", **options)
        assert {r.id for r in found.collect()} == want
        counts = orphan_counts(f, refs, "orderid", "ts", **options)
        assert sum(r.n_orphans for r in counts.collect()) == len(want)


def test_a_hot_key_is_not_shuffled(spark):
    facts = [(i, "P1", at(5 + i % 5)) for i in range(200)] + [(1000 + i, f"P{i}", at(5)) for i in range(2, 60)]
    f, refs = sides(spark, facts, [("P1", at(7), None)])
    found = orphan_rows(f, refs, "orderid", "ts", heavy_rows=100, broadcast_rows=20)
    assert "BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()
    assert found.where("key = 'p1'").count() == 80 and found.count() == 138


def test_ids_that_are_null_or_come_again(spark):
    facts = [(None, "P9", at(5)), (None, "P8", at(6)), (1, "P9", at(5)), (1, "P8", at(6)), (1, "P9", at(40))]
    f, refs = sides(spark, facts, [("P1", at(0), None)])
    found = orphan_references(f, refs, "orderid", "ts").select("id", "key", "period")
    assert sorted(map(tuple, found.collect()), key=repr) == [(1, "p8", DAY), (None, "p8", DAY)]
    counts = {r.period: (r.n_orphans, r.n_keys) for r in orphan_counts(f, refs, "orderid", "ts").collect()}
    assert counts == {DAY: (3, 2), datetime(2021, 2, 1): (1, 1)}
