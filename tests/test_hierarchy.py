import random

import pytest

from weft.operators.hierarchy import cycles, descendants, hierarchy


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "id bigint, parent bigint")


def brute(pairs):
    parent = dict(sorted(pairs, key=lambda p: (p[1] is not None, p[1] or 0)))
    out = {}
    for x in parent:
        walk, here = [x], x
        while (up := parent[here]) is not None and up in parent and up not in walk:
            walk.append(up)
            here = up
        looped = parent[here] in walk
        on = looped and parent[here] == x
        out[x] = (None if looped else walk[::-1], min(walk) if on else None)
    return out


def check(spark, pairs):
    want = brute(pairs)
    nodes = hierarchy(edges(spark, pairs))
    got = {r.id: r for r in nodes.collect()}
    assert set(got) == set(want)
    below = {x: set() for x in want}
    for x, (path, _) in want.items():
        for a in path[:-1] if path else ():
            below[a].add(x)
    for x, (path, key) in want.items():
        r = got[x]
        assert r.cycle_key == key
        assert r.path == path
        assert r.root == (path[0] if path else None)
        assert r.depth == (len(path) - 1 if path else None)
        if path:
            assert r.n_descendants == len(below[x])
        if key is not None:
            assert r.n_descendants is None
    for finish_rows in (0, 30, 10_000):
        found = cycles(edges(spark, pairs), finish_rows=finish_rows)
        assert {r.id: r.cycle_key for r in found.collect()} == {x: k for x, (_, k) in want.items() if k is not None}
    assert {(r.ancestor, r.descendant, r.distance) for r in descendants(nodes).collect()} == {
        (a, x, len(p) - 1 - i) for x, (p, _) in want.items() if p for i, a in enumerate(p[:-1])
    }


def test_faults(spark):
    check(spark, [(1, None), (2, 1), (3, 2), (4, 99), (5, 5), (6, 5), (7, 8), (8, 9), (9, 7), (10, 9), (11, 10), (12, 13), (13, 12)])
    got = {r.id: r.missing_parent for r in hierarchy(edges(spark, [(1, None), (4, 99)])).collect()}
    assert got == {1: False, 4: True}


def test_empty_null_and_repeated(spark):
    assert hierarchy(edges(spark, [])).collect() == []
    assert cycles(edges(spark, [])).collect() == []
    assert [r.id for r in hierarchy(edges(spark, [(None, 1), (1, None), (1, None)])).collect()] == [1]


@pytest.mark.parametrize("seed", [1, 2])
def test_random_forests_with_chains_stars_and_cycles(spark, seed):
    rnd = random.Random(seed)
    pairs = [(i, i + 1 if i < 39 else None) for i in range(40)]  # a chain
    pairs += [(100 + i, 5) for i in range(60)]  # a star on it
    pairs += [(200 + i, 200 + (i + 1) % 17) for i in range(17)]  # a long cycle
    pairs += [(300 + i, rnd.choice([None, *range(0, 40), *range(200, 217), *range(300, 300 + i)])) for i in range(60)]
    check(spark, pairs)


def test_hubs_in_and_outside_the_table(spark):
    pairs = [(1, None), *((i, 1) for i in range(2, 60)), *((i, 99) for i in range(100, 160)), (200, 5), (201, 120), (202, 201)]
    got = {r.id: r for r in hierarchy(edges(spark, pairs), hub_rows=20).collect()}
    assert len(got) == len(pairs) and got[1].n_descendants == 59
    assert got[200].path == [1, 5, 200] and got[202].path == [120, 201, 202] and got[202].root == 120 and got[202].depth == 2
    assert {x for x, r in got.items() if r.missing_parent} == set(range(100, 160))
