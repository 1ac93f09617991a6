import random
from pathlib import Path

import duckdb
import pytest

from weft.operators.hierarchy import all_descendants, hierarchy
from weft.plans.problem_queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["p2_employees", "p2_reports"])
def test_query_agrees_with_sql(spark, name):
    db = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        db.execute(f"create view {p.stem} as select * from '{p}'")
    want = db.execute(SQL[name])
    columns = [c[0] for c in want.description]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, want.fetchall()))


def above(pairs):
    """(ancestor, descendant, distance) by walking up from each node until a node comes again."""
    parent = dict(sorted(pairs, key=lambda p: (p[1] is not None, p[1] or 0)))
    out = set()
    for x in parent:
        seen, here = [x], x
        while (up := parent[here]) in parent and up not in seen:
            seen.append(up)
            here = up
        out |= {(a, x, n) for n, a in enumerate(seen) if n}
    return out


@pytest.mark.parametrize("seed", [3, 4])
def test_descendants_on_and_below_cycles(spark, seed):
    rnd = random.Random(seed)
    pairs = [(1, None), (2, 1), (4, 99), (5, 5), (6, 5), (7, 6)]
    pairs += [(200 + i, 200 + (i + 1) % 17) for i in range(17)]
    pairs += [(300 + i, 300 + i - 1 if i else 203) for i in range(30)]  # a chain below the cycle
    pairs += [(400 + i, rnd.choice([2, 7, *range(200, 217), *range(300, 330), *range(400, 400 + i)])) for i in range(60)]
    got = [(r.ancestor, r.descendant, r.distance) for r in all_descendants(hierarchy(spark.createDataFrame(pairs, "id bigint, parent bigint"))).collect()]
    assert len(got) == len(set(got)) and set(got) == above(pairs)
