from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", [n for n in sorted(entry.oracle_sql()) if not n[1].isdigit()])
def test_query_agrees_with_sql(spark, name):
    db = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        db.execute(f"create view {p.stem} as select * from '{p}'")
    got, want = entry.queries()[name](spark, SF).toPandas(), db.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)

    def rows(df):
        text = lambda v: "" if not isinstance(v, (list, np.ndarray)) and pd.isna(v) else repr(float(v)) if isinstance(v, (int, float, np.number)) and not isinstance(v, bool) else str(v)
        return sorted(tuple(text(v) for v in r) for r in df[columns].itertuples(index=False))

    assert rows(got) == rows(want)
