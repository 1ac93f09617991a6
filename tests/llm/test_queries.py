from pathlib import Path

import duckdb
import pytest

from weft.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, name):
    db = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        db.execute(f"create view {p.stem} as select * from '{p}'")
    got, want = QUERIES[name](spark, SF).toPandas(), db.execute(SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    text = lambda v: "" if v is None or v != v else repr(float(v)) if isinstance(v, (int, float)) else str(v)
    rows = lambda df: sorted(tuple(text(v) for v in r) for r in df[columns].itertuples(index=False))
    assert rows(got) == rows(want)


def test_draw_and_shares_agree(spark):
    draw = QUERIES["p9_draw"](spark, SF).toPandas()
    shares = QUERIES["p9_shares"](spark, SF).toPandas().set_index("source")
    assert draw.doc_id.is_unique and (draw.copies >= 1).all()
    used = (draw.tokens * draw.copies).groupby(draw.source).sum()
    assert {s: int(n) for s, n in shares.drawn_tokens.items() if n} == used.to_dict()
    assert abs(shares.actual_share.sum() - 1) < 1e-9 and abs(shares.effective_share.sum() - 1) < 1e-9
    texts = duckdb.sql(f"select doc_id, source from '{SF}/documents.parquet' where text <> ''").df().set_index("doc_id").source
    assert (texts.loc[draw.doc_id].to_numpy() == draw.source.to_numpy()).all()


def test_levels_and_the_most_demanding(spark):
    levels = QUERIES["p10_levels"](spark, SF).toPandas()
    n = duckdb.sql(f"select count(*) from '{SF}/documents.parquet'").fetchall()[0][0]
    assert len(levels) == n and set(levels.level.dropna()) <= {1, 2, 3, 4, 5}
    found = {r.doc_id for r in QUERIES["p10_found"](spark, SF).collect()}
    assert found and found == set(levels[(levels.lang == "en") & (levels.level == 5)].doc_id)
    said = duckdb.sql(f"select doc_id, lang from '{SF}/documents.parquet' where lang is not null").df().set_index("doc_id").lang
    assert (levels.set_index("doc_id").lang.loc[said.index] == said).all()
    assert set(levels.lang.dropna()) == set(said)  # the others get one of the languages that there are


def test_every_query_has_sql_or_a_test_here():
    assert set(QUERIES) - set(SQL) == {"p9_draw", "p9_shares", "p10_found", "p10_levels"}
