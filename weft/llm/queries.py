"""Queries of the training-data problems, and the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.keys import decimal_text, label
from weft.llm import cooccurrence, leakage, mixing, percentiles, reading, topn
from weft.operators.versions import latest


def _read(spark: SparkSession, at: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{at}/{table}.parquet")


PERCENTILES = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p99": 0.99}


def _salaries(spark: SparkSession, at: str, *extra: str) -> DataFrame:
    rows = latest(_read(spark, at, "testing_window_long"), "row_id", ["updated_at", "loaded_at"], ["dept", "team", "salary", *extra])
    return rows.withColumn("team", F.upper(label(F.col("team"))))


def p5_percentiles(spark: SparkSession, at: str) -> DataFrame:
    counts = percentiles.encoded(_salaries(spark, at), ["dept", "team"], "salary")
    return percentiles.percentiles(counts, ["dept", "team"], PERCENTILES)


def p5_combined_loads(spark: SparkSession, at: str) -> DataFrame:
    """The summaries of each year's rows, combined: the same percentiles as over all rows at once."""
    rows = _salaries(spark, at, "updated_at")
    after = F.coalesce(F.col("updated_at") >= "2023-01-01", F.lit(False))
    loads = [percentiles.summary(rows.where(c), ["dept", "team"], "salary") for c in (after, ~after)]
    return percentiles.percentiles(percentiles.union_of(loads), ["dept", "team"], PERCENTILES)


def p6_found(spark: SparkSession, at: str) -> DataFrame:
    parts = []
    for src, table in (("long", "testing_window_long"), ("dup_sal", "testing_window_dup_sal")):
        rows = latest(_read(spark, at, table), "row_id", ["updated_at", "loaded_at"], ["dept", "salary"])
        salary = decimal_text(F.col("salary")) if src == "dup_sal" else F.col("salary")
        parts.append(topn.top_n(rows.withColumn("salary", salary), "dept", "salary", "row_id", 5).select(F.lit(src).alias("src"), "dept", "row_id"))
    return parts[0].unionAll(parts[1])


def _book_pairs(spark: SparkSession, at: str, min_together: int = 30) -> DataFrame:
    baskets = _read(spark, at, "explode_test")
    return cooccurrence.pairs(baskets, "basket_id", cooccurrence.book_numbers(baskets["books"]), min_together=min_together)


def p7_found(spark: SparkSession, at: str) -> DataFrame:
    often = _book_pairs(spark, at).where(cooccurrence.more_often(3))
    return often.select(F.col("item_a").alias("book_a"), F.col("item_b").alias("book_b"))


def _association(out: DataFrame) -> DataFrame:
    return out.select("item_a", "item_b", "n_ab", "n_a", "n_b", F.round("lift", 6).alias("lift"), F.round("odds_ratio", 4).alias("odds_ratio"))


def p7_association(spark: SparkSession, at: str) -> DataFrame:
    return _association(_book_pairs(spark, at))


def p7_pairs(spark: SparkSession, at: str) -> DataFrame:
    """p7_association for every pair that is together at least once."""
    return _association(_book_pairs(spark, at, min_together=1))


def _leaks(spark: SparkSession, at: str, short_items: bool = False) -> DataFrame:
    return leakage.leaks(_read(spark, at, "documents"), _read(spark, at, "eval_items"), "doc_id", "text", "item_id", "passage", short_items=short_items)


def p8_found(spark: SparkSession, at: str) -> DataFrame:
    return _leaks(spark, at).select("doc_id", "item_id")


def p8_items(spark: SparkSession, at: str) -> DataFrame:
    """Per leaked item, short ones too: documents with a part of it, with all of it, and the largest share in one document."""
    whole = F.sum((F.col("share") >= 1).cast("int"))
    return _leaks(spark, at, short_items=True).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"), whole.alias("n_whole"), F.max("share").alias("largest_share"))


def _mixed(spark: SparkSession, at: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix(_read(spark, at, "documents"), _read(spark, at, "mix_targets"), "doc_id", "source", "text")


def p9_draw(spark: SparkSession, at: str) -> DataFrame:
    return _mixed(spark, at)[0]


def p9_shares(spark: SparkSession, at: str) -> DataFrame:
    return _mixed(spark, at)[1]


def p9_invariants(spark: SparkSession, at: str) -> DataFrame:
    """What the draw must keep, per source: the share aimed at, the cap, and the tokens but for one document."""
    report = mixing.mix(_read(spark, at, "documents"), _read(spark, at, "mix_targets"), "doc_id", "source", "text")[1]
    missed = F.abs(F.col("drawn_tokens") - F.col("expected_copies") * F.col("source_tokens"))
    return report.select(
        "source",
        "target_share",
        "max_repeats",
        F.round("effective_share", 9).alias("effective_share"),
        (F.col("most_copies") <= F.col("max_repeats")).alias("within_repeats"),
        (missed <= F.col("largest_document") + 1e-6).alias("within_one_document"),
        (F.coalesce(F.col("actual_share"), F.lit(0.0)) > 0).alias("is_drawn"),
    )


def _levels(spark: SparkSession, at: str) -> DataFrame:
    model = reading.fit(_read(spark, at, "reading_panel"), "level", "text")
    return reading.reading_levels(_read(spark, at, "documents"), model, "doc_id", "text", "lang")


def p10_found(spark: SparkSession, at: str) -> DataFrame:
    """English documents whose most likely level is 5."""
    return _levels(spark, at).where("lang = 'en' and level = 5").select(F.col("id").alias("doc_id"))


def p10_levels(spark: SparkSession, at: str) -> DataFrame:
    return _levels(spark, at).withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p5_percentiles, p5_combined_loads, p6_found, p7_found, p7_association, p7_pairs, p8_found, p8_items, p9_draw, p9_shares, p9_invariants, p10_found, p10_levels)
}

_SALARIES = """
with v as (
  select *, row_number() over (partition by row_id order by updated_at desc, loaded_at desc) as nr from testing_window_long where row_id is not null),
r as (
  select dept, upper(nullif(trim(team), '')) as team, salary + 0.0 as salary from v where nr = 1 and salary is not null and not isnan(salary)),
o as (
  select *, row_number() over w as k, count(*) over (partition by dept, team) as n from r window w as (partition by dept, team order by salary))
select dept, team, cast(n as bigint) as n, """ + ", ".join(
    f"max(case when k = greatest(1, cast(ceil(round({p} * n, 9)) as bigint)) then salary end) as {name}" for name, p in PERCENTILES.items()
) + ", 0.0::double as max_rel_error from o group by dept, team, n"

_BOOKS = r"""
with b as (
  select distinct basket_id, cast(regexp_extract(lower(x), '^[\s ]*b([0-9]+)[\s ]*$', 1) as bigint) as book
  from (select basket_id, unnest(string_split(books, '|')) as x from explode_test)
  where basket_id is not null and regexp_matches(lower(x), '^[\s ]*b([0-9]+)[\s ]*$')),
total as (select cast(count(distinct basket_id) as bigint) as n from b),
one as (select book, cast(count(*) as bigint) as n from b group by 1),
two as (select x.book as item_a, y.book as item_b, cast(count(*) as bigint) as n_ab
        from b x join b y on x.basket_id = y.basket_id and x.book < y.book group by 1, 2 having count(*) >= 30),
every as (select item_a, item_b, n_ab, p.n as n_a, q.n as n_b, total.n as n
          from two join one p on p.book = item_a join one q on q.book = item_b, total)
"""

_ALL_BOOKS = _BOOKS.replace(" having count(*) >= 30", "")

_ASSOCIATION = """select item_a, item_b, n_ab, n_a, n_b, round(n_ab * n / (n_a * n_b), 6) as lift,
         round(((n_ab + 0.5) * (n - n_a - n_b + n_ab + 0.5)) / ((n_a - n_ab + 0.5) * (n_b - n_ab + 0.5)), 4) as odds_ratio from every"""

_TOP = r"""
with l as (select *, row_number() over (partition by row_id order by updated_at desc, loaded_at desc) as nr from testing_window_long where row_id is not null),
d as (select *, row_number() over (partition by row_id order by updated_at desc, loaded_at desc) as nr from testing_window_dup_sal where row_id is not null),
every as (
  select 'long' as src, dept, row_id, salary from l where nr = 1
  union all
  select 'dup_sal', dept, row_id, case when regexp_matches(bare, '^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$') then try_cast(bare as double) end
  from (select *, regexp_replace(salary, '[\s ,]', '', 'g') as bare from d where nr = 1))
select src, dept, row_id from every where dept is not null and salary is not null and not isnan(salary)
qualify row_number() over (partition by src, dept order by salary desc, row_id) <= 5"""

#: A word broken at a line end, twice since two breaks may share a letter.
_BROKEN = r"'([a-z0-9])[-\x{2010}\x{AC}\x{AD}][\t\f\v\r \x{A0}]*\n[\s\x{A0}]*([a-z0-9])', '\1\2', 'g'"


def _words(text: str) -> str:
    spoken = rf"regexp_replace(lower({text}), '\[[^\]]*\]|\([^)]*\)', ' ', 'g')"
    return f"regexp_extract_all(regexp_replace(regexp_replace({spoken}, {_BROKEN}), {_BROKEN}), '[a-z0-9]+')"


_LEAKS = f"""
with d as (select doc_id, {_words("text")} as w from documents where doc_id is not null),
i as (select item_id, {_words("passage")} as w from eval_items where item_id is not null),
q as (
  select distinct item_id, size, array_to_string(w[k : k + size - 1], ' ') as words
  from (select *, unnest(range(1, len(w) - size + 2)) as k from (select *, least(len(w), 12) as size from i) where size >= 5)),
sizes as (select distinct size from q),
g as (
  select doc_id, size, array_to_string(w[k : k + size - 1], ' ') as words
  from (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as k from d, sizes)),
hits as (select distinct doc_id, size, words from g semi join q using (size, words)),
found as (
  select doc_id, item_id, count(*) as n_windows, count(*) / any_value(n) as share, any_value(size) as size
  from hits join q using (size, words) join (select item_id, count(*) as n from q group by 1) using (item_id) group by all)
"""

SQL: dict[str, str] = {
    "p5_percentiles": _SALARIES,
    "p5_combined_loads": _SALARIES,
    "p6_found": _TOP,
    "p7_found": _BOOKS + "select item_a as book_a, item_b as book_b from every where n_ab * n >= 3 * n_a * n_b",
    "p7_association": _BOOKS
    + """select item_a, item_b, n_ab, n_a, n_b, round(n_ab * n / (n_a * n_b), 6) as lift,
         round(((n_ab + 0.5) * (n - n_a - n_b + n_ab + 0.5)) / ((n_a - n_ab + 0.5) * (n_b - n_ab + 0.5)), 4) as odds_ratio from every""",
    "p7_pairs": _ALL_BOOKS + _ASSOCIATION,
    "p8_found": _LEAKS + "select doc_id, item_id from found where size = 12",
    "p8_items": _LEAKS
    + """select item_id, count(*) as n_documents, cast(sum(cast(share >= 1 as integer)) as bigint) as n_whole, max(share) as largest_share
         from found group by 1""",
    "p9_invariants": """
with have as (select source, count(*) as n from documents where source is not null and text <> '' and doc_id is not null group by 1),
t as (select source, sum(target_share) as target_share, max(max_repeats) as max_repeats from mix_targets where source is not null group by 1),
every as (
  select coalesce(t.source, have.source) as source, greatest(coalesce(target_share, 0.0), 0.0) as target_share, greatest(coalesce(max_repeats, 0), 0) as max_repeats,
    coalesce(n, 0) > 0 and coalesce(target_share, 0) > 0 and coalesce(max_repeats, 0) > 0 as able
  from t full join have on t.source = have.source)
select source, target_share, max_repeats, round(case when able then target_share / sum(target_share) filter (able) over () else 0 end, 9) as effective_share,
  true as within_repeats, true as within_one_document, able as is_drawn from every""",
}
