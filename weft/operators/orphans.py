"""References to records that do not exist, were deleted or came later.

Skew-aware split: references are counted per key and period with map-side combine, with the first and
last time of each group. The groups are checked first: one whose times lie in a single validity period
has no orphan, one that meets none has only orphans; references are looked at again only in the
groups that are not free of them. They find their group by a broadcast of those groups, if these are at most
broadcast_rows; otherwise only the largest groups are broadcast (broadcast_rows at most, so that no key
is hot in what is left), and the references of all other groups go through a shuffled join. Within a
group in which a record begins or ends each reference is anti-joined to the validity periods of its
key, large keys by salt. The orphans of all parts are united.

Defined cases: a null, empty or blank reference is no reference. A reference without time has no
valid record and is an orphan. A dimension row without key or start is ignored; without end it is
valid for good. Repeated dimension rows and overlapping validity periods are merged first (by the
interval operator, which spreads a key of very many periods). The same (id, field) is returned once,
however often the fact was delivered, with the smallest of its orphaned keys and periods; facts without
id are one such fact. In the counts an id is one orphan per field and period, and every fact without id
is one of its own. Empty facts give no rows; an empty dimension makes every reference an orphan. Extra
columns on either side are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions.keys import canonical_key
from weft.operators.intervals import periods as continuous
from weft.operators.skew import copied, heavy_groups, salted, without
from weft.plans.stage import counts_of, written

FOREVER = "9999-12-31 00:00:00"
SEPARATOR = "\x1f"
KEY = ["ref_field", "key"]


@dataclass(frozen=True)
class Reference:
    """One reference column of the facts and the table it points to."""

    field: str
    dimension: DataFrame
    key: str
    start: str
    end: str


def references(facts: DataFrame, id_col: str, time_col: str, refs: list[Reference]) -> DataFrame:
    """One row per fact and non-blank reference: id, ts, ref_field, key."""
    each = F.array(*(F.struct(F.lit(r.field).alias("ref_field"), canonical_key(facts[r.field]).alias("key")) for r in refs))
    rows = facts.select(facts[id_col].alias("id"), facts[time_col].alias("ts"), F.explode(each).alias("r"))
    return rows.select("id", "ts", "r.ref_field", "r.key").where(F.col("key").isNotNull())


def validity(refs: list[Reference]) -> DataFrame:
    """Disjoint validity periods [begin, finish) of every key: ref_field, key, begin, finish."""
    parts = None
    for r in refs:
        d = r.dimension
        part = d.select(
            F.lit(r.field).alias("ref_field"),
            canonical_key(d[r.key]).alias("key"),
            d[r.start].cast("timestamp_ntz").alias("begin"),
            F.coalesce(d[r.end].cast("timestamp_ntz"), F.lit(FOREVER).cast("timestamp_ntz")).alias("finish"),
        )
        parts = part if parts is None else parts.unionAll(part)
    valid = parts.where("key is not null and begin is not null and finish > begin").distinct()
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    merged = continuous(valid.select(F.concat_ws(SEPARATOR, "ref_field", "key").alias("entity"), us("begin").alias("s"), us("finish").alias("e")))
    whole = F.split("entity", SEPARATOR, 2)
    back = lambda c: F.timestamp_micros(F.col(c)).cast("timestamp_ntz")
    out = merged.select(whole[0].alias("ref_field"), whole[1].alias("key"), back("period_start").alias("begin"), back("period_end").alias("finish"))
    return written(out, "validity")


def per_period(rows: DataFrame) -> DataFrame:
    """References counted per field, key and period, with the first and last time in each."""
    return rows.groupBy(*KEY, "period").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("low"), F.max("ts").alias("high"))


def _judged(groups: DataFrame, periods: DataFrame) -> DataFrame:
    """The groups that are not free of orphans: field, key, period, n, and `met` where only some references may be orphans."""
    known = periods.select(*(F.col(c).alias(f"p_{c}") for c in periods.columns))
    meets = (F.col("ref_field") == F.col("p_ref_field")) & (F.col("key") == F.col("p_key")) & (F.col("begin") <= F.col("high")) & (F.col("finish") > F.col("low"))
    known = known.withColumnsRenamed({"p_begin": "begin", "p_finish": "finish"})
    verdict = groups.join(known, meets, "left").groupBy(*KEY, "period").agg(
        F.max("n").alias("n"),
        F.max(F.col("begin").isNotNull()).alias("met"),
        F.coalesce(F.max((F.col("begin") <= F.col("low")) & (F.col("finish") > F.col("high"))), F.lit(False)).alias("covered"),
    )
    return verdict.where("not covered").drop("covered")


def _in_groups(rows: DataFrame, groups: DataFrame, how: str = "left_semi") -> DataFrame:
    """rows of one of the groups (left_anti: of none), by field, key and period (null is a period)."""
    own = groups.select(*(F.col(c).alias(f"g_{c}") for c in (*KEY, "period")))
    same = (F.col("ref_field") == F.col("g_ref_field")) & (F.col("key") == F.col("g_key")) & F.col("period").eqNullSafe(F.col("g_period"))
    return rows.join(own, same, how)


def _without_record(rows: DataFrame, periods: DataFrame, *salt: str) -> DataFrame:
    """rows whose time is in no validity period of their key."""
    own = periods.select(*(F.col(c).alias(f"v_{c}") for c in periods.columns))
    valid = (F.col("v_begin") <= F.col("ts")) & (F.col("v_finish") > F.col("ts"))
    for c in (*KEY, *salt):
        valid = valid & (F.col(c) == F.col(f"v_{c}"))
    return rows.join(own, valid, "left_anti")


def orphan_rows(
    facts: DataFrame,
    refs: list[Reference],
    id_col: str,
    time_col: str,
    period: str = "month",
    heavy_rows: int = 2_000,
    salt_rows: int = 50_000,
    broadcast_rows: int = 50_000,
) -> DataFrame:
    """id, ts, ref_field, key, period of every reference without a valid record, repeated deliveries too.

    heavy_rows: references of a group that is looked up by broadcast; salt_rows: references of a key in one part.
    """
    rows = references(facts, id_col, time_col, refs).withColumn("period", F.date_trunc(period, F.col("ts")))
    groups = written(per_period(rows), "groups")
    periods = validity(refs)
    suspect = written(_judged(groups, periods), "suspect", groups=F.lit(1), met=F.col("met"))
    counts = counts_of(suspect)
    if counts["groups"] <= broadcast_rows:
        found = _in_groups(rows, F.broadcast(suspect))
    else:
        heavy = heavy_groups(groups, [*KEY, "period"], heavy_rows, broadcast_rows)
        if heavy is None:
            found = _in_groups(rows, suspect)
        else:  # heavy has at most broadcast_rows rows, so have the suspects among them
            clear = _in_groups(heavy, suspect)
            cold = _in_groups(rows, F.broadcast(heavy), "left_anti")
            found = _in_groups(cold, suspect).unionAll(_in_groups(rows, F.broadcast(clear)))
    if not counts["met"]:
        return found
    known = written(periods.join(suspect.where("met").select(*KEY).distinct(), KEY, "left_semi"), "known", periods=F.lit(1))
    if counts_of(known)["periods"] <= broadcast_rows:
        return _without_record(found, F.broadcast(known))
    large = heavy_groups(suspect.groupBy(*KEY).agg(F.sum("n").alias("n")), KEY, salt_rows)
    if large is None:
        return _without_record(found, known)
    hot = _without_record(salted(found, large, KEY), copied(known, large, KEY), "salt")
    return _without_record(without(found, large, KEY), known).unionByName(hot.drop("salt"))


def orphan_references(facts: DataFrame, refs: list[Reference], id_col: str, time_col: str, period: str = "month", **bounds: int) -> DataFrame:
    """Every (id, ref_field) whose key has no valid record at the fact's time, with key and period."""
    found = orphan_rows(facts, refs, id_col, time_col, period, **bounds)
    return found.groupBy("id", "ref_field").agg(F.min("key").alias("key"), F.min("period").alias("period"))


def orphan_counts(facts: DataFrame, refs: list[Reference], id_col: str, time_col: str, period: str = "month", **bounds: int) -> DataFrame:
    """Orphans per field and period: ref_field, period, n_orphans, n_keys; facts are counted once per id."""
    found = orphan_rows(facts, refs, id_col, time_col, period, **bounds)
    each = found.groupBy("ref_field", "period").agg(
        F.count_distinct("id").alias("ids"), F.count(F.when(F.col("id").isNull(), 1)).alias("no_id"), F.count_distinct("key").alias("n_keys")
    )
    return each.select("ref_field", "period", (F.col("ids") + F.col("no_id")).alias("n_orphans"), "n_keys")
