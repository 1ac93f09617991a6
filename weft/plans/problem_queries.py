"""Queries of the general data problems, and the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.keys import label, whole_number
from weft.operators import features, hierarchy, intervals, orphans


def _read(spark: SparkSession, at: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{at}/{table}.parquet")


def _shop(spark: SparkSession, at: str) -> tuple[DataFrame, list[orphans.Reference]]:
    return _read(spark, at, "shop_orders"), [
        orphans.Reference("productid", _read(spark, at, "product"), "product_id", "created_at", "deleted_at"),
        orphans.Reference("customerid", _read(spark, at, "shop_customers"), "customerid", "created_at", "deleted_at"),
    ]


def p1_found(spark: SparkSession, at: str) -> DataFrame:
    facts, refs = _shop(spark, at)
    return orphans.orphan_references(facts, refs, "orderid", "order_ts").select(F.col("id").alias("orderid"), "ref_field")


def p1_orphans_by_month(spark: SparkSession, at: str) -> DataFrame:
    facts, refs = _shop(spark, at)
    out = orphans.orphan_counts(facts, refs, "orderid", "order_ts")
    return out.select("ref_field", F.date_format("period", "yyyy-MM").alias("month"), "n_orphans", "n_keys")


def _employees(spark: SparkSession, at: str) -> DataFrame:
    """id, parent by the latest version of each employee."""
    e = _read(spark, at, "employees").select(whole_number(F.col("empid")).alias("id"), whole_number(F.col("managerid")).alias("parent"), "updated_at")
    return e.where("id is not null").groupBy("id").agg(F.max(F.struct("updated_at", "parent")).alias("v")).select("id", "v.parent")


def p2_found(spark: SparkSession, at: str) -> DataFrame:
    return hierarchy.cycles(_employees(spark, at)).select(F.col("id").alias("empid"), F.col("cycle_key").alias("cyclekey"))


def p2_hierarchy(spark: SparkSession, at: str) -> DataFrame:
    nodes = hierarchy.hierarchy(_employees(spark, at))
    path = F.array_join(F.transform("path", lambda x: x.cast("string")), "/")
    return nodes.where("root is not null").select(F.col("id").alias("empid"), "root", "depth", path.alias("path"), "n_descendants", "missing_parent")


def p2_employees(spark: SparkSession, at: str) -> DataFrame:
    """p2_hierarchy for every employee, with cycle_key on a cycle; on and below one root, depth and path are null."""
    nodes = hierarchy.hierarchy(_employees(spark, at))
    path = F.array_join(F.transform("path", lambda x: x.cast("string")), "/")
    return nodes.select(F.col("id").alias("empid"), "root", "depth", path.alias("path"), "n_descendants", "missing_parent", "cycle_key")


def p2_descendants(spark: SparkSession, at: str) -> DataFrame:
    return hierarchy.descendants(hierarchy.hierarchy(_employees(spark, at)))


def p2_reports(spark: SparkSession, at: str) -> DataFrame:
    """p2_descendants for every employee, those on and below a cycle too."""
    return hierarchy.all_descendants(hierarchy.hierarchy(_employees(spark, at)))


def _runs(spark: SparkSession, at: str) -> DataFrame:
    runs = _read(spark, at, "fake_runs")
    return intervals.spans(runs, label(runs["instance"]), "start_time", "end_time")


def p3_found(spark: SparkSession, at: str) -> DataFrame:
    gaps = intervals.gaps(_runs(spark, at)).where(F.col("gap_end") - F.col("gap_start") <= intervals.DAY_US)
    return gaps.select(F.col("entity").alias("instance"), *(intervals.as_text(F.col(c)).alias(c) for c in ("gap_start", "gap_end")))


def p3_periods(spark: SparkSession, at: str) -> DataFrame:
    out = intervals.periods(_runs(spark, at))
    return out.select(F.col("entity").alias("instance"), *(intervals.as_text(F.col(c)).alias(c) for c in ("period_start", "period_end")))


def p4_features(spark: SparkSession, at: str) -> DataFrame:
    runs = _read(spark, at, "fake_runs")
    out = features.event_features(runs, label(runs["instance"]), label(runs["status"]), "run_id", "start_time", "end_time")
    return out.withColumnRenamed("entity", "instance")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_orphans_by_month, p2_found, p2_hierarchy, p2_employees, p2_descendants, p2_reports, p3_found, p3_periods, p4_features)
}

_KEY = r"regexp_replace(lower(trim({0}, E' \t\n\r\f\x0b ')), '^([^0-9]*)0+([0-9])', '\1\2')"

_ORPHANS = f"""
with refs as (
  select orderid, order_ts, 'productid' as ref_field, {_KEY.format("productid")} as k from shop_orders
  union all
  select orderid, order_ts, 'customerid', {_KEY.format("customerid")} from shop_orders),
dims as (
  select 'productid' as ref_field, {_KEY.format("product_id")} as k, created_at, deleted_at from product
  union all
  select 'customerid', {_KEY.format("customerid")}, created_at, deleted_at from shop_customers),
found as (
  select distinct orderid, ref_field, k, order_ts from refs r
  where k is not null and k <> '' and not exists (
    select 1 from dims d where d.ref_field = r.ref_field and d.k = r.k and d.created_at <= r.order_ts
      and (d.deleted_at is null or d.deleted_at > r.order_ts)))
"""

_TREE = r"""
with recursive v as (
  select try_cast(trim(empid) as bigint) as id, try_cast(trim(managerid) as bigint) as parent,
         row_number() over (partition by try_cast(trim(empid) as bigint) order by updated_at desc, try_cast(trim(managerid) as bigint) desc nulls last) as nr
  from employees where try_cast(trim(empid) as bigint) is not null),
e as (select id, parent from v where nr = 1),
up as (
  select id, id as root, cast(0 as bigint) as depth, cast(id as varchar) as path, parent is not null as missing_parent
  from e where parent is null or parent not in (select id from e)
  union all
  select e.id, up.root, up.depth + 1, up.path || '/' || e.id, false from e join up on e.parent = up.id)
"""

_ABOVE = _TREE + """, steps as (
  select id as start, parent as here, cast(1 as bigint) as distance, [id, parent] as seen
  from e where parent <> id and parent in (select id from e)
  union all
  select s.start, e.parent, s.distance + 1, list_append(seen, e.parent) from steps s join e on e.id = s.here
  where not list_contains(seen, e.parent) and e.parent in (select id from e)),
rings as (
  select id, id as other from e where parent = id
  union
  select a.start, unnest([a.start, a.here]) from steps a join steps b on b.start = a.here and b.here = a.start)
"""

_SPANS = r"""
with runs as (
  select distinct lower(trim(instance, E' \t\n\r\f\x0b ')) as instance, start_time as s,
         case when end_time < start_time then end_time + interval 1 day else end_time end as e
  from fake_runs where start_time is not null and end_time is not null),
marked as (
  select *, max(e) over (partition by instance order by s, e rows between unbounded preceding and 1 preceding) as before
  from runs where instance <> '' and e >= s),
numbered as (
  select *, sum(case when before >= s then 0 else 1 end) over (partition by instance order by s, e rows unbounded preceding) as nr from marked),
periods as (select instance, nr, min(s) as period_start, max(e) as period_end from numbered group by all)
"""

#: The statuses of fake_runs, as column names.
_STATUSES = [
    "none", "failed", "running", "success",
    *(f"failed_e{i:03}" for i in range(1, 140)), *(f"running_step_{i}" for i in range(1, 60)), *(f"success_{c}{i}" for c in "wxyz" for i in range(1, 16)),
]

_WIDE = ", ".join(
    f"""cast(count(*) filter (kind = '{k}') as bigint) as {k}_n, max(s) filter (kind = '{k}') as {k}_last,
      coalesce(sum(greatest(epoch_us(e) - epoch_us(s), 0)) filter (kind = '{k}'), 0) / 1e6 as {k}_total_s"""
    for k in _STATUSES
)

SQL: dict[str, str] = {
    "p1_found": _ORPHANS + "select distinct orderid, ref_field from found",
    "p1_orphans_by_month": _ORPHANS
    + """select ref_field, strftime(order_ts, '%Y-%m') as month, cast(count(distinct orderid) as bigint) as n_orphans,
         cast(count(distinct k) as bigint) as n_keys from found group by 1, 2""",
    "p2_found": """
with recursive v as (
  select try_cast(trim(empid) as bigint) as id, try_cast(trim(managerid) as bigint) as parent,
         row_number() over (partition by try_cast(trim(empid) as bigint) order by updated_at desc, try_cast(trim(managerid) as bigint) desc nulls last) as nr
  from employees where try_cast(trim(empid) as bigint) is not null),
e as (select id, parent from v where nr = 1),
walk as (
  select id as start, parent as here from e where parent is not null
  union
  select w.start, e.parent from walk w join e on e.id = w.here where e.parent is not null)
select a.start as empid, min(b.here) as cyclekey
from walk a join walk b on a.start = b.start join walk c on c.start = b.here and c.here = a.start
where a.start = a.here group by a.start""",
    "p2_hierarchy": _TREE
    + """, n as (
  select cast(x as bigint) as id, count(*) - 1 as n_descendants from (select unnest(string_split(path, '/')) as x from up) group by 1)
select up.id as empid, root, depth, path, cast(n_descendants as bigint) as n_descendants, missing_parent from up join n on n.id = up.id""",
    "p2_employees": _ABOVE
    + """, n as (select here as id, count(*) as n from steps group by 1),
c as (select id, min(other) as cycle_key from rings group by 1)
select e.id as empid, root, depth, path, case when cycle_key is null then cast(coalesce(n, 0) as bigint) end as n_descendants,
  coalesce(missing_parent, false) as missing_parent, cycle_key
from e left join up on up.id = e.id left join n on n.id = e.id left join c on c.id = e.id""",
    "p2_descendants": _TREE
    + """select cast(x as bigint) as ancestor, id as descendant, distance from (
  select id, unnest(string_split(path, '/')) as x, depth - unnest(range(0, depth + 1)) as distance from up) where distance > 0""",
    "p2_reports": _ABOVE + "select here as ancestor, start as descendant, distance from steps",
    "p3_found": _SPANS
    + """, g as (
  select instance, period_end as gap_start, lead(period_start) over (partition by instance order by nr) as gap_end from periods)
select instance, strftime(gap_start, '%Y-%m-%d %H:%M:%S') as gap_start, strftime(gap_end, '%Y-%m-%d %H:%M:%S') as gap_end
from g where gap_end > gap_start and gap_end - gap_start <= interval 24 hours""",
    "p3_periods": _SPANS
    + """select instance, strftime(period_start, '%Y-%m-%d %H:%M:%S') as period_start,
         strftime(period_end, '%Y-%m-%d %H:%M:%S') as period_end from periods""",
    "p4_features": rf"""
with r as (
  select distinct on (instance, kind, coalesce(run_id, -nr)) * from (
    select lower(trim(instance, E' \t\n\r\f\x0b ')) as instance,
      regexp_replace(coalesce(nullif(lower(trim(status, E' \t\n\r\f\x0b ')), ''), 'none'), '[^a-z0-9]+', '_', 'g') as kind, run_id, start_time as s,
      case when end_time < start_time then end_time + interval 1 day else end_time end as e, row_number() over () as nr
    from fake_runs) where instance <> ''
  order by instance, kind, coalesce(run_id, -nr), s desc nulls last, greatest(epoch_us(e) - epoch_us(s), 0) desc)
select instance, {_WIDE} from r group by instance""",
}
