"""A query for every table operator over the star-schema tables, and the SQL each must agree with."""

from __future__ import annotations

import contextlib
import io
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import scalars
from weft.plans.stage import shared_folder
from weft.specs import Append, Dedup, GroupBy, Melt, Merge, Pivot, Sort, Window, WindowFrame
from weft.table import Table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Order columns that make each table's natural order total.
KEYS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"],
    "lineitem": ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "events": ["event_id"], "embeddings": ["vec_id"], "shop_orders": ["orderid"],
    "testing_window_long": ["row_id", "updated_at", "loaded_at"],
}


def _table(spark: SparkSession, at: str, name: str) -> Table:
    return Table.from_df(spark.read.parquet(f"{at}/{name}.parquet"), KEYS[name])


def query(sql: str, *tables: str):
    """Registers f(tables...) -> Table or DataFrame under its name, beside its SQL."""

    def register(f: Callable[..., Table | DataFrame]) -> Callable[..., Table | DataFrame]:
        def run(spark: SparkSession, at: str) -> DataFrame:
            out = f(*(_table(spark, at, t) for t in tables))
            return out.df if isinstance(out, Table) else out

        QUERIES[f.__name__] = run
        SQL[f.__name__] = sql
        return f

    return register


# -- sources and actions -------------------------------------------------------------------------


def _rows(like: Table, rows: list[dict]) -> Table:
    return Table.from_rows(like.df.sparkSession, rows)


@query("select * from (values (2.5::double, 'x'), (1, null), (null, 'y')) v(b, a)", "region")
def rows_in_memory(region):
    return _rows(region, [{"b": 2.5, "a": "x"}, {"a": None, "b": 1}, {"b": None, "a": "y"}])


@query("select ''::varchar as a, ''::varchar as b where false", "region")
def empty_table(region):
    return Table.empty(region.df.sparkSession, "a", "b")


@query("select n_nationkey, n_name, n_regionkey from nation", "nation")
def read_json_file(nation):
    """Written as lines of JSON and read back with a schema."""
    spark = nation.df.sparkSession
    path = f"{shared_folder(spark)}/weft/json-{uuid.uuid4().hex}"
    nation.df.write.json(path)
    return Table.read_json(spark, path, "n_nationkey bigint, n_name string, n_regionkey bigint", multiline=False)


@query("select n_nationkey, n_name from nation where n_regionkey = 2", "nation")
def execute_table(nation):
    return nation.filter(lambda r: r.n_regionkey == 2).execute().select("n_nationkey", "n_name")


@query("select count(*) as rows, 3 as width from nation where n_regionkey > 1", "nation")
def count_and_columns(nation):
    some = nation.filter(lambda r: r.n_regionkey > 1).select("n_nationkey", "n_name", "n_regionkey")
    return _rows(nation, [{"rows": some.count(), "width": len(some.columns)}])


@query("select cast(row_number() over (order by n_name desc) as bigint) as place, n_name from nation", "nation")
def data_in_order(nation):
    names = nation.sort(Sort.desc("n_name")).select("n_name").data
    return _rows(nation, [{"place": i, **r} for i, r in enumerate(names, 1)])


@query("select * from (values (1, 'regions'), (2, 'r_name'), (5, 'end')) v(place, line) union all select r_regionkey + 3, r_name from region where r_regionkey < 2", "region")
def log_lines(region):
    """The first two rows, as printed."""
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        region.select("r_name").log(2, "regions")
        print("end")
    return _rows(region, [{"place": i, "line": x} for i, x in enumerate(out.getvalue().splitlines(), 1)])


@query("select r_regionkey, r_name from region", "region")
def printed_json(region):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        region.select("r_regionkey", "r_name").print_json()
    return _rows(region, json.loads(out.getvalue()))


@query("select true as reads_two_columns, true as pushes_filter", "orders")
def logic_plan_text(orders):
    """The plan of a filter and a choice of columns: both reach the scan."""
    plan = orders.filter(lambda r: r.o_custkey > 7).select("o_orderkey", "o_custkey").logic_plan
    return _rows(orders, [{"reads_two_columns": "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in plan, "pushes_filter": "GreaterThan(o_custkey,7)" in plan}])


# -- columns -------------------------------------------------------------------------------------


@query("select n_regionkey, n_name from nation", "nation")
def select_cols(nation):
    return nation.select("n_regionkey", "n_name", "n_name")


@query("select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from customer", "customer")
def select_glob(customer):
    return customer.select_glob("c_*")


@query("select n_nationkey, n_name from nation", "nation")
def drop_cols(nation):
    return nation.drop("n_regionkey")


@query("select n_name from nation", "nation")
def drop_glob(nation):
    return nation.drop_glob("*key")


@query("select r_regionkey as id, r_name from region", "region")
def rename_one(region):
    return region.rename("r_regionkey", "id")


@query("select c_custkey as customer_custkey, c_name as customer_name, c_nationkey as customer_nationkey, c_acctbal as customer_acctbal, c_mktsegment as customer_mktsegment from customer", "customer")
def rename_glob(customer):
    return customer.rename_glob("c_*", "customer_$0")


@query('select n_nationkey as "N_NATIONKEY", n_name as "N_NAME", n_regionkey as "N_REGIONKEY" from nation', "nation")
def rename_all(nation):
    return nation.rename_all(str.upper)


@query("select o_orderkey, o_custkey, o_orderdate, o_totalprice * 2 as gross, extract(year from o_orderdate) as year from orders", "orders")
def add_column(orders):
    out = orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice").add_column("gross", lambda r: r.o_totalprice * 2)
    return out.add_column("year", lambda r: F.year(r.o_orderdate).cast("bigint")).drop("o_totalprice")


@query("select l_orderkey, l_linenumber, case when l_returnflag = 'N' then null else lower(l_returnflag) end as l_returnflag, l_quantity from lineitem", "lineitem")
def update_column(lineitem):
    out = lineitem.select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    return out.update_column("l_returnflag", lambda r: F.when(r.l_returnflag != "N", F.lower(r.l_returnflag)))


@query("select lpad(cast(n_nationkey as varchar), 3, '0') as code, upper(n_name) as up, length(n_name) as size, substring(n_name, 1, 3) as head, sqrt(n_nationkey) as root, coalesce(try_cast(n_name as double), -1) as number, contains(n_name, 'A') as has_a from nation", "nation")
def scalar_functions(nation):
    out = nation.add_column("code", lambda r: F.lpad(r.n_nationkey.cast("string"), 3, "0")).add_column("up", lambda r: F.upper(r.n_name))
    out = out.add_column("size", lambda r: F.length(r.n_name).cast("bigint")).add_column("head", lambda r: F.substring(r.n_name, 1, 3))
    out = out.add_column("root", lambda r: F.sqrt(r.n_nationkey)).add_column("number", lambda r: F.coalesce(r.n_name.try_cast("double"), F.lit(-1.0)))
    return out.add_column("has_a", lambda r: F.contains(r.n_name, F.lit("A"))).select("code", "up", "size", "head", "root", "number", "has_a")


@query("select orderid, coalesce(try_cast(nullif(trim(customerid), '') as double), -1) as filled, try_cast(nullif(trim(customerid), '') as double) as number, coalesce(customerid, 'null') || '/' || coalesce(cast(quantity as varchar), 'null') as label, string_split(coalesce(productid, ''), 'P')[2] as part, case when length(cast(orderid as varchar)) < 6 then lpad(cast(orderid as varchar), 6, '0') else cast(orderid as varchar) end as code, true as is_now from (select distinct orderid, customerid, productid, quantity from shop_orders)", "shop_orders")
def scalar_library(orders):
    """The functions whose rules differ from Spark's own."""
    t = orders.group_by(GroupBy.on("orderid", "customerid", "productid", "quantity"))
    out = t.add_column("number", lambda r: scalars.number_or_null(r.customerid)).add_column("filled", lambda r: F.coalesce(r.number, F.lit(-1.0)))
    out = out.add_column("label", lambda r: scalars.text(r.customerid, "/", r.quantity)).add_column("part", lambda r: scalars.piece(F.coalesce(r.productid, F.lit("")), "P", 1))
    out = out.add_column("code", lambda r: scalars.pad_start(r.orderid, 6, "0")).add_column("is_now", lambda r: scalars.now_ms() > 1_600_000_000_000)
    return out.select("orderid", "filled", "number", "label", "part", "code", "is_now")


# -- rows ----------------------------------------------------------------------------------------


@query("select l_orderkey, l_partkey, l_quantity from lineitem where l_quantity > 30 and l_discount between 0.05 and 0.07 and l_returnflag is distinct from 'R'", "lineitem")
def filter_pred(lineitem):
    return lineitem.filter(lambda r: (r.l_quantity > 30) & r.l_discount.between(0.05, 0.07) & (r.l_returnflag != "R")).select("l_orderkey", "l_partkey", "l_quantity")


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20 offset 5", "orders")
def take_sorted(orders):
    return orders.sort(Sort.desc("o_totalprice")).take(20, 5).select("o_orderkey", "o_totalprice")


@query("select o_orderkey, cast(row_number() over (order by o_orderdate desc, o_custkey, o_orderkey) as integer) as place from orders", "orders")
def sort_multi(orders):
    return orders.window(Window.order_by(Sort.desc("o_orderdate").asc("o_custkey")).row_number("place")).select("o_orderkey", "place")


@query("select p_partkey, cast(row_number() over (order by length(p_name), p_name desc, p_partkey) as integer) as place from part", "part")
def sort_transform(part):
    out = part.add_column("size", lambda r: F.length(r.p_name)).sort(Sort.asc("size").desc("p_name"))
    return out.window(Window.order_by(Sort.asc("p_name", F.length)).row_number("place")).select("p_partkey", "place")


@query("select row_id, cast(row_number() over (order by case when salary is null then 0 when isnan(salary) then 1 else 2 end, salary, row_id, updated_at, loaded_at) as integer) as place from (select distinct row_id, salary, updated_at, loaded_at from testing_window_long)", "testing_window_long")
def sort_nan(pay):
    """Null, NaN, values."""
    t = pay.group_by(GroupBy.on("row_id", "salary", "updated_at", "loaded_at"))
    return t.window(Window.order_by(Sort.asc("salary").asc("row_id").asc("updated_at").asc("loaded_at")).row_number("place")).select("row_id", "place")


@query("select w, cast(row_number() over (order by lower(w), w desc) as integer) as place from (select distinct upper(substring(c_mktsegment, 1, 3)) as w from customer union select distinct lower(substring(c_mktsegment, 1, 3)) from customer)", "customer")
def sort_locale(customer):
    """a < A < b."""
    words = customer.add_column("w", lambda r: F.upper(F.substring(r.c_mktsegment, 1, 3))).select("w")
    both = words.union_all(words.update_column("w", lambda r: F.lower(r.w))).deduplicate(Dedup.on("w"))
    return both.window(Window.order_by(Sort.asc("w")).row_number("place"), locale=True)


@query("select vec_id, unnest(embedding) as embedding from embeddings", "embeddings")
def explode_array(embeddings):
    return embeddings.select("vec_id", "embedding").explode("embedding")


@query("select n_nationkey, unnest(string_split(n_name, '')) as n_name from nation where n_name <> '' union all select n_nationkey, null from nation where coalesce(n_name, '') = ''", "nation")
def explode_string(nation):
    return nation.select("n_nationkey", "n_name").explode("n_name")


@query("select p_partkey, unnest(string_split(p_name, ' ')) as word from part", "part")
def explode_split(part):
    return part.add_column("word", lambda r: F.split(r.p_name, " ")).select("p_partkey", "word").explode("word")


# -- joins ---------------------------------------------------------------------------------------

_C = "(select * from customer where c_acctbal > 0) c"
_O = "(select * from orders where o_totalprice > 100000) o"


def _sides(customer, orders):
    c = customer.filter(lambda r: r.c_acctbal > 0).select("c_custkey", "c_name")
    o = orders.filter(lambda r: r.o_totalprice > 100000).select("o_orderkey", "o_custkey", "o_totalprice")
    return c, o


def _equal(c, o):
    return c.c_custkey == o.o_custkey


_PAIR = "select c_custkey, c_name, o_orderkey, o_custkey, o_totalprice from"


@query(f"{_PAIR} {_C} join {_O} on c_custkey = o_custkey", "customer", "orders")
def inner_join(customer, orders):
    c, o = _sides(customer, orders)
    return c.inner_join(o, _equal)


@query(f"{_PAIR} {_C} left join {_O} on c_custkey = o_custkey", "customer", "orders")
def left_join(customer, orders):
    c, o = _sides(customer, orders)
    return c.left_join(o, _equal)


@query(f"{_PAIR} {_C} right join {_O} on c_custkey = o_custkey", "customer", "orders")
def right_join(customer, orders):
    c, o = _sides(customer, orders)
    return c.right_join(o, _equal)


@query(f"{_PAIR} {_C} full join {_O} on c_custkey = o_custkey", "customer", "orders")
def full_join(customer, orders):
    c, o = _sides(customer, orders)
    return c.full_join(o, _equal)


@query(f"{_PAIR} {_C} full join {_O} on c_custkey = o_custkey where c_custkey is null or o_custkey is null", "customer", "orders")
def full_anti_join(customer, orders):
    c, o = _sides(customer, orders)
    return c.full_anti_join(o, _equal)


@query(f"select c_custkey, c_name from {_C} where not exists (select 1 from {_O} where c_custkey = o_custkey)", "customer", "orders")
def left_anti_join(customer, orders):
    c, o = _sides(customer, orders)
    return c.left_anti_join(o, _equal)


@query(f"select o_orderkey, o_custkey, o_totalprice from {_O} where not exists (select 1 from {_C} where c_custkey = o_custkey)", "customer", "orders")
def right_anti_join(customer, orders):
    c, o = _sides(customer, orders)
    return c.right_anti_join(o, _equal)


@query(f"select c_custkey, c_name from {_C} where exists (select 1 from {_O} where c_custkey = o_custkey)", "customer", "orders")
def left_semi_join(customer, orders):
    c, o = _sides(customer, orders)
    return c.left_semi_join(o, _equal)


@query(f"select o_orderkey, o_custkey, o_totalprice from {_O} where exists (select 1 from {_C} where c_custkey = o_custkey)", "customer", "orders")
def right_semi_join(customer, orders):
    c, o = _sides(customer, orders)
    return c.right_semi_join(o, _equal)


@query("select r_regionkey, r_name from region where exists (select 1 from nation where n_nationkey < r_regionkey * 2 and n_regionkey > 2)", "nation", "region")
def right_semi_text(nation, region):
    """The sides keep their names in a condition given as text."""
    return nation.filter("n_regionkey > 2").right_semi_join(region.select("r_regionkey", "r_name"), "n_nationkey < r_regionkey * 2")


@query("select n_nationkey, n_name from nation b where not exists (select 1 from nation a where a.n_regionkey < 2 and a.n_nationkey < b.n_nationkey)", "nation")
def right_anti_text(nation):
    n = nation.select("n_nationkey", "n_name", "n_regionkey")
    return n.filter("n_regionkey < 2").right_anti_join(n, "`LEFT.n_nationkey` < `RIGHT.n_nationkey`").select("n_nationkey", "n_name")


@query("select n_name, r_name from nation, region", "nation", "region")
def cross_join(nation, region):
    return nation.select("n_name").cross_join(region.select("r_name"))


@query("select a.orderid as \"LEFT.orderid\", b.orderid as \"RIGHT.orderid\" from (select distinct orderid, quantity from shop_orders where productid is null) a join (select distinct orderid, quantity from shop_orders where customerid = '' or customerid is null) b on a.quantity is not distinct from b.quantity and a.orderid < b.orderid", "shop_orders")
def null_safe_join(orders):
    a = orders.filter(lambda r: r.productid.isNull()).group_by(GroupBy.on("orderid", "quantity"))
    b = orders.filter(lambda r: (r.customerid == "") | r.customerid.isNull()).group_by(GroupBy.on("orderid", "quantity"))
    return a.inner_join(b, lambda x, y: (x.quantity == y.quantity) & (x.orderid < y.orderid)).select("LEFT.orderid", "RIGHT.orderid")


@query("select a.n_name as \"LEFT.n_name\", b.n_name as \"RIGHT.n_name\" from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey", "nation")
def self_join(nation):
    return nation.inner_join(nation, lambda a, b: (a.n_regionkey == b.n_regionkey) & (a.n_nationkey < b.n_nationkey)).select("LEFT.n_name", "RIGHT.n_name")


@query("select n_name, r_name from nation full join region on contains(lower(n_name), lower(substring(r_name, 1, 2)))", "nation", "region")
def theta_join(nation, region):
    out = nation.full_join(region, lambda n, r: F.contains(F.lower(n.n_name), F.lower(F.substring(r.r_name, 1, 2))))
    return out.select("n_name", "r_name")


@query("select c_custkey as id, c_name as name from customer union all select s_suppkey, s_name from supplier", "customer", "supplier")
def union_all(customer, supplier):
    s = supplier.select("s_suppkey", "s_name", "s_nationkey").rename("s_suppkey", "id").rename("s_name", "name")
    return customer.select("c_custkey", "c_name").rename("c_custkey", "id").rename("c_name", "name").union_all(s)


@query("select c_custkey, c_name, c_acctbal from customer union all select null, s_name, s_acctbal from supplier", "customer", "supplier")
def append_mapped(customer, supplier):
    return customer.select("c_custkey", "c_name", "c_acctbal").append(Append.source(supplier).set("c_name", "s_name").set("c_acctbal", "s_acctbal"))


# -- deduplicate and group -----------------------------------------------------------------------

_ONE = "select o_orderkey, o_custkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by {}) as n from orders) where n = 1"


@query(_ONE.format("o_orderkey"), "orders")
def dedup_first(orders):
    return orders.deduplicate(Dedup.on("o_custkey")).select("o_orderkey", "o_custkey", "o_totalprice")


@query(_ONE.format("o_orderkey desc"), "orders")
def dedup_last(orders):
    return orders.deduplicate(Dedup.on("o_custkey").last()).select("o_orderkey", "o_custkey", "o_totalprice")


@query(_ONE.format("o_totalprice desc, o_orderkey desc"), "orders")
def dedup_max(orders):
    return orders.deduplicate(Dedup.on("o_custkey").max("o_totalprice")).select("o_orderkey", "o_custkey", "o_totalprice")


@query(_ONE.format("o_totalprice, o_orderkey desc"), "orders")
def dedup_min(orders):
    return orders.deduplicate(Dedup.on("o_custkey").min("o_totalprice")).select("o_orderkey", "o_custkey", "o_totalprice")


@query(_ONE.format("o_orderdate desc, o_orderkey"), "orders")
def dedup_keep_by(orders):
    return orders.deduplicate(Dedup.on("o_custkey").keep_by(F.desc("o_orderdate"))).select("o_orderkey", "o_custkey", "o_totalprice")


@query("select o_orderkey, o_custkey from orders order by o_orderkey limit 1", "orders")
def dedup_without_keys(orders):
    return orders.deduplicate(Dedup.on()).select("o_orderkey", "o_custkey")


@query(_ONE.format("o_totalprice, o_orderkey"), "orders")
def dedup_pandas(orders):
    """The row chosen by a function of the key's rows."""
    out = orders.select("o_orderkey", "o_custkey", "o_totalprice").deduplicate(Dedup.on("o_custkey").resolve_pandas(lambda rows: int(rows["o_totalprice"].argmin())))
    return out.select("o_orderkey", "o_custkey", "o_totalprice")


@query("select n_regionkey, cast(row_number() over (order by first_name desc) as integer) as place from (select n_regionkey, max(n_name) as first_name from nation group by 1)", "nation")
def group_order_desc(nation):
    """Groups are in the order of their first rows, also after a sort by falling text."""
    groups = nation.sort(Sort.desc("n_name")).group_by(GroupBy.on("n_regionkey").count())
    return _rows(nation, [{"n_regionkey": r["n_regionkey"], "place": i} for i, r in enumerate(groups.data, 1)]).update_column("place", lambda r: r.place.cast("int"))


@query("select team, count(*) as count_all, count(salary) as n, round(coalesce(sum(v), 0), 2) as total, round(avg(v), 4) as mean, max(v) as top, min(v) as low from (select *, case when not isnan(salary) then salary end as v from testing_window_long) group by 1", "testing_window_long")
def group_nan(pay):
    """NaN counts but is no value."""
    out = pay.group_by(GroupBy.on("team").count().count("salary", "n").sum("salary", "total").avg("salary", "mean").max("salary", "top").min("salary", "low"))
    return out.update_column("total", lambda r: F.round(r.total, 2)).update_column("mean", lambda r: F.round(r["mean"], 4))


@query("select n_regionkey, arg_max(w, (lower(w), w = upper(w))) as top, arg_min(w, (lower(w), w = upper(w))) as low from (select n_regionkey, case when n_nationkey % 2 = 0 then lower(n_name) else upper(n_name) end as w from nation) group by 1", "nation")
def group_locale(nation):
    """Extremes in locale order: a before A before b."""
    t = nation.add_column("w", lambda r: F.when(r.n_nationkey % 2 == 0, F.lower(r.n_name)).otherwise(F.upper(r.n_name)))
    return t.group_by(GroupBy.on("n_regionkey").max("w", "top").min("w", "low"), locale=True)


@query("select l_returnflag, l_linestatus, count(*) as count_all, count(nullif(l_quantity, 1)) as n, round(sum(l_quantity), 2) as qty, round(avg(l_discount), 6) as disc, min(l_shipdate) as first_ship, max(l_extendedprice) as top from lineitem group by all", "lineitem")
def group_aggregates(lineitem):
    t = lineitem.add_column("q", lambda r: F.nullif(r.l_quantity, F.lit(1.0)))
    g = GroupBy.on("l_returnflag", "l_linestatus").count().count("q", "n").sum("l_quantity", "qty").avg("l_discount", "disc").min("l_shipdate", "first_ship").max("l_extendedprice", "top")
    return t.group_by(g).update_column("qty", lambda r: F.round(r.qty, 2)).update_column("disc", lambda r: F.round(r.disc, 6))


@query("select n_regionkey, coalesce(sum(case when n_regionkey > 2 then n_nationkey end), 0)::bigint as total, avg(case when n_regionkey > 2 then n_nationkey end) as mean from nation group by 1", "nation")
def group_sum_all_null(nation):
    t = nation.update_column("n_nationkey", lambda r: F.when(r.n_regionkey > 2, r.n_nationkey))
    return t.group_by(GroupBy.on("n_regionkey").sum("n_nationkey", "total").avg("n_nationkey", "mean"))


@query("select distinct o_orderstatus, o_orderpriority from orders", "orders")
def group_distinct(orders):
    return orders.group_by(GroupBy.on("o_orderstatus", "o_orderpriority"))


@query("select n_regionkey, string_agg(n_name, ', ' order by n_nationkey) as names from nation group by 1", "nation")
def group_collect(nation):
    return nation.group_by(GroupBy.on("n_regionkey").collect_list("n_name", "names")).update_column("names", lambda r: F.array_join(r.names, ", "))


@query("select c_mktsegment, round(sqrt(avg(c_acctbal * c_acctbal)), 3) as rms from customer group by 1", "customer")
def group_custom_rms(customer):
    return customer.group_by(GroupBy.on("c_mktsegment").custom("c_acctbal", "rms", lambda c: F.round(F.sqrt(F.avg(c * c)), 3)))


@query("select n_regionkey, string_agg(n_name, '|' order by n_nationkey desc) as names from nation group by 1", "nation")
def group_custom_list(nation):
    return nation.group_by(GroupBy.on("n_regionkey").custom_list("n_name", "names", lambda a: F.array_join(F.reverse(a), "|")))


@query("select c_mktsegment, round(median(c_acctbal), 4) as middle from customer group by 1", "customer")
def group_custom_pandas(customer):
    out = customer.group_by(GroupBy.on("c_mktsegment").custom_pandas("c_acctbal", "middle", lambda s: float(s.median()), "double"))
    return out.update_column("middle", lambda r: F.round(r.middle, 4))


# -- windows -------------------------------------------------------------------------------------

_W = "over (partition by o_custkey order by o_orderdate, o_orderkey"
_SPEC = Window.partition_by("o_custkey").order_by(Sort.asc("o_orderdate"))


@query(f"select o_orderkey, cast(row_number() {_W}) as integer) as row_number, cast(rank() over (partition by o_custkey order by o_orderdate) as integer) as rank, cast(dense_rank() over (partition by o_custkey order by o_orderdate) as integer) as dense_rank, cast(ntile(3) {_W}) as integer) as ntile from orders", "orders")
def win_ranking(orders):
    return orders.window(_SPEC.row_number().rank().dense_rank().ntile(3)).select("o_orderkey", "row_number", "rank", "dense_rank", "ntile")


@query(f"select o_orderkey, lead(o_totalprice, 2) {_W}) as lead_2_o_totalprice, lag(o_totalprice, 1, -1) {_W}) as before from orders", "orders")
def win_lead_lag(orders):
    return orders.window(_SPEC.lead("o_totalprice", 2).lag("o_totalprice", 1, "before", -1.0)).select("o_orderkey", "lead_2_o_totalprice", "before")


_ALL = "rows between unbounded preceding and unbounded following)"


@query(f"select o_orderkey, first_value(o_totalprice) {_W} {_ALL} as first_o_totalprice, last_value(o_totalprice) {_W} {_ALL} as last_o_totalprice, nth_value(o_totalprice, 3) {_W} {_ALL} as third, last_value(o_totalprice) {_W} rows between 2 preceding and 1 preceding) as back from orders", "orders")
def win_values(orders):
    spec = _SPEC.first_value("o_totalprice").last_value("o_totalprice").nth_value("o_totalprice", 2, "third").last_value("o_totalprice", "back", WindowFrame.rows(-2, -1))
    return orders.window(spec).select("o_orderkey", "first_o_totalprice", "last_o_totalprice", "third", "back")


@query(f"select o_orderkey, count(*) over (partition by o_custkey) as count_all, count(nullif(o_orderstatus, 'F')) over (partition by o_custkey) as n, round(sum(o_totalprice) over (partition by o_custkey), 2) as total, avg(cast(round(o_totalprice * 100) as bigint)) over (partition by o_custkey) as mean_cents, max(o_totalprice) over (partition by o_custkey) as top, min(o_totalprice) over (partition by o_custkey) as low from orders", "orders")
def win_aggregates(orders):
    t = orders.add_column("s", lambda r: F.nullif(r.o_orderstatus, F.lit("F"))).add_column("cents", lambda r: F.round(r.o_totalprice * 100).cast("bigint"))
    spec = Window.partition_by("o_custkey").count().count("s", "n").sum("o_totalprice", "total").avg("cents", "mean_cents").max("o_totalprice", "top").min("o_totalprice", "low")
    out = t.window(spec).update_column("total", lambda r: F.round(r.total, 2))
    return out.select("o_orderkey", "count_all", "n", "total", "mean_cents", "top", "low")


@query(f"select o_orderkey, round(coalesce(sum(o_totalprice) {_W} rows between 3 preceding and 2 preceding), 0), 2) as earlier, round(avg(o_totalprice) {_W} rows between 1 preceding and 1 following), 3) as around, count(*) {_W} rows between current row and unbounded following) as rest from orders", "orders")
def win_frames(orders):
    spec = _SPEC.sum("o_totalprice", "earlier", WindowFrame.rows(-3, -2)).avg("o_totalprice", "around", WindowFrame.rows(-1, 1)).count(None, "rest", WindowFrame.rows(0, WindowFrame.end))
    out = orders.window(spec).update_column("earlier", lambda r: F.round(r.earlier, 2)).update_column("around", lambda r: F.round(r.around, 3))
    return out.select("o_orderkey", "earlier", "around", "rest")


@query(f"select o_orderkey, array_to_string(list(o_orderstatus) {_W} rows between 2 preceding and current row), '') as recent, greatest(o_totalprice, coalesce(lag(o_totalprice) {_W}), o_totalprice), coalesce(lead(o_totalprice) {_W}), o_totalprice)) as peak from orders", "orders")
def win_collect_and_custom(orders):
    spec = _SPEC.collect_list("o_orderstatus", "recent", WindowFrame.rows(-2, 0)).custom_frame("o_totalprice", "peak", F.array_max, WindowFrame.rows(-1, 1))
    return orders.window(spec).update_column("recent", lambda r: F.array_join(r.recent, "")).select("o_orderkey", "recent", "peak")


@query(f"select o_orderkey, round(median(o_totalprice) {_W} rows between 2 preceding and 2 following), 3) as middle, array_to_string(list(o_orderstatus) {_W} {_ALL}, '') as statuses from orders", "orders")
def win_custom_frames(orders):
    """A pandas function of a frame, and a function of whole partitions."""
    spec = _SPEC.custom_frame_pandas("o_totalprice", "middle", lambda s: float(s.median()), "double", WindowFrame.rows(-2, 2))
    out = orders.window(spec.custom_frame("o_orderstatus", "statuses", lambda a: F.array_join(a, "")))
    return out.update_column("middle", lambda r: F.round(r.middle, 3)).select("o_orderkey", "middle", "statuses")


@query("select n_nationkey, max(lower(n_name)) over (partition by n_regionkey order by n_nationkey rows between 1 preceding and 1 following) as top from nation", "nation")
def win_locale(nation):
    spec = Window.partition_by("n_regionkey").order_by(Sort.asc("n_nationkey")).max("w", "top", WindowFrame.rows(-1, 1))
    out = nation.add_column("w", lambda r: F.when(r.n_nationkey % 2 == 0, F.lower(r.n_name)).otherwise(F.upper(r.n_name))).window(spec, locale=True)
    return out.update_column("top", lambda r: F.lower(r.top)).select("n_nationkey", "top")


@query("select n_nationkey, cast(row_number() over (partition by n_regionkey order by n_name desc) * 10 as bigint) as place from nation", "nation")
def win_custom_partition(nation):
    spec = Window.partition_by("n_regionkey").order_by(Sort.desc("n_name")).custom_partition("place", lambda rows: (rows.index + 1) * 10, "bigint")
    return nation.window(spec).select("n_nationkey", "place")


@query("select o_orderkey, count(*) over (partition by o_orderstatus order by o_custkey range between 5 preceding and 5 following) as near from orders", "orders")
def win_range_frame(orders):
    spec = Window.partition_by("o_orderstatus").order_by(Sort.asc("o_custkey")).count(None, "near", WindowFrame.range("o_custkey", -5, 5))
    return orders.window(spec).select("o_orderkey", "near")


@query("select p_partkey, cast(rank() over (partition by p_brand order by length(p_name), p_name) as integer) as place from part", "part")
def win_rank_transform(part):
    """Rank by a transformed value: ties are equal raw values, so rows of one length are in source order."""
    t = part.sort(Sort.asc("p_name"))
    return t.window(Window.partition_by("p_brand").order_by(Sort.asc("p_name", F.length)).rank("place")).select("p_partkey", "place")


# -- shapes --------------------------------------------------------------------------------------

_AGG = "select o_orderstatus, o_orderpriority, count(*) as n, round(max(o_totalprice), 2) as top from orders group by all"


def _status(orders):
    g = orders.group_by(GroupBy.on("o_orderstatus", "o_orderpriority").count(None, "n").max("o_totalprice", "top"))
    return g.update_column("top", lambda r: F.round(r.top, 2))


@query(f'select o_orderpriority, max(n) filter (o_orderstatus = \'F\') as "F_n", max(top) filter (o_orderstatus = \'F\') as "F_top", max(n) filter (o_orderstatus = \'O\') as "O_n", max(top) filter (o_orderstatus = \'O\') as "O_top", max(n) filter (o_orderstatus = \'P\') as "P_n", max(top) filter (o_orderstatus = \'P\') as "P_top" from ({_AGG}) group by 1', "orders")
def pivot(orders):
    return _status(orders).pivot(Pivot.on("o_orderstatus").values("n", "top"))


@query(f"select o_orderstatus, coalesce(max(n) filter (o_orderpriority = '1-URGENT'), -1) as \"1-URGENT_n\", coalesce(max(n) filter (o_orderpriority = 'none'), -1) as none_n from ({_AGG}) group by 1", "orders")
def pivot_fill(orders):
    return _status(orders).drop("top").filter(lambda r: F.lit(True)).pivot(Pivot.on("o_orderpriority").values("n").fill_missing(-1).only("1-URGENT", "none"))


@query("select cast(row_number() over (order by o_orderstatus desc) as integer) as place, o_orderstatus || '_n' as name from (select distinct o_orderstatus from orders)", "orders")
def pivot_order_desc(orders):
    """New columns are in the order of the rows in which their values come first."""
    wide = _status(orders).drop("top").sort(Sort.desc("o_orderstatus")).pivot(Pivot.on("o_orderstatus").values("n"))
    names = [c for c in wide.columns if c.endswith("_n")]
    return _rows(orders, [{"place": i, "name": c} for i, c in enumerate(names, 1)]).update_column("place", lambda r: r.place.cast("int"))


@query("select s_suppkey, 's_nationkey' as field, cast(s_nationkey as varchar) as content from supplier union all select s_suppkey, 's_name', nullif(s_name, 'Supplier#000000001') from supplier", "supplier")
def melt(supplier):
    t = supplier.select("s_suppkey", "s_nationkey", "s_name").update_column("s_name", lambda r: F.nullif(r.s_name, F.lit("Supplier#000000001")))
    return t.melt(Melt.columns("s_nationkey", "s_name").names_to("field").values_to("content").cast_to("string"))


@query(f"select o_orderpriority, o_orderstatus || '_n' as type, n as value from ({_AGG})", "orders")
def melt_pivot_roundtrip(orders):
    wide = _status(orders).drop("top").pivot(Pivot.on("o_orderstatus").values("n"))
    return wide.melt(Melt.columns(*(c for c in wide.columns if c.endswith("_n")))).filter(lambda r: r.value.isNotNull())


# -- merge ---------------------------------------------------------------------------------------

_T = "(select c_custkey as id, c_name as name, c_acctbal as balance, c_mktsegment as segment from customer where c_custkey % 4 <> 0)"
_S = "(select c_custkey as id, upper(c_name) as name, round(c_acctbal + 1, 2) as balance, c_mktsegment as segment from customer where c_custkey % 3 <> 0)"
_TS = f"from {_T} t full join {_S} s on t.id = s.id"


def _merge_sides(customer):
    t = customer.select("c_custkey", "c_name", "c_acctbal", "c_mktsegment").rename("c_custkey", "id").rename("c_name", "name").rename("c_acctbal", "balance").rename("c_mktsegment", "segment")
    source = t.filter(lambda r: r.id % 3 != 0).update_column("name", lambda r: F.upper(r.name)).update_column("balance", lambda r: F.round(r.balance + 1, 2))
    return t.filter(lambda r: r.id % 4 != 0), Merge.source(source, lambda a, b: a.id == b.id)


@query(f"select coalesce(s.id, t.id) as id, coalesce(s.name, t.name) as name, coalesce(s.balance, t.balance) as balance, coalesce(s.segment, t.segment) as segment {_TS} where s.id is not null", "customer")
def merge_full_sync(customer):
    t, m = _merge_sides(customer)
    return t.merge(m.present_in_both().update().present_in_source().insert().present_in_target().delete())


@query(f"select t.id, case when s.id is not null then s.name else t.name end as name, t.balance, t.segment {_TS} where t.id is not null", "customer")
def merge_update_only(customer):
    t, m = _merge_sides(customer)
    return t.merge(m.present_in_both().update("name", "name"))


@query(f"select coalesce(t.id, s.id) as id, coalesce(t.name, s.name) as name, case when t.id is null then null else t.balance end as balance, t.segment {_TS}", "customer")
def merge_insert_only(customer):
    t, m = _merge_sides(customer)
    return t.merge(m.present_in_source().insert("id", "id").insert("name", "name"))


@query(f"select coalesce(t.id, s.id) as id, coalesce(t.name, s.name) as name, case when t.id is null then s.balance when s.id is not null and s.balance > 5000 then s.balance when s.id is null and t.balance < 0 then 0 else t.balance end as balance, coalesce(t.segment, s.segment) as segment {_TS} where t.id is not null or s.segment = 'BUILDING'", "customer")
def merge_conditional(customer):
    t, m = _merge_sides(customer)
    m = m.present_in_both().when(lambda a, b: b.balance > 5000).update("balance", "balance")
    m = m.present_in_source().when(lambda b: b.segment == "BUILDING").insert()
    return t.merge(m.present_in_target().when(lambda a: a.balance < 0).update("balance", lambda a: F.lit(0.0)))


@query(f"select t.id, t.name, t.balance, t.segment {_TS} where t.id is not null and not coalesce(s.id is not null and s.balance > 5000, false) and not (s.id is null and t.segment = 'MACHINERY')", "customer")
def merge_delete(customer):
    t, m = _merge_sides(customer)
    m = m.present_in_both().update("name", "name").when(lambda a, b: b.balance > 5000).delete().reset_when().update("name", lambda a, b: a.name)
    return t.merge(m.present_in_target().when(lambda a: a.segment == "MACHINERY").delete())


@query(f"select t.id, t.name, case when s.id is null then t.balance when t.balance > 1000 then t.balance * 2 else s.balance end as balance, t.segment {_TS} where t.id is not null", "customer")
def merge_last_wins(customer):
    t, m = _merge_sides(customer)
    return t.merge(m.present_in_both().update("balance", "balance").when(lambda a, b: a.balance > 1000).update("balance", lambda a, b: a.balance * 2))


# -- flagship ------------------------------------------------------------------------------------


@query("""
with v as (
  select n_name, c_custkey, c_name, cast(sum(cast(round(l_extendedprice * 100) as bigint) * (100 - cast(round(l_discount * 100) as bigint))) as bigint) as units
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
  where l_shipdate >= timestamp '1994-01-01' group by all)
select n_name, c_name, cast(floor(units / 100) as bigint) as revenue_cents, cast(place as integer) as place
from (select *, row_number() over (partition by n_name order by units desc, c_custkey) as place from v) where place <= 3""", "lineitem", "orders", "customer", "nation")
def flagship(lineitem, orders, customer, nation):
    """The three best customers of each nation by revenue, in whole numbers so that sums are exact."""
    units = lambda r: F.round(r.l_extendedprice * 100).cast("bigint") * (100 - F.round(r.l_discount * 100).cast("bigint"))
    items = lineitem.filter("l_shipdate >= timestamp_ntz'1994-01-01'").add_column("value", units).select("l_orderkey", "value")
    joined = items.inner_join(orders.select("o_orderkey", "o_custkey"), lambda a, b: a.l_orderkey == b.o_orderkey, sql_eq=True)
    sums = joined.group_by(GroupBy.on("o_custkey").sum("value", "units"))  # a row per customer before names are joined to it
    named = sums.inner_join(customer.select("c_custkey", "c_name", "c_nationkey"), lambda a, b: a.o_custkey == b.c_custkey, sql_eq=True)
    named = named.inner_join(nation.select("n_nationkey", "n_name"), lambda a, b: a.c_nationkey == b.n_nationkey, sql_eq=True)
    by_customer = Table.from_df(named.df, ["c_custkey"])
    ranked = by_customer.window(Window.partition_by("n_name").order_by(Sort.desc("units")).row_number("place"))
    best = ranked.filter(lambda r: r.place <= 3).add_column("revenue_cents", lambda r: F.floor(r.units / 100))
    return best.select("n_name", "c_name", "revenue_cents", "place")
