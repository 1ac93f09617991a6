import json
import math

import pytest
from pyspark.sql import functions as F

from weft import Append, Dedup, GroupBy, Melt, Merge, Pivot, Sort, Table, TableError, Window, WindowFrame

NAN = float("nan")


def tuples(t):
    return [tuple(r.values()) for r in t.data]


@pytest.fixture
def shop(spark):
    orders = Table.from_rows(spark, [{"orderid": o, "productid": p, "quantity": q} for o, p, q in [(101, "P1", 2), (102, "P2", 1), (103, "P1", 5), (104, "P3", 1), (105, "P4", 7)]])
    product = Table.from_rows(spark, [{"product id": p, "productname": n, "price": x} for p, n, x in [("P1", "Lamp", 5.0), ("P2", "Stool", 7.5), ("P2", "Stool B", 8.0), ("P3", "Crate", 2.0), ("P5", "Drill", 60.0)]])
    return orders, product.rename_glob("* *", "$0$1")


@pytest.fixture
def pay(spark):
    rows = [("A", "Ann", 6500.0), ("A", "Bo", 7300.0), ("A", "Cy", None), ("B", "Di", 5000.0), ("A", "Ed", 7300.0), ("B", "Flo", 6100.0), ("A", "Gus", 8000.0), ("B", "Hal", NAN)]
    return Table.from_rows(spark, [dict(zip(("team", "name", "salary"), r)) for r in rows])


# -- sources, actions


def test_sources_keep_order_and_reject_bad_rows(spark, tmp_path):
    t = Table.from_rows(spark, [{"b": 1, "a": "x"}, {"a": None, "b": 2.5}])
    assert t.columns == ["b", "a"] and tuples(t) == [(1.0, "x"), (2.5, None)] and t.count() == 2
    for bad in ([], "x", [1], [{"a": 1}, {"b": 1}], [{"a": 1}, {"a": "x"}]):
        with pytest.raises(TableError):
            Table.from_rows(spark, bad)
    e = Table.empty(spark, "x", "y")
    assert e.columns == ["x", "y"] and e.data == []
    for bad in ((), ("x", "x")):
        with pytest.raises(TableError):
            Table.empty(spark, *bad)
    (tmp_path / "j.json").write_text(json.dumps([{"b": "1", "a": "2"}]))
    assert Table.read_json(spark, str(tmp_path / "j.json"), "b string, a string").data == [{"b": "1", "a": "2"}]
    t.df.write.parquet(str(tmp_path / "p"))
    assert tuples(Table.read_parquet(spark, str(tmp_path / "p"), ["b"])) == [(1.0, "x"), (2.5, None)]


def test_actions(spark, capsys):
    t = Table.from_rows(spark, [{"a": i} for i in range(4)])
    assert t.execute().data == t.data
    t.log(2, "title")
    t.log(-1)
    assert capsys.readouterr().out.splitlines() == ["title", "a", "0", "1", "a", "3"]
    t.take(1).print_json()
    assert json.loads(capsys.readouterr().out) == [{"a": 0}]
    assert "Optimized Logical Plan" in t.logic_plan


# -- columns


def test_projection(spark):
    t = Table.from_rows(spark, [{"LEFT.a": 1, "LEFT.b": 2, "c": 3}])
    assert t.select("c", "LEFT.a", "c").columns == ["c", "LEFT.a"] and t.select().columns == t.columns
    assert t.select_glob("LEFT.*").columns == ["LEFT.a", "LEFT.b"]
    assert t.drop_glob("*.b").columns == ["LEFT.a", "c"] and t.drop_glob("zz*").columns == t.columns
    assert t.drop("c").columns == ["LEFT.a", "LEFT.b"]
    assert t.rename("c", "d").data == [{"LEFT.a": 1, "LEFT.b": 2, "d": 3}]
    assert t.rename_glob("*.*", "$1_$0").columns == ["a_LEFT", "b_LEFT", "c"]
    swapped = Table.from_rows(spark, [{"x": 1, "y": 2}]).rename_all(lambda n: {"x": "y", "y": "x"}[n])
    assert swapped.data == [{"y": 1, "x": 2}]
    for bad in (
        lambda: t.select("zz"), lambda: t.drop(), lambda: t.drop("zz"), lambda: t.rename("c", "1x"), lambda: t.rename("c", "LEFT.a"),
        lambda: t.rename_glob("*.*", "$2"), lambda: t.rename_glob("LEFT.*", "same"), lambda: t.rename_all(lambda n: "same"), lambda: t.select_glob("q*"),
        lambda: t.add_column("c", lambda r: r.c), lambda: t.update_column("zz", lambda r: r.c), lambda: t.add_column("x", lambda r: r.zz), lambda: t.add_column("x", 3),
    ):
        with pytest.raises(TableError):
            bad()


def test_columns_see_earlier_columns(spark):
    t = Table.from_rows(spark, [{"a": 2}]).add_column("b", lambda r: r.a * 3).update_column("a", lambda r: r.b + 1).add_column("c", "a + b")
    assert t.data == [{"a": 7, "b": 6, "c": 13}]


# -- rows


def test_filter_equality_treats_null_as_value(spark):
    t = Table.from_rows(spark, [{"a": 1}, {"a": None}, {"a": 3}])
    assert tuples(t.filter(lambda r: r.a != 1)) == [(None,), (3,)]
    assert tuples(t.filter(lambda r: r.a != 1, sql_eq=True)) == [(3,)]
    assert tuples(t.filter("a > 1")) == [(3,)]
    with pytest.raises(TableError):
        t.filter(lambda r: r.a)


def test_take_and_sort(spark):
    t = Table.from_rows(spark, [{"a": x, "i": i} for i, x in enumerate([2.0, None, NAN, 1.0, 2.0])])
    up = [r["i"] for r in t.sort(Sort.asc("a")).data]
    down = [r["i"] for r in t.sort(Sort.desc("a")).data]
    assert up == [1, 2, 3, 0, 4] and down == [0, 4, 3, 2, 1]
    assert [r["i"] for r in t.take(2, 1).data] == [1, 2] and t.take(9, 4).count() == 1
    words = Table.from_rows(spark, [{"w": w} for w in ["B", "a", "b", "A", "ccc"]])
    assert [r["w"] for r in words.sort(Sort.asc("w")).data] == ["A", "B", "a", "b", "ccc"]
    assert [r["w"] for r in words.sort(Sort.asc("w"), locale=True).data] == ["a", "A", "b", "B", "ccc"]
    assert [r["w"] for r in words.sort(Sort.desc("w", F.length)).data][0] == "ccc"
    for bad in (lambda: t.take(-1), lambda: t.take(1, -1), lambda: t.take(1.5), lambda: Sort.asc("a").desc("a"), lambda: t.sort(Sort.asc("zz")), lambda: t.sort(Sort())):
        with pytest.raises(TableError):
            bad()


def test_explode(spark):
    t = Table.from_rows(spark, [{"b": "x|y", "i": 1}, {"b": "z", "i": 2}]).add_column("p", lambda r: F.split(r.b, r"\|"))
    assert [(r["i"], r["p"]) for r in t.explode("p").data] == [(1, "x"), (1, "y"), (2, "z")]
    s = Table.from_rows(spark, [{"s": "ab"}, {"s": ""}, {"s": None}]).explode("s")
    assert tuples(s) == [("a",), ("b",), (None,), (None,)]
    with pytest.raises(TableError):
        t.explode("i")


# -- two tables


def test_join_family(shop):
    o, p = shop
    on = lambda a, b: a.productid == b.productid
    joined = o.inner_join(p, on)
    assert joined.columns == ["orderid", "LEFT.productid", "quantity", "RIGHT.productid", "productname", "price"]
    counts = [f(p, on).count() for f in (o.inner_join, o.left_join, o.right_join, o.full_join, o.full_anti_join, o.left_anti_join, o.right_anti_join, o.left_semi_join, o.right_semi_join)]
    assert counts == [5, 6, 6, 7, 2, 1, 1, 4, 4]
    assert o.cross_join(p).count() == 25 and o.union_all(o).count() == 10
    assert [r["orderid"] for r in o.left_join(p, on).data] == [101, 102, 102, 103, 104, 105]
    assert [r["orderid"] for r in o.right_join(p, on).data] == [101, 103, 102, 102, 104, None]
    assert [(r["orderid"], r["productname"]) for r in o.full_anti_join(p, on).data] == [(105, None), (None, "Drill")]
    assert [r["orderid"] for r in o.full_join(p, on).data][-2:] == [105, None]
    assert o.left_anti_join(p, on).data == [{"orderid": 105, "productid": "P4", "quantity": 7}]
    assert o.right_semi_join(p, on).columns == p.columns


def test_null_keys_self_and_theta_joins(spark):
    e = Table.from_rows(spark, [{"id": i, "boss": b} for i, b in [(1, None), (2, 1), (3, 1), (4, 9)]])
    named = e.left_join(e, lambda a, b: a.boss == b.id)
    assert [(r["LEFT.id"], r["RIGHT.id"]) for r in named.data] == [(1, None), (2, 1), (3, 1), (4, None)]
    assert e.inner_join(e, lambda a, b: a.boss == b.boss).count() == 1 + 4 + 1
    assert e.inner_join(e, lambda a, b: a.boss == b.boss, sql_eq=True).count() == 5
    assert e.inner_join(e, lambda a, b: a.id < b.id).count() == 6
    with pytest.raises(TableError):
        e.inner_join(e, lambda a, b: a.id)
    with pytest.raises(TableError):
        e.inner_join("x", lambda a, b: a.id == b.id)


def test_unions(spark):
    a = Table.from_rows(spark, [{"x": 1, "y": "a"}])
    b = Table.from_rows(spark, [{"y": "b", "x": 2, "z": 0}, {"y": "c", "x": 1, "z": 0}])
    assert tuples(a.union_all(b)) == [(1, "a"), (2, "b"), (1, "c")]
    assert tuples(a.append(Append.source(b).set("x", "z"))) == [(1, "a"), (0, None), (0, None)]
    for bad in (lambda: b.union_all(a), lambda: a.append(Append.source(b)), lambda: Append.source(b).set("x", "z").set("x", "y"), lambda: a.append(Append.source(b).set("q", "z"))):
        with pytest.raises(TableError):
            bad()


# -- deduplicate, group, window


def test_deduplicate(spark):
    rows = [("a", 1.0), ("b", 5.0), ("a", 3.0), ("a", 3.0), ("b", None), ("c", NAN), ("a", NAN)]
    t = Table.from_rows(spark, [{"k": k, "v": v, "i": i} for i, (k, v) in enumerate(rows)])
    ids = lambda d: [r["i"] for r in t.deduplicate(d).data]
    assert ids(Dedup.on("k")) == [0, 1, 5]
    assert ids(Dedup.on("k").last()) == [6, 4, 5]
    assert ids(Dedup.on("k").max("v")) == [3, 1, 5]
    assert ids(Dedup.on("k").min("v")) == [0, 1, 5]
    assert ids(Dedup.on("k").keep_by(F.desc("i"))) == [6, 4, 5]
    assert ids(Dedup.on("k").resolve_pandas(lambda rows: len(rows) - 1)) == [6, 4, 5]
    assert ids(Dedup.on()) == [0]
    with pytest.raises(TableError):
        Dedup.on("k").last().max("v")
    with pytest.raises(TableError):
        t.deduplicate(Dedup.on("zz"))


def test_group_by(pay):
    g = GroupBy.on("team").count().count("salary").sum("salary").avg("salary").max("salary").min("salary").collect_list("name")
    out = pay.group_by(g).data
    assert out[0] == {"team": "A", "count_all": 5, "count_salary": 4, "sum_salary": 29100.0, "avg_salary": 7275.0, "max_salary": 8000.0, "min_salary": 6500.0, "collectList_name": ["Ann", "Bo", "Cy", "Ed", "Gus"]}
    assert out[1]["count_salary"] == 3 and out[1]["sum_salary"] == 11100.0 and out[1]["max_salary"] == 6100.0
    none = pay.filter(lambda r: r.salary.isNull()).group_by(GroupBy.on("team").sum("salary").avg("salary")).data
    assert none == [{"team": "A", "sum_salary": 0.0, "avg_salary": None}]
    lists = pay.sort(Sort.desc("name")).group_by(GroupBy.on("team").custom_list("salary", "n", F.size).collect_list("name", "names")).data
    assert lists[0]["team"] == "B" or lists[0]["names"][0] in ("Gus", "Hal")
    assert {r["team"]: r["names"] for r in lists} == {"A": ["Gus", "Ed", "Cy", "Bo", "Ann"], "B": ["Hal", "Flo", "Di"]}
    rms = pay.group_by(GroupBy.on("team").custom("salary", "rms", lambda c: F.sqrt(F.avg(F.nanvl(c, F.lit(None).cast("double")) ** 2)))).data
    assert math.isclose(rms[1]["rms"], math.sqrt((5000**2 + 6100**2) / 2))
    spread = pay.group_by(GroupBy.on("team").custom_pandas("salary", "spread", lambda s: float(s.max() - s.min()), "double")).data
    assert [r["spread"] for r in spread] == [1500.0, 1100.0]
    for bad in (
        lambda: GroupBy.on(), lambda: GroupBy.on("a").sum("x").sum("x"), lambda: pay.group_by(GroupBy.on("team").sum("name")), lambda: pay.group_by(GroupBy.on("team").sum("salary", "name")),
        lambda: pay.group_by(GroupBy.on("zz")),
    ):
        with pytest.raises(TableError):
            bad()


def test_locale_extremes(spark):
    t = Table.from_rows(spark, [{"k": 1, "w": w} for w in ["B", "a", "b", "A"]])
    g = GroupBy.on("k").max("w").min("w")
    assert tuples(t.group_by(g)) == [(1, "b", "A")] and tuples(t.group_by(g, locale=True)) == [(1, "B", "a")]


def test_window(pay):
    spec = Window.partition_by("team").order_by(Sort.asc("salary")).row_number().rank().dense_rank().ntile(2).lead("salary", 2).lag("name", default="-")
    a = [r for r in pay.window(spec).data if r["team"] == "A"]
    assert [(r["name"], r["row_number"], r["rank"], r["dense_rank"], r["ntile"], r["lead_2_salary"], r["lag_1_name"]) for r in a] == [
        ("Cy", 1, 1, 1, 1, 7300.0, "-"), ("Ann", 2, 2, 2, 1, 7300.0, "Cy"), ("Bo", 3, 3, 3, 1, 8000.0, "Ann"), ("Ed", 4, 3, 3, 2, None, "Bo"), ("Gus", 5, 5, 4, 2, None, "Ed"),
    ]
    spec = Window.partition_by("team").order_by(Sort.asc("name")).first_value("name").last_value("name").nth_value("name", 9).count().count("salary").sum("salary").avg("salary").max("salary").min("salary")
    b = [r for r in pay.window(spec).data if r["team"] == "B"][0]
    assert [b[c] for c in ("first_name", "last_name", "nth_name", "count_all", "count_salary", "sum_salary", "avg_salary", "max_salary", "min_salary")] == ["Di", "Hal", None, 3, 3, 11100.0, 5550.0, 6100.0, 5000.0]


def test_window_frames(spark):
    t = Table.from_rows(spark, [{"v": v} for v in [1, 2, 4, 8]])
    spec = Window.order_by(Sort.asc("v")).sum("v", "far", WindowFrame.rows(-3, -2)).collect_list("v", "near", WindowFrame.rows(-1, 1)).custom_frame("v", "top", F.array_max, WindowFrame.rows(0, WindowFrame.end))
    spec = spec.count(None, "close", WindowFrame.range("v", -2, 2)).custom_partition("half", lambda rows: rows.v / 2, "double")
    assert tuples(t.window(spec)) == [(1, 0, [1, 2], 8, 2, 0.5), (2, 0, [1, 2, 4], 8, 3, 1.0), (4, 1, [2, 4, 8], 8, 2, 2.0), (8, 3, [4, 8], 8, 1, 4.0)]
    assert [r["count_all"] for r in t.window(Window().count()).data] == [4] * 4


def test_ranks_tie_on_raw_values(spark):
    t = Table.from_rows(spark, [{"w": w} for w in ["bb", "aa", "c", None, None]])
    out = t.window(Window.order_by(Sort.asc("w", F.length)).rank().dense_rank()).data
    assert [(r["w"], r["rank"], r["dense_rank"]) for r in out] == [(None, 1, 1), (None, 1, 1), ("c", 3, 2), ("bb", 4, 3), ("aa", 5, 4)]


@pytest.mark.parametrize(
    "bad",
    [
        lambda: Window.partition_by("a").row_number(), lambda: Window.order_by(Sort.asc("a")).partition_by("a"), lambda: Window.partition_by("a").partition_by("b"),
        lambda: Window.order_by(Sort.asc("a")).order_by(Sort.asc("b")), lambda: Window.order_by(Sort.asc("a")).ntile(0), lambda: Window.order_by(Sort.asc("a")).nth_value("a", -1),
        lambda: Window.order_by(Sort.asc("a")).lead("a", -1), lambda: WindowFrame.rows(2, 1), lambda: Window.partition_by("a").count().count(), lambda: Window.partition_by("a").build(),
    ],
)
def test_window_builder_errors(bad):
    with pytest.raises(TableError):
        bad()


# -- shapes


def test_pivot_and_melt(spark):
    sales = Table.from_rows(spark, [{"store": s, "item": i, "units": u} for s, i, u in [("S1", "Lamp", 3), ("S1", "Crate", None), ("S2", "Lamp", 4)]])
    wide = sales.pivot(Pivot.on("item").values("units"))
    assert wide.data == [{"store": "S1", "Lamp_units": 3, "Crate_units": None}, {"store": "S2", "Lamp_units": 4, "Crate_units": None}]
    filled = sales.pivot(Pivot.on("item").values("units").fill_missing(0)).data
    assert filled[0]["Crate_units"] is None and filled[1]["Crate_units"] == 0
    assert sales.pivot(Pivot.on("item").values("units").only("Crate", None)).columns == ["store", "Crate_units", "null_units"]
    back = wide.melt(Melt.columns("Lamp_units", "Crate_units").names_to("item").values_to("units"))
    assert tuples(back) == [("S1", "Lamp_units", 3), ("S1", "Crate_units", None), ("S2", "Lamp_units", 4), ("S2", "Crate_units", None)]
    assert sales.filter(F.lit(False)).pivot(Pivot.on("item").values("units")).columns == ["store"]
    with pytest.raises(Exception, match="several rows"):
        sales.union_all(sales).pivot(Pivot.on("item").values("units")).df.collect()
    for bad in (
        lambda: sales.pivot(Pivot.on("item")), lambda: sales.melt(Melt.columns("store", "units")), lambda: sales.melt(Melt.columns("units").names_to("v").values_to("v")),
        lambda: sales.melt(Melt.columns("units").names_to("store")), lambda: sales.pivot(Pivot.on("zz").values("units")),
    ):
        with pytest.raises(TableError):
            bad()
    assert sales.melt(Melt.columns("item", "units").cast_to("string")).count() == 6


# -- merge


@pytest.fixture
def staff(spark):
    cols = ("id", "name", "pay")
    t = Table.from_rows(spark, [dict(zip(cols, r)) for r in [(1, "Ann", 10), (2, "Bo", 20), (3, "Cy", 30)]])
    s = Table.from_rows(spark, [dict(zip(cols, r)) for r in [(4, "Di", 40), (2, "Bob", 25), (1, "Ann", 11)]])
    return t, Merge.source(s, lambda a, b: a.id == b.id)


def test_merge_commands(staff):
    t, m = staff
    sync = m.present_in_both().update().present_in_source().insert().present_in_target().delete()
    assert tuples(t.merge(sync)) == [(1, "Ann", 11), (2, "Bob", 25), (4, "Di", 40)]
    assert tuples(t.merge(m.present_in_source().insert("id", "id"))) == [(1, "Ann", 10), (2, "Bo", 20), (3, "Cy", 30), (4, None, None)]
    later = m.present_in_both().update("pay", "pay").when(lambda a, b: a.name != b.name).update("pay", lambda a, b: a.pay + b.pay)
    assert tuples(t.merge(later)) == [(1, "Ann", 11), (2, "Bo", 45), (3, "Cy", 30)]
    gone = m.present_in_both().update().when(lambda a, b: b.pay > 20).delete().reset_when().update("name", lambda a, b: F.lit("x"))
    assert tuples(t.merge(gone)) == [(1, "x", 11), (3, "Cy", 30)]
    only = m.present_in_target().when(lambda a: a.pay > 10).update("pay", lambda a: a.pay * 2)
    assert tuples(t.merge(only)) == [(1, "Ann", 10), (2, "Bo", 20), (3, "Cy", 60)]
    limited = m.present_in_source().when(lambda b: b.pay > 100).insert()
    assert tuples(t.merge(limited)) == tuples(t)


def test_merge_cardinality_types_and_errors(spark, staff):
    t, m = staff
    twice = Table.from_rows(spark, [{"id": 1, "pay": 1}, {"id": 1, "pay": 2}])
    with pytest.raises(Exception, match="several source rows"):
        t.merge(Merge.source(twice, lambda a, b: a.id == b.id).present_in_source().insert("id", "id")).data
    double = Table.from_rows(spark, [{"id": 1, "name": "a", "pay": 1}, {"id": 1, "name": "b", "pay": 2}])
    assert [r[2] for r in tuples(double.merge(m.present_in_both().update("pay", "pay")))] == [11, 11]
    with pytest.raises(TableError):
        t.merge(m.present_in_both().update("pay", lambda a, b: F.lit("sold out")))
    wide = t.merge(m.present_in_both().update("pay", lambda a, b: F.lit("sold out")), allow_type_widening=True)
    assert tuples(wide) == [(1, "Ann", "sold out"), (2, "Bo", "sold out"), (3, "Cy", "30")]
    empty = Table.empty(spark, schema="id bigint, name string, pay bigint")
    assert tuples(empty.merge(m.present_in_source().insert())) == [(4, "Di", 40), (2, "Bob", 25), (1, "Ann", 11)]
    assert tuples(t.merge(Merge.source(empty, lambda a, b: a.id == b.id).present_in_target().update("pay", lambda a: F.lit(0)))) == [(1, "Ann", 0), (2, "Bo", 0), (3, "Cy", 0)]
    for bad in (
        lambda: m.update(), lambda: m.present_in_both().insert(), lambda: m.present_in_target().insert(), lambda: m.present_in_source().update(), lambda: m.present_in_target().update(),
        lambda: m.present_in_target().update("pay", "pay"), lambda: m.present_in_source().delete(), lambda: m.when(lambda a: a), lambda: t.merge(m.present_in_both()),
        lambda: t.merge(m.present_in_both().update("pay", "zz")), lambda: t.merge(m.present_in_both().update("zz", "pay")),
        lambda: t.merge(Merge.source(twice, lambda a, b: a.id == b.id).present_in_both().update()),
    ):
        with pytest.raises(TableError):
            bad()


def test_orders_are_pruned_when_not_asked_for(spark):
    t = Table.from_df(spark.range(10).withColumn("x", F.col("id") % 3), ["id"]).group_by(GroupBy.on("x").count())
    assert "min(" not in t.df._jdf.queryExecution().optimizedPlan().toString()


def test_filters_reach_the_scan_and_equal_keys_the_join(spark, tmp_path):
    spark.range(50).selectExpr("id", "id % 7 as k", "id * 2 as unused").write.parquet(str(tmp_path / "p"))
    t = Table.read_parquet(spark, str(tmp_path / "p"), ["id"])
    plan = lambda x: x.df._jdf.queryExecution().executedPlan().toString()
    scan = plan(t.filter(lambda r: (r.k == 3) & (r.id > 5)).select("id"))
    assert "EqualNullSafe(k,3)" in scan and "GreaterThan(id,5)" in scan and "unused" not in scan
    for sql_eq in (False, True):
        joined = plan(t.inner_join(t, lambda a, b: a.k == b.k, sql_eq=sql_eq))
        assert "NestedLoop" not in joined and "Cartesian" not in joined
    assert "NestedLoop" not in plan(t.merge(Merge.source(t, lambda a, b: a.id == b.id).present_in_both().update()))
