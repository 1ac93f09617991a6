"""Grouped aggregates and window functions with the table's null, NaN and order rules."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as SparkWindow
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.expr import collated, is_float, is_number, number_or_null
from weft.naming import TableError, existing, fresh, quoted
from weft.specs import BEGINNING, END, WHOLE, Agg, Dedup, GroupBy, Window, WindowFunction

if TYPE_CHECKING:
    from weft.table import Table


def _number(kind: str, c: str, t: T.DataType) -> Column:
    if not is_number(t) and not isinstance(t, T.NullType):
        raise TableError(f"{kind} needs a number, {c!r} is {t.simpleString()}")
    return number_or_null(F.col(quoted(c)), t)


def _value(kind: str, column: str | None, t: T.DataType | None, locale: bool) -> Column:
    """The aggregate of a column; used over groups and over frames."""
    if column is None:
        return F.count(F.lit(1))
    c = F.col(quoted(column))
    if kind == "count":
        return F.count(c)
    if kind == "sum":
        whole = isinstance(t, (T.IntegralType, T.DecimalType))
        return F.coalesce(F.sum(_number(kind, column, t)), F.lit(0 if whole else 0.0))
    if kind == "avg":
        return F.avg(_number(kind, column, t))
    c = number_or_null(c, t)
    if locale and isinstance(t, T.StringType):
        return (F.max_by if kind == "max" else F.min_by)(c, collated(c, t, True))
    return F.max(c) if kind == "max" else F.min(c)


def _in_order(column: str, order: list[tuple[str, bool]]) -> Column:
    """The group's values in table order, with nulls."""
    keys = [F.col(o).alias(f"o{i}") for i, (o, _) in enumerate(order)]
    rows = F.collect_list(F.struct(*keys, F.col(quoted(column)).alias("v")))

    def before(a: Column, b: Column) -> Column:
        out = F.lit(0)
        for i, (_, down) in reversed(list(enumerate(order))):
            x, y, sign = a[f"o{i}"], b[f"o{i}"], -1 if down else 1
            out = F.when(x.eqNullSafe(y), out).when(x.isNull(), -sign).when(y.isNull(), sign).when(x < y, -sign).otherwise(sign)
        return out

    in_order = F.array_sort(rows, before) if any(d for _, d in order) else F.array_sort(rows)
    return F.transform(in_order, lambda e: e["v"])


def _first_row(order: list[tuple[str, bool]]) -> list[tuple[Column, bool]]:
    """The order of a group's first row."""
    if not order:
        return []
    if len(order) == 1:
        o, down = order[0]
        return [(F.max(o) if down else F.min(o), down)]
    rising = [F.col(o) for o, d in order if not d]  # falling keys are text in locale order; see Table._ordered
    return [(F.min(F.struct(*rising)), False)] if rising else []


def group_by(t: Table, spec: GroupBy, locale: bool = False) -> Table:
    from weft.table import Table

    spec = spec.build()
    existing(list(spec.columns), t.columns)
    types = {f.name: f.dataType for f in t.df.schema}
    needs_order = any(a.kind in ("collectList", "customList", "customPandas") for a in spec.aggs)
    t = t._with_order() if needs_order else t
    out: list[Column] = []
    for a in spec.aggs:
        if a.column is not None:
            existing([a.column], t.columns)
        fresh(a.alias, t.columns)
        if a.kind != "customPandas":
            out.append(_aggregate(a, types, t._order, locale).alias(a.alias))
    keys = [F.col(quoted(c)) for c in spec.columns]
    firsts = [(c.alias(f"__f{i}"), f"__f{i}", d) for i, (c, d) in enumerate(_first_row(t._order))]
    df = t._df.groupBy(*keys).agg(*out, *(c for c, _, _ in firsts)) if out or firsts else t._df.select(*keys).distinct()
    pandas = [a for a in spec.aggs if a.kind == "customPandas"]
    if pandas:
        own = t._df.groupBy(*keys).agg(*(_over_series(a, t._order) for a in pandas)).toDF(*(f"__{i}" for i in range(len(keys))), *(a.alias for a in pandas))
        df = df.join(own, _same_keys(spec.columns), "left")
    return Table._ordered(df, [*spec.columns, *(a.alias for a in spec.aggs)], [(F.col(n), d) for _, n, d in firsts])


def _same_keys(columns: Sequence[str]) -> Column:
    """The columns agree with __0, __1, ...; null is a value."""
    return reduce(lambda a, b: a & b, (F.col(quoted(c)).eqNullSafe(F.col(f"__{i}")) for i, c in enumerate(columns)))


def _aggregate(a: Agg, types: dict[str, T.DataType], order: list[tuple[str, bool]], locale: bool) -> Column:
    if a.kind == "collectList":
        return _in_order(a.column, order)
    if a.kind == "customList":
        return a.extra(_in_order(a.column, order))
    if a.kind == "custom":
        return a.extra(F.col(quoted(a.column)))
    return _value(a.kind, a.column, types.get(a.column), locale)


def _over_series(a: Agg, order: list[tuple[str, bool]]) -> Column:
    """A pandas aggregate that gets the group's values as a Series, in table order."""
    import pandas as pd

    of, returns = a.extra
    rising = [not d for _, d in order]

    def run(values: pd.Series, *keys: pd.Series) -> Any:
        place = pd.concat([k.reset_index(drop=True) for k in keys], axis=1, keys=range(len(keys)))
        at = place.sort_values(list(range(len(keys))), ascending=rising, na_position="first", kind="stable").index
        return of(values.reset_index(drop=True).iloc[at].reset_index(drop=True))

    run.__annotations__ = {"values": pd.Series, "keys": pd.Series, "return": float}  # a series to a scalar
    return F.pandas_udf(run, returns)(F.col(quoted(a.column)), *(F.col(o) for o, _ in order)).alias(a.alias)


def _frame(f: WindowFunction, base, order_columns: list[str]):
    frame = f.frame
    edge = lambda x: SparkWindow.unboundedPreceding if x == BEGINNING else SparkWindow.unboundedFollowing if x == END else int(x)
    if frame.by_range is not None:
        if order_columns != [frame.by_range]:
            raise TableError("a range frame needs its column as the only order")
        return base.rangeBetween(edge(frame.low), edge(frame.high))
    return base.rowsBetween(edge(frame.low), edge(frame.high))


def window(t: Table, spec: Window, locale: bool = False) -> Table:
    from weft.table import Table

    spec = spec.build()
    partition = list(spec.partition or ())
    existing(partition, t.columns)
    if spec.order:
        existing([k.column for k in spec.order.keys], t.columns)
    t = t._with_order()
    keys = t._sort_keys(spec.order, locale) if spec.order else []
    ties = [(F.col(o), d) for o, d in t._order]
    parts = [F.col(quoted(c)) for c in partition] or [F.lit(0)]
    directed = [c.desc() if d else c.asc() for c, d in [*keys, *ties]]
    base = SparkWindow.partitionBy(*parts).orderBy(*directed)
    columns, df = list(t.columns), t._df
    range_base = SparkWindow.partitionBy(*parts).orderBy(*([F.desc(quoted(k.column)) if k.descending else F.asc(quoted(k.column)) for k in spec.order.keys] if spec.order else []))
    for f in spec.functions:
        fresh(f.alias, columns)
        if f.column is not None:
            existing([f.column], columns)
        if f.kind == "customPartition":
            df = _per_partition(df, f, partition, directed)
        elif f.kind == "customFrame" and f.frame == WHOLE:
            df = _over_whole(df, f, partition, [*keys, *ties])
        elif f.kind in ("rank", "dense_rank"):
            df = _ranked(df, f, base, [k.column for k in spec.order.keys])
        else:
            w = range_base if f.frame.by_range is not None else base
            df = df.withColumn(f.alias, _function(df, f, w, base, spec, locale))
        columns.append(f.alias)
    heads = [(_least(o, d, parts), d) for o, d in t._order]
    return Table._ordered(df, columns, [*heads, *keys, *ties])


def _least(o: str, down: bool, parts: list[Column]) -> Column:
    w = SparkWindow.partitionBy(*parts)
    return F.max(o).over(w) if down else F.min(o).over(w)


def _function(df: DataFrame, f: WindowFunction, w, base, spec: Window, locale: bool) -> Column:
    order = [k.column for k in spec.order.keys] if spec.order else []
    c = F.col(quoted(f.column)) if f.column is not None else None
    t = df.schema[f.column].dataType if f.column is not None else None
    if f.kind == "row_number":
        return F.row_number().over(base)
    if f.kind == "ntile":
        return F.ntile(f.extra).over(base)
    if f.kind in ("lead", "lag"):
        offset, default = f.extra
        return (F.lead if f.kind == "lead" else F.lag)(c, offset, default).over(base)
    framed = _frame(f, w, order)
    if f.kind == "first":
        return F.first(c).over(framed)
    if f.kind == "last":
        return F.last(c).over(framed)
    if f.kind == "nth":
        return F.nth_value(c, f.extra + 1).over(framed)
    if f.kind == "customFramePandas":
        return _framed_pandas(*f.extra)(c).over(framed)
    if f.kind in ("collectList", "customFrame"):
        values = F.transform(F.collect_list(F.struct(c.alias("v"))).over(framed), lambda e: e["v"])
        return values if f.kind == "collectList" else f.extra(values)
    if f.kind == "sum":
        whole = isinstance(t, (T.IntegralType, T.DecimalType))
        return F.coalesce(F.sum(_number("sum", f.column, t)).over(framed), F.lit(0 if whole else 0.0))
    return _value(f.kind, f.column, t, locale).over(framed)


def _framed_pandas(of, returns: str):
    import pandas as pd

    def run(values: pd.Series) -> Any:
        return of(values)

    run.__annotations__ = {"values": pd.Series, "return": float}
    return F.pandas_udf(run, returns)


def _over_whole(df: DataFrame, f: WindowFunction, partition: list[str], order: list[tuple[Column, bool]]) -> DataFrame:
    """A frame function over whole partitions: computed once for each and joined to its rows."""
    keyed = df.select("*", *(c.alias(f"__w{i}") for i, (c, _) in enumerate(order)))
    value = f.extra(_in_order(f.column, [(f"__w{i}", d) for i, (_, d) in enumerate(order)])).alias(f.alias)
    if not partition:
        return df.join(F.broadcast(keyed.agg(value)), F.lit(True), "left")  # one row
    each = keyed.groupBy(*(quoted(c) for c in partition)).agg(value).toDF(*(f"__{i}" for i in range(len(partition))), f.alias)
    return df.join(each, _same_keys(partition), "left").drop(*(f"__{i}" for i in range(len(partition))))


def _ranked(df: DataFrame, f: WindowFunction, base, order: list[str]) -> DataFrame:
    """rank and dense_rank; ties are rows with the same raw values of the order columns, whatever the transform."""
    number = F.row_number().over(base)
    change = number == 1
    for k in order:
        raw = F.col(quoted(k))
        change = change | ~F.lag(raw).over(base).eqNullSafe(raw)
    so_far = base.rowsBetween(SparkWindow.unboundedPreceding, SparkWindow.currentRow)
    value = F.max(F.when(F.col("__chg"), F.col("__nr"))) if f.kind == "rank" else F.sum(F.col("__chg").cast("int"))
    marked = df.withColumn("__nr", number).withColumn("__chg", change)
    return marked.withColumn(f.alias, value.over(so_far).cast("int")).drop("__nr", "__chg")


def _per_partition(df: DataFrame, f: WindowFunction, partition: list[str], directed: list[Column]) -> DataFrame:
    of, returns = f.extra
    alias = f.alias
    numbered = df.withColumn("__at", F.row_number().over(SparkWindow.partitionBy(*([quoted(c) for c in partition] or [F.lit(0)])).orderBy(*directed)))
    schema = T.StructType([*df.schema.fields, T.StructField(alias, T._parse_datatype_string(returns))])

    def run(rows):
        rows = rows.sort_values("__at").drop(columns="__at").reset_index(drop=True)
        values = list(of(rows.copy()))
        if len(values) != len(rows):
            raise ValueError(f"{alias}: {len(values)} values for {len(rows)} rows")
        rows[alias] = values
        return rows

    return numbered.groupBy(*(quoted(c) for c in partition)).applyInPandas(run, schema)


def deduplicate(t: Table, spec: Dedup) -> Table:
    from weft.table import Table

    spec = spec.build()
    existing(list(spec.columns), t.columns)
    t = t._with_order()
    parts = [F.col(quoted(c)) for c in spec.columns] or [F.lit(0)]
    order = [F.col(o).desc() if d else F.col(o).asc() for o, d in t._order]
    reverse = [F.col(o).asc() if d else F.col(o).desc() for o, d in t._order]
    first = SparkWindow.partitionBy(*parts)
    heads = [(_least(o, d, parts), d) for o, d in t._order]
    if spec.rule == "first":
        by = order
    elif spec.rule == "last":
        by = reverse
    elif spec.rule == "keep_by":
        by = [*spec.by, *order]
    elif spec.rule in ("max", "min"):
        existing([spec.by], t.columns)
        c = F.col(quoted(spec.by))
        ok = c.isNotNull() & ~F.isnan(c) if is_float(t.df.schema[spec.by].dataType) else c.isNotNull()
        value = F.when(ok, c)
        flags = F.when(ok, 0).otherwise(1)
        late = [F.when(ok, F.col(o)).asc() if d else F.when(ok, F.col(o)).desc() for o, d in t._order]  # ties go to the later row
        by = [flags, value.desc_nulls_last() if spec.rule == "max" else value.asc_nulls_last(), *late, *order]
    else:
        return _chosen(t, spec, parts, order, heads)
    df = t._df.withColumn("__n", F.row_number().over(first.orderBy(*by)))
    with_heads = df.select("*", *(h.alias(f"__h{i}") for i, (h, _) in enumerate(heads))).where("__n = 1")
    return Table._ordered(with_heads, t.columns, [(F.col(f"__h{i}"), d) for i, (_, d) in enumerate(heads)])


def _chosen(t: Table, spec: Dedup, parts: list[Column], order: list[Column], heads) -> Table:
    from weft.table import Table

    chooser, visible = spec.by, list(t.columns)
    df = t._df.withColumn("__at", F.row_number().over(SparkWindow.partitionBy(*parts).orderBy(*order)))

    def run(rows):
        rows = rows.sort_values("__at").reset_index(drop=True)
        at = chooser(rows[visible].copy())
        if not 0 <= int(at) < len(rows):
            raise ValueError("the chooser must return the position of a row of the group")
        out = rows.iloc[[int(at)]].copy()
        for o in [c for c in rows.columns if c.startswith("__o")]:
            out[o] = rows[o].iloc[0]  # the place of the key is that of its first row
        return out.drop(columns="__at")

    kept = df.groupBy(*(quoted(c) for c in spec.columns)).applyInPandas(run, t._df.schema)
    return Table(kept, t.columns, t._order)
