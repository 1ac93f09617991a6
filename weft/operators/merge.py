"""Merge (upsert): every command of a row's context whose condition holds applies, later ones win.

One full join pairs the rows; each target column is a fold over the commands, so all conditions and
values see the rows as they were. Any delete whose condition holds removes the row. Two source rows
for one target row are an error, raised while the result is computed.
"""

from __future__ import annotations

from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as SparkWindow
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.expr import Row, certain, condition, equal_columns, is_number, resolve, type_of
from weft.naming import TableError, existing
from weft.specs import BOTH, SOURCE_ONLY, TARGET_ONLY, Command, Merge

if TYPE_CHECKING:
    from weft.table import Table


def merge(target: Table, spec: Merge, allow_type_widening: bool = False, sql_eq: bool = False) -> Table:
    """allow_type_widening lets values of another type turn a target column into text; without it they are an error."""
    from weft.table import Table

    spec = spec.build()
    source = spec.table
    if not isinstance(source, Table):
        raise TableError("merge needs a source Table")
    target, source = target._with_order(), source._with_order()
    t_names = {c: f"__t{i}" for i, c in enumerate(target.columns)}
    s_names = {c: f"__s{i}" for i, c in enumerate(source.columns)}
    a, a_order = target._renamed(list(t_names.values()), "ta")
    b, b_order = source._renamed(list(s_names.values()), "so")
    a = a.withColumn("__to", F.monotonically_increasing_id())
    b = b.withColumn("__so", F.monotonically_increasing_id())
    t_row, s_row = Row(t_names, sql_eq), Row(s_names, sql_eq)
    both = a.join(b)
    test = condition(both, resolve(spec.predicate, t_row, s_row))
    to, so = F.col("__to"), F.col("__so")
    matched = to.isNotNull() & so.isNotNull()
    keys = _keys(a, b, equal_columns(test))
    if keys:
        # a target row has several source rows if the source has its keys several times; they are counted where the join needs them anyway
        names = [f"{n}{i}" for i in range(len(keys)) for n in ("k", "n")]
        keyed = lambda df, side: df.select("*", *(x.alias(f"__{side}{n}") for n, x in zip(names, (x for k in keys for x in k[side == "s"]), strict=True)))
        times = F.count(F.lit(1)).over(SparkWindow.partitionBy(*(f"__s{n}" for n in names))).alias("__m")
        same = reduce(lambda x, y: x & y, (F.col(f"__t{n}") == F.col(f"__s{n}") for n in names))
        pairs = keyed(a, "t").join(keyed(b, "s").select("*", times), same, "full")
        several = matched & (F.col("__m") > 1)
    else:
        # rows that are in the source alone are partitions of their own, not one large one
        matches = F.sum(matched.cast("int")).over(SparkWindow.partitionBy(F.coalesce(to, -1 - so)))
        pairs = a.join(b, test, "full").withColumn("__m", matches)
        several = F.col("__m") > 1
    pairs = pairs.where(F.when(several, F.raise_error(F.lit("merge: a target row is matched by several source rows")).cast("boolean")).otherwise(True))
    here = {BOTH: to.isNotNull() & so.isNotNull(), SOURCE_ONLY: to.isNull(), TARGET_ONLY: so.isNull()}
    sees = {BOTH: (t_row, s_row), SOURCE_ONLY: (s_row,), TARGET_ONLY: (t_row,)}
    values: dict[str, Column] = {c: F.col(n) for c, n in t_names.items()}
    kinds = {f.name: f.dataType for f in target.df.schema}
    deleted, applied = F.lit(False), F.lit(False)
    for c in spec.commands:
        holds = here[c.context]
        if c.when is not None:
            holds = holds & certain(both, resolve(c.when, *sees[c.context]))
        applied = applied | holds
        if c.kind == "delete":
            deleted = deleted | holds
            continue
        for column, value in _assignments(c, target.columns, source.columns, s_names, sees[c.context]):
            value, kinds[column] = _fitted(value, type_of(both, value), kinds[column], column, allow_type_widening)
            old = values[column].cast(kinds[column])
            values[column] = F.when(holds, value).otherwise(old)
    out = pairs.where(~deleted & (to.isNotNull() | applied))
    picked = out.select(
        *(values[c].alias(c) for c in target.columns), to.isNull().alias("__new"), *(o.alias(f"__x{i}") for i, (o, _) in enumerate([*a_order, *b_order]))
    )
    order = [(F.col("__new"), False), *((F.col(f"__x{i}"), d) for i, (_, d) in enumerate([*a_order, *b_order]))]
    return Table._ordered(picked, target.columns, order)


def _keys(a: DataFrame, b: DataFrame, equal: tuple[tuple[str, str], ...]) -> list[tuple[tuple[Column, Column], ...]]:
    """For each pair of equal columns, of target and source: the value without null and whether it is null. Empty if a pair is not plain."""
    out = []
    for pair in equal:
        sides = [next((x for x in pair if x in df.columns), None) for df in (a, b)]
        if None in sides:
            return []
        types = {df.schema[x].dataType for df, x in zip((a, b), sides, strict=True)}
        other = {T.StringType: "", T.LongType: 0, T.IntegerType: 0, T.BooleanType: False}.get(type(next(iter(types))))
        if len(types) > 1 or other is None:
            return []
        out.append(tuple((F.coalesce(F.col(x), F.lit(other).cast(next(iter(types)))), F.col(x).isNull()) for x in sides))
    return out


def _assignments(c: Command, target: list[str], source: list[str], s_names: dict[str, str], rows: tuple[Row, ...]) -> list[tuple[str, Column]]:
    if c.column is None:
        if set(target) != set(source):
            raise TableError("a whole row needs the same columns in source and target")
        return [(t, F.col(s_names[t])) for t in target]
    existing([c.column], target)
    if isinstance(c.value, str):
        existing([c.value], source)
        return [(c.column, F.col(s_names[c.value]))]
    if c.value is None:
        raise TableError(f"no value for column {c.column!r}")
    return [(c.column, resolve(c.value, *rows))]


def _fitted(value: Column, has: T.DataType, wants: T.DataType, column: str, widen: bool) -> tuple[Column, T.DataType]:
    if has == wants or isinstance(has, T.NullType) or (is_number(has) and is_number(wants)):
        return value.cast(wants), wants
    if isinstance(wants, T.NullType):
        return value, has
    if widen:
        return value.cast("string"), T.StringType()
    raise TableError(f"column {column!r} is {wants.simpleString()}, the value {has.simpleString()}; allow_type_widening makes it text")
