"""Table: an immutable, lazily evaluated table over a Spark DataFrame.

Every method returns a new Table whose DataFrame is a further transformation; nothing runs until an
action. Tables are ordered where their source was: hidden columns carry the order along, and Catalyst
prunes them from every plan that does not ask for it (`df` is unordered, `ordered_df` is sorted).
Requests that do not fit the table raise TableError when they are made.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft import naming
from weft.expr import Expression, Row, collated, complement, condition, is_float, is_number, resolve, type_of
from weft.naming import TableError, quoted
from weft.operators import aggregates, joins, reshape
from weft.operators import merge as merging
from weft.plans.stage import written
from weft.sources import files
from weft.specs import Append, Dedup, GroupBy, Melt, Merge, Pivot, Sort, Window

Schema = T.StructType | str


class Table:
    """Made by from_rows, empty, from_df, read_json or read_parquet."""

    def __init__(self, df: DataFrame, columns: list[str], order: list[tuple[str, bool]]) -> None:
        self._df, self._columns, self._order = df, list(columns), list(order)

    # -- sources -----------------------------------------------------------------------------

    @staticmethod
    def from_rows(spark: SparkSession, rows: Sequence[dict[str, Any]], schema: Schema | None = None) -> Table:
        """Rows in memory; all have the keys of the first, in any order."""
        if not isinstance(rows, (list, tuple)) or not rows:
            raise TableError("rows must be a non-empty list")
        if not all(isinstance(r, dict) for r in rows):
            raise TableError("every row must be a dict")
        columns = naming.distinct(list(rows[0]))
        if any(set(r) != set(columns) for r in rows):
            raise TableError("all rows must have the same columns")
        cells = {c: [r[c] for r in rows] for c in columns}
        if schema is None:
            for c, v in cells.items():
                kinds = {type(x) for x in v if x is not None}
                if kinds == {int, float}:
                    cells[c] = [None if x is None else float(x) for x in v]
                elif len(kinds) > 1:
                    raise TableError(f"column {c!r} mixes {sorted(k.__name__ for k in kinds)}")
            inferred = [(c, next((x for x in v if x is not None), None)) for c, v in cells.items()]
            types = {c: T.StringType() if x is None else T._infer_type(x) for c, x in inferred}
            schema = T.StructType([T.StructField(c, t) for c, t in types.items()])
        elif isinstance(schema, str):
            schema = T._parse_datatype_string(schema)
        data = [(*(cells[f.name][i] for f in schema), i) for i in range(len(rows))]
        df = spark.createDataFrame(data, T.StructType([*schema.fields, T.StructField("__o0", T.LongType())]))
        return Table(df, schema.names, [("__o0", False)])

    @staticmethod
    def empty(spark: SparkSession, *names: str, schema: Schema | None = None) -> Table:
        """No rows; columns are strings unless a schema says otherwise."""
        if schema is None:
            if not names:
                raise TableError("an empty table needs a column")
            schema = T.StructType([T.StructField(n, T.StringType()) for n in naming.distinct(list(names))])
        df = spark.createDataFrame([], schema)
        return Table(df, df.columns, [])

    @staticmethod
    def from_df(df: DataFrame, order: Sequence[str] = ()) -> Table:
        """A DataFrame; `order` names the columns that give its natural order."""
        columns = naming.distinct(df.columns)
        naming.existing(list(order), columns)
        return Table._ordered(df, columns, [(F.col(quoted(c)), False) for c in order])

    @staticmethod
    def read_json(spark: SparkSession, path: str, schema: Schema | None = None, multiline: bool = True) -> Table:
        """A JSON file of one array (multiline) or one object a line. Without schema columns are in alphabetical order."""
        return Table.from_df(files.json_rows(spark, path, schema, multiline))

    @staticmethod
    def read_parquet(spark: SparkSession, path: str, order: Sequence[str] = ()) -> Table:
        return Table.from_df(files.parquet(spark, path), order)

    # -- plumbing ----------------------------------------------------------------------------

    @staticmethod
    def _ordered(df: DataFrame, columns: list[str], order: list[tuple[Column, bool]]) -> Table:
        """df's columns with these order keys as hidden columns.

        Falling keys are stored so that they rise, numbers and times negated and text by complement, so that
        the order of a group's first row is a plain minimum. Only falling text in locale order stays flagged.
        """
        keys: list[tuple[Column, bool]] = []
        for c, down in order:
            if down:
                t = type_of(df, c)
                if is_number(t) or isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
                    number = c if is_number(t) else F.unix_micros(c.cast("timestamp_ntz").cast("timestamp"))
                    keys += [(c.isNull(), False), (-number, False)]
                    continue
                if isinstance(t, T.StringType) and t == T.StringType():
                    keys += [(c.isNull(), False), (complement(c), False)]
                    continue
            keys.append((c, down))
        hidden = [c.alias(f"__o{i}") for i, (c, _) in enumerate(keys)]
        return Table(df.select(*(quoted(c) for c in columns), *hidden), columns, [(f"__o{i}", d) for i, (_, d) in enumerate(keys)])

    def _with_order(self) -> Table:
        """This table, in the order in which Spark reads it if it has no other."""
        if self._order:
            return self
        return Table(self._df.withColumn("__o0", F.monotonically_increasing_id()), self._columns, [("__o0", False)])

    def _hidden(self) -> list[str]:
        return [o for o, _ in self._order]

    def _with(self, df: DataFrame, columns: list[str]) -> Table:
        return Table(df, columns, self._order)

    def _renamed(self, names: list[str], side: str) -> tuple[DataFrame, list[tuple[Column, bool]]]:
        """The DataFrame under other names, and its order keys."""
        hidden = [f"__{side}_{o}" for o in self._hidden()]
        df = self._df.select(*(quoted(c) for c in self._columns), *self._hidden()).toDF(*names, *hidden)
        return df, [(F.col(h), d) for h, (_, d) in zip(hidden, self._order, strict=True)]

    def _row(self, sql_eq: bool = False) -> Row:
        return Row({c: c for c in self._columns}, sql_eq)

    def _sort_keys(self, spec: Sort, locale: bool) -> list[tuple[Column, bool]]:
        """Ascending: null, NaN, values; descending the reverse."""
        keys = []
        for k in spec.keys:
            c = F.col(quoted(k.column))
            if k.transform is not None:
                c = k.transform(c)
                if not isinstance(c, Column):
                    raise TableError("a sort transform must return a Column")
            t = type_of(self._df, c)
            if is_float(t):
                keys.append((F.when(c.isNull(), 0).when(F.isnan(c), 1).otherwise(2), k.descending))
            keys.append((collated(c, t, locale), k.descending))
        return keys

    # -- actions and introspection -----------------------------------------------------------

    @property
    def df(self) -> DataFrame:
        """The visible columns, in no particular order."""
        return self._df.select(*(quoted(c) for c in self._columns))

    def ordered_df(self) -> DataFrame:
        """The visible columns, sorted in table order."""
        keys = [F.col(o).desc() if d else F.col(o).asc() for o, d in self._order]
        return (self._df.orderBy(*keys) if keys else self._df).select(*(quoted(c) for c in self._columns))

    @property
    def columns(self) -> list[str]:
        return list(self._columns)

    @property
    def logic_plan(self) -> str:
        """Catalyst's parsed, analysed, optimised and physical plan."""
        return self.df._jdf.queryExecution().toString()

    def execute(self) -> Table:
        """Computed now and kept on shared storage."""
        return Table(written(self._df, "table"), self._columns, self._order)

    def count(self) -> int:
        return self.df.count()

    @property
    def data(self) -> list[dict[str, Any]]:
        """The evaluated rows, in order, on the driver."""
        return [r.asDict(recursive=True) for r in self.ordered_df().collect()]

    def log(self, limit: int = 0, title: str | None = None) -> Table:
        """Print the first `limit` rows, the last -limit, or all (0); no more than those are computed."""
        if not isinstance(limit, int):
            raise TableError("limit must be a whole number")
        rows = self.ordered_df()
        picked = rows.collect() if limit == 0 else rows.limit(limit).collect() if limit > 0 else rows.tail(-limit)
        if title:
            print(title)
        cells = [[*self._columns], *(["null" if v is None else str(v) for v in r] for r in picked)]
        width = [max(map(len, column)) for column in zip(*cells, strict=True)]
        for line in cells:
            print(" | ".join(v.ljust(w) for v, w in zip(line, width, strict=True)).rstrip())
        return self

    def print_json(self) -> None:
        print(json.dumps(self.data, indent=2, default=str, ensure_ascii=False))

    # -- columns -----------------------------------------------------------------------------

    def select(self, *columns: str) -> Table:
        if not columns:
            return self
        return self._with(self._df, naming.existing(list(dict.fromkeys(columns)), self._columns))

    def select_glob(self, pattern: str, allow_none: bool = False) -> Table:
        kept = naming.matching(pattern, self._columns)
        if not kept and not allow_none:
            raise TableError(f"no column matches {pattern!r}")
        return self._with(self._df, kept)

    def drop(self, *columns: str) -> Table:
        if not columns:
            raise TableError("drop needs a column")
        gone = naming.existing(list(columns), self._columns)
        return self._with(self._df, [c for c in self._columns if c not in gone])

    def drop_glob(self, pattern: str) -> Table:
        gone = naming.matching(pattern, self._columns)
        return self._with(self._df, [c for c in self._columns if c not in gone])

    def _to_names(self, names: list[str]) -> Table:
        df = self._df.select(*(quoted(c) for c in self._columns), *self._hidden())
        return self._with(df.toDF(*naming.distinct(names), *self._hidden()), names)

    def rename(self, old: str, new: str) -> Table:
        naming.existing([old], self._columns)
        naming.fresh(new, self._columns)
        return self._to_names([new if c == old else c for c in self._columns])

    def rename_glob(self, pattern: str, replacement: str) -> Table:
        return self._to_names(naming.glob_renamed(pattern, replacement, self._columns))

    def rename_all(self, f: Callable[[str], str]) -> Table:
        if not callable(f):
            raise TableError("rename_all needs a function of the name")
        return self._to_names([f(c) for c in self._columns])

    def add_column(self, name: str, value: Expression) -> Table:
        naming.fresh(name, self._columns)
        return self._with(self._df.withColumn(name, resolve(value, self._row())), [*self._columns, name])

    def update_column(self, name: str, value: Expression) -> Table:
        naming.existing([name], self._columns)
        return self._with(self._df.withColumn(name, resolve(value, self._row())), self._columns)

    # -- rows --------------------------------------------------------------------------------

    def filter(self, predicate: Expression, sql_eq: bool = False) -> Table:
        return self._with(self._df.where(condition(self._df, resolve(predicate, self._row(sql_eq)))), self._columns)

    def take(self, limit: int, offset: int = 0) -> Table:
        for n in (limit, offset):
            if not isinstance(n, int) or isinstance(n, bool) or n < 0:
                raise TableError("limit and offset must be whole numbers from 0 on")
        keys = [F.col(o).desc() if d else F.col(o).asc() for o, d in self._order]
        df = self._df.orderBy(*keys) if keys else self._df
        return self._with((df.offset(offset) if offset else df).limit(limit), self._columns)

    def sort(self, spec: Sort, locale: bool = False) -> Table:
        """Stable; locale=True orders text by the Unicode collation (a < A < b) instead of by code point."""
        spec = spec.build()
        naming.existing([k.column for k in spec.keys], self._columns)
        return Table._ordered(self._df, self._columns, [*self._sort_keys(spec, locale), *((F.col(o), d) for o, d in self._order)])

    def explode(self, column: str) -> Table:
        """One row per element of an array or character of a string; empty and null give one row with null."""
        naming.existing([column], self._columns)
        c = F.col(quoted(column))
        t = self._df.schema[column].dataType
        if isinstance(t, T.StringType):
            c = F.split(F.when(c != "", c), "")
        elif not isinstance(t, T.ArrayType):
            raise TableError(f"column {column!r} is neither array nor string")
        kept = [quoted(x) for x in self._columns if x != column] + self._hidden()
        df = self._df.select(*kept, F.posexplode_outer(c).alias("__at", column))
        return Table._ordered(df, self._columns, [*((F.col(o), d) for o, d in self._order), (F.col("__at"), False)])

    # -- two tables --------------------------------------------------------------------------

    def inner_join(self, other: Table, on: Expression, sql_eq: bool = False) -> Table:
        return joins.join(self, other, on, "inner", sql_eq)

    def left_join(self, other: Table, on: Expression, sql_eq: bool = False) -> Table:
        return joins.join(self, other, on, "left", sql_eq)

    def right_join(self, other: Table, on: Expression, sql_eq: bool = False) -> Table:
        return joins.join(self, other, on, "right", sql_eq)

    def full_join(self, other: Table, on: Expression, sql_eq: bool = False) -> Table:
        return joins.join(self, other, on, "full", sql_eq)

    def full_anti_join(self, other: Table, on: Expression, sql_eq: bool = False) -> Table:
        return joins.join(self, other, on, "full_anti", sql_eq)

    def left_anti_join(self, other: Table, on: Expression, sql_eq: bool = False) -> Table:
        return joins.join(self, other, on, "left_anti", sql_eq)

    def right_anti_join(self, other: Table, on: Expression, sql_eq: bool = False) -> Table:
        return joins.join(self, other, on, "right_anti", sql_eq)

    def left_semi_join(self, other: Table, on: Expression, sql_eq: bool = False) -> Table:
        return joins.join(self, other, on, "left_semi", sql_eq)

    def right_semi_join(self, other: Table, on: Expression, sql_eq: bool = False) -> Table:
        return joins.join(self, other, on, "right_semi", sql_eq)

    def cross_join(self, other: Table) -> Table:
        return joins.join(self, other, None, "cross")

    def union_all(self, other: Table) -> Table:
        """By name, repeats kept; further columns of the other table are left out."""
        return joins.union_all(self, other)

    def append(self, spec: Append) -> Table:
        spec = spec.build()
        if not isinstance(spec.table, Table):
            raise TableError("append needs a source Table")
        return joins.append(self, spec.table, spec.mapping)

    def merge(self, spec: Merge, allow_type_widening: bool = False, sql_eq: bool = False) -> Table:
        return merging.merge(self, spec, allow_type_widening, sql_eq)

    # -- groups, windows, shapes -------------------------------------------------------------

    def deduplicate(self, spec: Dedup) -> Table:
        return aggregates.deduplicate(self, spec)

    def group_by(self, spec: GroupBy, locale: bool = False) -> Table:
        return aggregates.group_by(self, spec, locale)

    def window(self, spec: Window, locale: bool = False) -> Table:
        return aggregates.window(self, spec, locale)

    def pivot(self, spec: Pivot) -> Table:
        return reshape.pivot(self, spec)

    def melt(self, spec: Melt) -> Table:
        return reshape.melt(self, spec)
