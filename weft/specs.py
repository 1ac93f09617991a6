"""Immutable builders for the operators that take more than a few arguments.

Every step returns a new builder and is checked when it is made; build() checks the whole.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column

from weft.naming import TableError, distinct

BEGINNING, END = float("-inf"), float("inf")


def _names(what: str, names: tuple[str, ...], least: int) -> tuple[str, ...]:
    if len(names) < least:
        raise TableError(f"{what} needs at least {least} column")
    return tuple(distinct(list(names)))


@dataclass(frozen=True)
class SortKey:
    column: str
    descending: bool
    transform: Callable[[Column], Column] | None = None


class _Either:
    """A method that also starts a new builder when called on the class."""

    def __init__(self, method: Callable[..., Any]) -> None:
        self.method, self.__doc__ = method, method.__doc__

    def __get__(self, obj: Any, owner: type) -> Callable[..., Any]:
        return lambda *args, **kwargs: self.method(owner() if obj is None else obj, *args, **kwargs)


@dataclass(frozen=True)
class Sort:
    """Sort.asc("a").desc("b", lambda c: F.length(c))"""

    keys: tuple[SortKey, ...] = ()

    def _with(self, column: str, descending: bool, transform: Any) -> Sort:
        if any(k.column == column for k in self.keys):
            raise TableError(f"{column!r} is sorted twice")
        if transform is not None and not callable(transform):
            raise TableError("a sort transform must be a function of the cell")
        return Sort((*self.keys, SortKey(column, descending, transform)))

    @_Either
    def asc(self, column: str, transform: Callable[[Column], Column] | None = None) -> Sort:
        return self._with(column, False, transform)

    @_Either
    def desc(self, column: str, transform: Callable[[Column], Column] | None = None) -> Sort:
        return self._with(column, True, transform)

    def build(self) -> Sort:
        if not self.keys:
            raise TableError("a sort needs a column")
        return self


@dataclass(frozen=True)
class Dedup:
    """Dedup.on("a", "b"): keeps the first row of each key; .last(), .max(c), .min(c), .keep_by(order), .resolve_pandas(f)"""

    columns: tuple[str, ...] = ()
    rule: str = "first"
    by: Any = None

    @staticmethod
    def on(*columns: str) -> Dedup:
        return Dedup(_names("deduplicate", columns, 0))

    def _rule(self, rule: str, by: Any) -> Dedup:
        if self.rule != "first":
            raise TableError("the row to keep is chosen twice")
        return replace(self, rule=rule, by=by)

    def last(self) -> Dedup:
        return self._rule("last", None)

    def max(self, column: str) -> Dedup:
        return self._rule("max", column)

    def min(self, column: str) -> Dedup:
        return self._rule("min", column)

    def keep_by(self, *order: Column) -> Dedup:
        """Keep the first row in this order."""
        return self._rule("keep_by", order)

    def resolve_pandas(self, chooser: Callable[[Any], int]) -> Dedup:
        """chooser gets the rows of a key as a pandas frame and returns the position of the one to keep."""
        if not callable(chooser):
            raise TableError("resolve needs a function")
        return self._rule("pandas", chooser)

    def build(self) -> Dedup:
        return self


@dataclass(frozen=True)
class Agg:
    kind: str
    column: str | None
    alias: str
    extra: Any = None


@dataclass(frozen=True)
class GroupBy:
    """GroupBy.on("a").count().sum("x").avg("x", "mean")"""

    columns: tuple[str, ...] = ()
    aggs: tuple[Agg, ...] = ()

    @staticmethod
    def on(*columns: str) -> GroupBy:
        return GroupBy(_names("group_by", columns, 1))

    def _agg(self, kind: str, column: str | None, alias: str | None, extra: Any = None) -> GroupBy:
        alias = alias or f"{kind}_{column or 'all'}"
        if any(a.alias == alias for a in self.aggs):
            raise TableError(f"alias {alias!r} is used twice")
        return replace(self, aggs=(*self.aggs, Agg(kind, column, alias, extra)))

    def count(self, column: str | None = None, alias: str | None = None) -> GroupBy:
        return self._agg("count", column or None, alias)

    def sum(self, column: str, alias: str | None = None) -> GroupBy:
        return self._agg("sum", column, alias)

    def avg(self, column: str, alias: str | None = None) -> GroupBy:
        return self._agg("avg", column, alias)

    def max(self, column: str, alias: str | None = None) -> GroupBy:
        return self._agg("max", column, alias)

    def min(self, column: str, alias: str | None = None) -> GroupBy:
        return self._agg("min", column, alias)

    def collect_list(self, column: str, alias: str | None = None) -> GroupBy:
        return self._agg("collectList", column, alias)

    def custom(self, column: str, alias: str, of: Callable[[Column], Column]) -> GroupBy:
        """of maps the column to an aggregate Column, or (see over_list) the ordered list to a value."""
        if not alias or not callable(of):
            raise TableError("a custom aggregate needs an alias and a function")
        return self._agg("custom", column, alias, of)

    def custom_list(self, column: str, alias: str, of: Callable[[Column], Column]) -> GroupBy:
        """of maps the array of the group's values, in order and with nulls, to a value."""
        if not alias or not callable(of):
            raise TableError("a custom aggregate needs an alias and a function")
        return self._agg("customList", column, alias, of)

    def custom_pandas(self, column: str, alias: str, of: Callable[[Any], Any], returns: str) -> GroupBy:
        """of maps the pandas Series of the group's values to a value of SQL type `returns`."""
        if not alias or not callable(of):
            raise TableError("a custom aggregate needs an alias and a function")
        return self._agg("customPandas", column, alias, (of, returns))

    def build(self) -> GroupBy:
        if not self.columns:
            raise TableError("group_by needs at least 1 column")
        return self


@dataclass(frozen=True)
class WindowFrame:
    """WindowFrame.rows(-1, WindowFrame.end): offsets from the current row, negative ones before it."""

    low: float = BEGINNING
    high: float = END
    by_range: str | None = None

    beginning = BEGINNING
    end = END

    @staticmethod
    def rows(low: float, high: float) -> WindowFrame:
        if low > high:
            raise TableError("a frame must not end before it starts")
        return WindowFrame(low, high)

    @staticmethod
    def range(column: str, low: float, high: float) -> WindowFrame:
        """Rows whose value of the single numeric order column is within low .. high of the current one."""
        if low > high:
            raise TableError("a frame must not end before it starts")
        return WindowFrame(low, high, column)


WHOLE = WindowFrame()


@dataclass(frozen=True)
class WindowFunction:
    kind: str
    column: str | None
    alias: str
    frame: WindowFrame = WHOLE
    extra: Any = None


@dataclass(frozen=True)
class Window:
    """Window.partition_by("a").order_by(Sort.asc("b")).row_number().sum("x", frame=WindowFrame.rows(-1, 1))"""

    partition: tuple[str, ...] | None = None
    order: Sort | None = None
    functions: tuple[WindowFunction, ...] = ()

    @_Either
    def partition_by(self, *columns: str) -> Window:
        if self.partition is not None or self.order is not None or self.functions:
            raise TableError("partition_by comes first and once")
        return replace(self, partition=_names("partition_by", columns, 1))

    @_Either
    def order_by(self, sort: Sort) -> Window:
        if self.order is not None or self.functions:
            raise TableError("order_by comes once, before the functions")
        return replace(self, order=sort.build())

    def _add(self, kind: str, column: str | None, alias: str, frame: WindowFrame | None = None, extra: Any = None, ordered: bool = False) -> Window:
        if ordered and self.order is None:
            raise TableError(f"{kind} needs order_by")
        if any(f.alias == alias for f in self.functions):
            raise TableError(f"alias {alias!r} is used twice")
        return replace(self, functions=(*self.functions, WindowFunction(kind, column, alias, frame or WHOLE, extra)))

    def row_number(self, alias: str = "row_number") -> Window:
        return self._add("row_number", None, alias, ordered=True)

    def rank(self, alias: str = "rank") -> Window:
        return self._add("rank", None, alias, ordered=True)

    def dense_rank(self, alias: str = "dense_rank") -> Window:
        return self._add("dense_rank", None, alias, ordered=True)

    def ntile(self, n: int, alias: str = "ntile") -> Window:
        if not isinstance(n, int) or n < 1:
            raise TableError("ntile needs a whole number from 1 on")
        return self._add("ntile", None, alias, extra=n, ordered=True)

    def _shift(self, kind: str, column: str, offset: int, alias: str | None, default: Any) -> Window:
        if not isinstance(offset, int) or offset < 0:
            raise TableError(f"{kind} needs an offset of 0 or more")
        return self._add(kind, column, alias or f"{kind}_{offset}_{column}", extra=(offset, default), ordered=True)

    def lead(self, column: str, offset: int = 1, alias: str | None = None, default: Any = None) -> Window:
        return self._shift("lead", column, offset, alias, default)

    def lag(self, column: str, offset: int = 1, alias: str | None = None, default: Any = None) -> Window:
        return self._shift("lag", column, offset, alias, default)

    def first_value(self, column: str, alias: str | None = None, frame: WindowFrame | None = None) -> Window:
        return self._add("first", column, alias or f"first_{column}", frame, ordered=True)

    def last_value(self, column: str, alias: str | None = None, frame: WindowFrame | None = None) -> Window:
        return self._add("last", column, alias or f"last_{column}", frame, ordered=True)

    def nth_value(self, column: str, n: int, alias: str | None = None, frame: WindowFrame | None = None) -> Window:
        """The value of row n of the frame, from 0."""
        if not isinstance(n, int) or n < 0:
            raise TableError("nth_value counts from 0")
        return self._add("nth", column, alias or f"nth_{column}", frame, n, ordered=True)

    def collect_list(self, column: str, alias: str | None = None, frame: WindowFrame | None = None) -> Window:
        return self._add("collectList", column, alias or f"collectList_{column}", frame)

    def count(self, column: str | None = None, alias: str | None = None, frame: WindowFrame | None = None) -> Window:
        return self._add("count", column or None, alias or f"count_{column or 'all'}", frame)

    def sum(self, column: str, alias: str | None = None, frame: WindowFrame | None = None) -> Window:
        return self._add("sum", column, alias or f"sum_{column}", frame)

    def avg(self, column: str, alias: str | None = None, frame: WindowFrame | None = None) -> Window:
        return self._add("avg", column, alias or f"avg_{column}", frame)

    def max(self, column: str, alias: str | None = None, frame: WindowFrame | None = None) -> Window:
        return self._add("max", column, alias or f"max_{column}", frame)

    def min(self, column: str, alias: str | None = None, frame: WindowFrame | None = None) -> Window:
        return self._add("min", column, alias or f"min_{column}", frame)

    def custom_frame(self, column: str, alias: str, of: Callable[[Column], Column], frame: WindowFrame | None = None) -> Window:
        """of maps the array of the frame's values, with nulls, to a value."""
        if not alias or not callable(of):
            raise TableError("a custom frame function needs an alias and a function")
        return self._add("customFrame", column, alias, frame, of)

    def custom_frame_pandas(self, column: str, alias: str, of: Callable[[Any], Any], returns: str, frame: WindowFrame | None = None) -> Window:
        """of maps the pandas Series of the frame's values to a value of SQL type `returns`."""
        if not alias or not callable(of):
            raise TableError("a custom frame function needs an alias and a function")
        return self._add("customFramePandas", column, alias, frame, (of, returns))

    def custom_partition(self, alias: str, of: Callable[[Any], Any], returns: str) -> Window:
        """of gets the sorted rows of a partition as a pandas frame and returns a value for each."""
        if not alias or not callable(of):
            raise TableError("a custom partition function needs an alias and a function")
        return self._add("customPartition", None, alias, extra=(of, returns))

    def build(self) -> Window:
        if not self.functions:
            raise TableError("a window needs a function")
        return self


@dataclass(frozen=True)
class Append:
    """Append.source(table).set("target", "source")"""

    table: Any = None
    mapping: tuple[tuple[str, str], ...] = ()

    @staticmethod
    def source(table: Any) -> Append:
        return Append(table)

    def set(self, target: str, source: str) -> Append:
        if any(t == target for t, _ in self.mapping):
            raise TableError(f"target {target!r} is set twice")
        return replace(self, mapping=(*self.mapping, (target, source)))

    def build(self) -> Append:
        if not self.mapping:
            raise TableError("append maps no column")
        return self


@dataclass(frozen=True)
class Pivot:
    """Pivot.on("month").values("sales", "units").fill_missing(0)"""

    column: str = ""
    value_columns: tuple[str, ...] = ()
    fill: Any = None
    listed: tuple[Any, ...] | None = None
    most: int = 10_000

    @staticmethod
    def on(column: str) -> Pivot:
        return Pivot(column)

    def values(self, *columns: str) -> Pivot:
        return replace(self, value_columns=_names("values", columns, 1))

    def fill_missing(self, value: Any) -> Pivot:
        return replace(self, fill=value)

    def only(self, *pivot_values: Any) -> Pivot:
        """The pivot values, in column order; saves the job that looks for them."""
        return replace(self, listed=pivot_values)

    def at_most(self, pivot_values: int) -> Pivot:
        """How many pivot values there may be; more are an error."""
        return replace(self, most=pivot_values)

    def build(self) -> Pivot:
        if not self.value_columns:
            raise TableError("a pivot needs values")
        if self.column in self.value_columns:
            raise TableError("the pivot column cannot be a value too")
        return self


@dataclass(frozen=True)
class Melt:
    """Melt.columns("q1", "q2").names_to("quarter").values_to("revenue")"""

    sources: tuple[str, ...] = ()
    type_name: str = "type"
    value_name: str = "value"
    cast: str | None = None

    @staticmethod
    def columns(*columns: str) -> Melt:
        return Melt(_names("melt", columns, 1))

    def names_to(self, name: str) -> Melt:
        return replace(self, type_name=name)

    def values_to(self, name: str) -> Melt:
        return replace(self, value_name=name)

    def cast_to(self, sql_type: str) -> Melt:
        """The one type to which columns of different types are brought."""
        return replace(self, cast=sql_type)

    def build(self) -> Melt:
        if self.type_name == self.value_name:
            raise TableError("the two new columns need different names")
        return self


BOTH, SOURCE_ONLY, TARGET_ONLY = 0, 1, 2


@dataclass(frozen=True)
class Command:
    context: int
    kind: str
    column: str | None
    value: Any
    when: Any


_WHOLE_ROW = object()


@dataclass(frozen=True)
class Merge:
    """Merge.source(table, lambda t, s: t.id == s.id).present_in_both().update().present_in_source().insert()"""

    table: Any = None
    predicate: Any = None
    context: int | None = None
    condition: Any = None
    commands: tuple[Command, ...] = ()

    @staticmethod
    def source(table: Any, predicate: Any) -> Merge:
        return Merge(table, predicate)

    def _enter(self, context: int) -> Merge:
        return replace(self, context=context, condition=None)

    def present_in_both(self) -> Merge:
        return self._enter(BOTH)

    def present_in_source(self) -> Merge:
        return self._enter(SOURCE_ONLY)

    def present_in_target(self) -> Merge:
        return self._enter(TARGET_ONLY)

    def _needs_context(self) -> None:
        if self.context is None:
            raise TableError("say first where the rows are present")

    def when(self, condition: Any) -> Merge:
        """Applies to all commands up to the next when, reset_when or context."""
        self._needs_context()
        return replace(self, condition=condition)

    def reset_when(self) -> Merge:
        self._needs_context()
        return replace(self, condition=None)

    def _command(self, kind: str, column: str | None, value: Any) -> Merge:
        self._needs_context()
        return replace(self, commands=(*self.commands, Command(self.context, kind, column, value, self.condition)))

    def insert(self, column: str | None = None, value: Any = None) -> Merge:
        """All columns of the source row, or one column from a source column's name or an expression."""
        self._needs_context()
        if self.context != SOURCE_ONLY:
            raise TableError("only rows that are in the source alone can be inserted")
        return self._command("set", column, value)

    def update(self, column: str | None = None, value: Any = None) -> Merge:
        self._needs_context()
        if self.context == SOURCE_ONLY:
            raise TableError("rows that are not in the target cannot be updated")
        if self.context == TARGET_ONLY and (column is None or isinstance(value, str)):
            raise TableError("rows that are in the target alone have no source columns")
        return self._command("set", column, value)

    def delete(self) -> Merge:
        self._needs_context()
        if self.context == SOURCE_ONLY:
            raise TableError("rows that are not in the target cannot be deleted")
        return self._command("delete", None, None)

    def build(self) -> Merge:
        if not self.commands:
            raise TableError("a merge needs a command")
        return self
