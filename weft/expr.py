"""Expressions over rows: a Column, SQL text, or a function of row proxies that returns a Column."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.classic.column import Column as JvmColumn

from weft.naming import TableError, quoted

Expression = Column | str | Callable[..., Any]


class Cell(JvmColumn):
    """A Column whose == and != treat null as a value, as the row functions expect.

    It remembers of which column it is, if it is one (_of), and the columns whose equality it is, if that is all (_pairs).
    """

    def __new__(cls, c: Column, of: str | None = None, pairs: tuple[tuple[str, str], ...] = ()) -> Cell:
        self = object.__new__(cls)
        self._jc = c._jc
        return self

    def __init__(self, c: Column, of: str | None = None, pairs: tuple[tuple[str, str], ...] = ()) -> None:
        self._jc, self._of, self._pairs = c._jc, of, pairs

    def __eq__(self, other: Any) -> Column:  # type: ignore[override]
        both = isinstance(other, Cell) and self._of is not None and other._of is not None
        return Cell(self.eqNullSafe(other), pairs=((self._of, other._of),) if both else ())

    def __and__(self, other: Any) -> Column:  # type: ignore[override]
        both = isinstance(other, Cell) and self._pairs and other._pairs
        return Cell(JvmColumn.__and__(self, other), pairs=self._pairs + other._pairs if both else ())

    def __ne__(self, other: Any) -> Column:  # type: ignore[override]
        return Cell(~self.eqNullSafe(other))

    __hash__ = None  # type: ignore[assignment]


def _keeps_cells(name: str) -> Callable[..., Cell]:
    plain = getattr(JvmColumn, name)
    return lambda self, *args: Cell(plain(self, *args))


for _name in ("add", "radd", "sub", "rsub", "mul", "rmul", "truediv", "rtruediv", "mod", "neg"):
    setattr(Cell, f"__{_name}__", _keeps_cells(f"__{_name}__"))


class Row:
    """A row proxy: row.x or row["any name"] is the column. sql_eq gives plain SQL equality."""

    def __init__(self, names: Mapping[str, str], sql_eq: bool = False) -> None:
        self._names, self._sql_eq = names, sql_eq

    def __getitem__(self, name: str) -> Column:
        if name not in self._names:
            raise TableError(f"no column {name!r} among {list(self._names)}")
        c = F.col(quoted(self._names[name]))
        return c if self._sql_eq else Cell(c, self._names[name])

    def __getattr__(self, name: str) -> Column:
        if name.startswith("__"):
            raise AttributeError(name)
        return self[name]

    def __setattr__(self, name: str, value: Any) -> None:
        if name not in ("_names", "_sql_eq"):
            raise TableError("a row cannot be changed")
        object.__setattr__(self, name, value)


def resolve(e: Expression, *rows: Row) -> Column:
    """The Column that e stands for."""
    if isinstance(e, Column):
        return e
    if isinstance(e, str):
        return F.expr(e)
    if callable(e):
        out = e(*rows)
        return out if isinstance(out, Column) else F.lit(out)
    raise TableError(f"an expression must be a Column, SQL text or a function, not {e!r}")


def equal_columns(c: Column) -> tuple[tuple[str, str], ...]:
    """The pairs of columns whose null-safe equality c is; none if c is, or may be, anything else."""
    return c._pairs if isinstance(c, Cell) else ()


def type_of(df: DataFrame, c: Column) -> T.DataType:
    return df.select(c.alias("x")).schema[0].dataType


def condition(df: DataFrame, c: Column) -> Column:
    """c, checked to be boolean. Filters and joins take null as false, and see through c to push it down or find its keys."""
    if not isinstance(type_of(df, c), (T.BooleanType, T.NullType)):
        raise TableError("a condition must be boolean")
    return c


def certain(df: DataFrame, c: Column) -> Column:
    """A condition that is false where c is null, for use inside other conditions."""
    return F.coalesce(condition(df, c), F.lit(False))


def is_float(t: T.DataType) -> bool:
    return isinstance(t, (T.FloatType, T.DoubleType))


def is_number(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def number_or_null(c: Column, t: T.DataType) -> Column:
    """c with NaN as null."""
    return F.when(~F.isnan(c), c) if is_float(t) else c


def complement(c: Column) -> Column:
    """A text whose order is the reverse of the order of c by code point."""
    return F.concat(F.translate(F.hex(F.encode(c, "UTF-8")), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G"))


def collated(c: Column, t: T.DataType, locale: bool) -> Column:
    return F.collate(c, "UNICODE") if locale and isinstance(t, T.StringType) else c
