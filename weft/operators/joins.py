"""The join family over one recipe: both sides renamed to their final names, then one DataFrame join."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import functions as F

from weft.expr import Expression, Row, condition, resolve
from weft.naming import TableError, joined, quoted

if TYPE_CHECKING:
    from weft.table import Table


def join(left: Table, right: Table, on: Expression | None, how: str, sql_eq: bool = False) -> Table:
    """how: inner, left, right, full, full_anti, left_semi, left_anti, right_semi, right_anti, cross."""
    from weft.table import Table

    if not isinstance(right, Table):
        raise TableError("a join needs another Table")
    ln, rn = joined(left.columns, right.columns)
    a, a_order = left._renamed(ln, "l")
    b, b_order = right._renamed(rn, "r")
    if how in ("left_semi", "left_anti"):
        test = _test(a.join(b), on, left, right, ln, rn, sql_eq)
        kept = a.join(b, test, how)
        return Table(kept.toDF(*left.columns, *left._hidden()), left.columns, left._order)
    if how in ("right_semi", "right_anti"):  # the condition still sees the sides by their own names
        kept = b.join(a, _test(a.join(b), on, left, right, ln, rn, sql_eq), f"left_{how[6:]}")
        return Table(kept.toDF(*right.columns, *right._hidden()), right.columns, right._order)
    if how == "cross":
        return Table._ordered(a.crossJoin(b), ln + rn, [*a_order, *b_order])
    a, b = a.withColumn("__l", F.lit(True)), b.withColumn("__r", F.lit(True))
    test = _test(a.join(b), on, left, right, ln, rn, sql_eq)
    out = a.join(b, test, "full" if how == "full_anti" else how)
    only_left, only_right = F.col("__r").isNull(), F.col("__l").isNull()
    if how == "full_anti":
        out = out.where(only_left | only_right)
    side = (F.when(only_left, 1).when(only_right, 2).otherwise(0), False)
    order = {"inner": [*a_order, *b_order], "left": [*a_order, *b_order], "right": [*b_order, *a_order]}.get(how, [side, *a_order, *b_order])
    return Table._ordered(out, ln + rn, order)


def _test(both, on, left, right, ln, rn, sql_eq):
    names = dict(zip(left.columns, ln, strict=True)), dict(zip(right.columns, rn, strict=True))
    return condition(both, resolve(on, Row(names[0], sql_eq), Row(names[1], sql_eq)))


def union_all(top: Table, bottom: Table) -> Table:
    from weft.table import Table

    if not isinstance(bottom, Table):
        raise TableError("a union needs another Table")
    missing = [c for c in top.columns if c not in bottom.columns]
    if missing:
        raise TableError(f"the other table lacks {missing}")
    return _stacked(top, bottom, bottom.df.columns and {c: F.col(quoted(c)) for c in top.columns})


def append(top: Table, bottom: Table, mapping: tuple[tuple[str, str], ...]) -> Table:
    from weft.naming import existing

    existing([t for t, _ in mapping], top.columns)
    existing([s for _, s in mapping], bottom.columns)
    return _stacked(top, bottom, {t: F.col(quoted(s)) for t, s in mapping})


def _stacked(top: Table, bottom: Table, values: dict) -> Table:
    """top's rows, then bottom's; columns without a value are null."""
    from weft.table import Table

    n = max(len(top._order), len(bottom._order))

    def part(t: Table, columns: list, which: int):
        keys = [F.lit(which).alias("__p")]
        for i in range(n):  # keys of different types cannot share a column
            own = F.col(t._order[i][0]) if i < len(t._order) else F.lit(None)
            keys.append(own.alias(f"__{'tb'[which]}{i}"))
        return t._df.select(*columns, *keys)

    types = dict(top.df.dtypes)
    a = part(top, [F.col(quoted(c)) for c in top.columns], 0)
    b = part(bottom, [values[c].alias(c) if c in values else F.lit(None).cast(types[c]).alias(c) for c in top.columns], 1)
    out = a.unionByName(b, allowMissingColumns=True)
    order = [(F.col("__p"), False)]
    order += [(F.col(f"__t{i}"), d) for i, (_, d) in enumerate(top._order)]
    order += [(F.col(f"__b{i}"), d) for i, (_, d) in enumerate(bottom._order)]
    return Table._ordered(out, top.columns, order)
