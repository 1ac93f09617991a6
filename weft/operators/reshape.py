"""Pivot (without aggregation) and melt."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import functions as F

from weft.naming import TableError, distinct, existing, quoted
from weft.specs import Melt, Pivot

if TYPE_CHECKING:
    from weft.table import Table


def pivot(t: Table, spec: Pivot) -> Table:
    """One column per pivot value and value column, `{pivot value}_{value column}`; a cell may hold one row only.

    Looking for the pivot values is the one job this runs; Pivot.only(...) saves it.
    """
    from weft.operators.aggregates import _first_row
    from weft.table import Table

    spec = spec.build()
    existing([spec.column, *spec.value_columns], t.columns)
    t = t._with_order()
    groups = [c for c in t.columns if c != spec.column and c not in spec.value_columns]
    on = F.col(quoted(spec.column))
    if spec.listed is None:
        firsts = [(c.alias(f"f{i}"), f"f{i}", d) for i, (c, d) in enumerate(_first_row(t._order))]
        found = t._df.groupBy(on.alias("v")).agg(*(c for c, _, _ in firsts))
        rows = found.orderBy(*(F.col(n).desc() if d else F.col(n).asc() for _, n, d in firsts)).select("v").limit(spec.most + 1).collect()
        if len(rows) > spec.most:
            raise TableError(f"more than {spec.most} pivot values")
        values = [r.v for r in rows]
    else:
        values = list(spec.listed)
    if not values:
        return Table(t._df.select(*(quoted(c) for c in groups)).limit(0), groups, [])
    text = lambda v: "null" if v is None else str(v).lower() if isinstance(v, bool) else str(v)
    names = [f"{text(v)}_{c}" for v in values for c in spec.value_columns]
    if set(names) & set(groups):
        raise TableError(f"pivot columns {sorted(set(names) & set(groups))} exist already")
    distinct(groups + names)
    # each cell carries the place of its row; the place of a group is the first of them
    heads = [(c.alias(f"__f{i}"), f"__f{i}", d) for i, (c, d) in enumerate(_first_row(t._order))]
    cells = [F.first(quoted(c)).alias(f"c{i}") for i, c in enumerate(spec.value_columns)]
    keys = [F.col(quoted(c)) for c in groups]
    wide = t._df.groupBy(*keys).pivot(quoted(spec.column), values).agg(*cells, F.count(F.lit(1)).alias("n"), *(c for c, _, _ in heads))
    each = len(cells) + 1 + len(heads)
    flat = [f"g{i}" for i in range(len(groups))] + [f"p{i}_{j}" for i in range(len(values)) for j in range(each)]
    wide = wide.toDF(*flat)
    out = [F.col(f"g{i}").alias(c) for i, c in enumerate(groups)]
    counts = [F.col(f"p{i}_{len(cells)}") for i in range(len(values))]
    many = F.lit(False)
    for n in counts:
        many = many | (F.coalesce(n, F.lit(0)) > 1)
    wide = wide.where(F.when(many, F.raise_error(F.lit("pivot: several rows for one cell")).cast("boolean")).otherwise(True))
    k = 0
    for i in range(len(values)):
        for j in range(len(cells)):
            cell = F.col(f"p{i}_{j}")
            out.append((F.when(counts[i].isNull(), F.lit(spec.fill)).otherwise(cell) if spec.fill is not None else cell).alias(names[k]))
            k += 1
    order = []
    for h, (_, _, d) in enumerate(heads):
        places = [F.col(f"p{i}_{len(cells) + 1 + h}") for i in range(len(values))]
        first = places[0] if len(places) == 1 else (F.greatest if d else F.least)(*places)
        out.append(first.alias(f"__h{h}"))
        order.append((F.col(f"__h{h}"), d))
    return Table._ordered(wide.select(*out), groups + names, order)


def melt(t: Table, spec: Melt) -> Table:
    """One row per row and source column, nulls kept."""
    from weft.table import Table

    spec = spec.build()
    existing(list(spec.sources), t.columns)
    for name in (spec.type_name, spec.value_name):
        from weft.naming import fresh

        fresh(name, t.columns)
    types = {t.df.schema[c].dataType.simpleString() for c in spec.sources}
    if len(types) > 1 and spec.cast is None:
        raise TableError(f"melted columns are of different types {sorted(types)}; choose one with cast_to")
    kept = [c for c in t.columns if c not in spec.sources]
    value = lambda c: F.col(quoted(c)).cast(spec.cast) if spec.cast else F.col(quoted(c))
    ready = t._df.select(*(quoted(c) for c in kept), *(F.col(o) for o in t._hidden()), *(value(c).alias(c) for c in spec.sources))
    ids = [quoted(c) for c in kept] + t._hidden()
    out = ready.unpivot([F.col(c) for c in ids], [F.col(quoted(c)) for c in spec.sources], spec.type_name, spec.value_name)
    place = F.array_position(F.array(*(F.lit(c) for c in spec.sources)), F.col(spec.type_name))
    return Table._ordered(out, [*kept, spec.type_name, spec.value_name], [*((F.col(o), d) for o, d in t._order), (place, False)])
