"""Exact percentiles per group by bisection, from counts that add up across partitions and days.

A double is mapped to the whole number of the same order (its bits, negative values reversed). For
every group and percentile an interval is kept that holds the wanted rank. Each pass counts the rows
at or below the midpoint, keeps the half with the rank, and draws the interval's ends in to the values
that occur there, until one value is left. The counts are sums, so they can be taken over any split of
the data: summary() gives (group, code, n) per load, union_of() adds summaries up, and percentiles()
bisects rows and summaries alike. With drop_bits > 0 a summary keeps only the upper bits of a code: at
most a relative error of 2^(drop_bits - 52) (returned as max_rel_error; 0 when exact), and a bounded
number of rows per group.

Groups of fewer than heavy_rows rows are bisected inside one task each, all groups of a partition at once
and vectorised. The others, all together, are bisected by distributed passes, one scan of their codes a
pass and some eight halvings in it, since counts below 255 and more equally spaced midpoints come from one
map-side combined aggregate. The intervals of all groups and percentiles are a table; rows meet them by
group and salt. Nothing of the groups is collected.

The percentile p of n values is the value of rank max(1, ceil(p * n)). Defined cases: null and NaN are
no values; a group without values has no row; infinities are values; -0.0 is 0.0; null group keys are
groups. Ties and repeats count as often as they occur. Empty input gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.operators.skew import heavy_groups, salted, without
from weft.plans.stage import counts_of, release, written


def encode(values: np.ndarray) -> np.ndarray:
    """The int64 of each double that has the same order."""
    bits = (np.asarray(values, np.float64) + 0.0).view(np.int64)
    return bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))


def decode(codes: np.ndarray) -> np.ndarray:
    codes = np.asarray(codes, np.int64)
    return (codes ^ ((codes >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))).view(np.float64)


def encoded(rows: DataFrame, groups: list[str], value: str, drop_bits: int = 0) -> DataFrame:
    """groups, code, n = 1 for every row with a value."""
    kept = rows.select(*groups, F.col(value).cast("double").alias("code")).where("code is not null and not isnan(code)")
    fields = [f for f in kept.schema.fields if f.name != "code"]
    schema = T.StructType([*fields, T.StructField("code", T.LongType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code = (encode(b.column(b.num_columns - 1).to_numpy()) >> drop_bits) << drop_bits
            columns = [*b.columns[:-1], pa.array(code), pa.array(np.ones(len(code), np.int64))]
            yield pa.record_batch(columns, names=schema.names)

    return kept.mapInArrow(run, schema)


def summary(rows: DataFrame, groups: list[str], value: str, drop_bits: int = 0) -> DataFrame:
    """groups, code, n: the counts of one load. Summaries with the same drop_bits can be combined."""
    return encoded(rows, groups, value, drop_bits).groupBy(*groups, "code").agg(F.sum("n").alias("n"))


def union_of(summaries: list[DataFrame]) -> DataFrame:
    """One summary of the rows behind several."""
    every = reduce(DataFrame.unionByName, summaries)
    return every.groupBy(*(c for c in every.columns if c != "n")).agg(F.sum("n").alias("n"))


def _bisect(code: np.ndarray, n: np.ndarray, group: np.ndarray, count: int, rank: np.ndarray) -> np.ndarray:
    """For each of `count` groups (rows of a group are neighbours) the smallest code with at least `rank` rows up to it."""
    out = np.zeros(count, np.int64)
    ids = np.arange(count)
    start = np.flatnonzero(np.diff(group, prepend=-1))
    low, high, rank = np.minimum.reduceat(code, start), np.maximum.reduceat(code, start), rank.copy()
    while True:
        done = low == high
        out[ids[done]] = low[done]
        if done.all():
            return out
        if done.any():
            left = ~done
            size = np.diff(np.append(start, len(code)))
            rows = np.repeat(left, size)
            code, n, size = code[rows], n[rows], size[left]
            ids, low, high, rank = ids[left], low[left], high[left], rank[left]
            start = np.concatenate(([0], np.cumsum(size)[:-1]))
        size = np.diff(np.append(start, len(code)))
        mid = (low >> 1) + (high >> 1) + (low & high & 1)
        under = code <= np.repeat(mid, size)
        here = (code >= np.repeat(low, size)) & (code <= np.repeat(high, size))
        below = np.add.reduceat(np.where(under & here, n, 0), start)
        lower = below >= rank
        top = np.maximum.reduceat(np.where(under, code, np.iinfo(np.int64).min), start)
        bottom = np.minimum.reduceat(np.where(under, np.iinfo(np.int64).max, code), start)
        high, low, rank = np.where(lower, top, high), np.where(lower, low, bottom), np.where(lower, rank, rank - below)


def _ranks(total: np.ndarray, p: float) -> np.ndarray:
    return np.maximum(1, np.ceil(np.round(p * total, 9))).astype(np.int64)


def _within_tasks(keys: int, ps: list[float], names: list[str], chunk: int = 200_000):
    """Rows sorted by group to one row per group."""

    def solve(table: pa.Table, group: np.ndarray) -> pa.RecordBatch:
        code, n = (table.column(keys + i).combine_chunks().to_numpy() for i in range(2))
        start = np.flatnonzero(np.diff(group, prepend=-1))
        total = np.add.reduceat(n, start)
        found = [pa.array(decode(_bisect(code, n, group, len(start), _ranks(total, p)))) for p in ps]
        heads = table.take(pa.array(start)).combine_chunks().to_batches()[0].columns[:keys]
        return pa.record_batch([*heads, pa.array(total), *found], names=names)

    def groups_of(table: pa.Table) -> np.ndarray:
        edge = np.zeros(len(table), bool)
        for i in range(keys):
            c = table.column(i).combine_chunks().dictionary_encode(null_encoding="encode")
            at = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c).indices.to_numpy()
            edge[1:] |= at[1:] != at[:-1]
        return np.cumsum(edge)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, filled, need = [], 0, chunk
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            filled += b.num_rows
            if filled >= need:
                table = pa.Table.from_batches(held)
                group = groups_of(table)
                cut = int(np.searchsorted(group, group[-1]))  # the last group may go on
                if cut:
                    yield solve(table.slice(0, cut), group[:cut])
                held = table.slice(cut).combine_chunks().to_batches()
                filled = len(table) - cut
                need = max(chunk, 2 * filled)  # a group longer than a chunk is not cut again at every batch
        if held:
            table = pa.Table.from_batches(held)
            yield solve(table, groups_of(table))

    return run


def _distributed(hot: DataFrame, heavy: DataFrame, ps: list[float]) -> DataFrame:
    """nr and a code per percentile (c0, c1, ...) of the groups of hot(nr, salt, code, n)."""
    ends = hot.groupBy("nr").agg(F.min("code").alias("low"), F.max("code").alias("high"))
    wanted = F.array(*(F.struct(F.lit(i).alias("p"), F.greatest(F.lit(1), F.ceil(F.round(F.lit(p) * F.col("total"), 9))).alias("rank")) for i, p in enumerate(ps)))
    state = ends.join(heavy.select("nr", "parts", F.explode(wanted).alias("w")), "nr").select("nr", "parts", "w.p", "low", "high", "w.rank")
    state = written(state, "intervals", open=F.col("low") < F.col("high"))
    while counts_of(state)["open"]:
        left = state.where("low < high")
        half = F.shiftright("high", 1) - F.shiftright("low", 1)  # the whole length may be more than a bigint holds
        bits = F.greatest(F.lit(0), F.ceil(F.log2(half.cast("double") + 1)).cast("int") - 7)
        intervals = left.select("nr", "parts", "low", "high").distinct().withColumn("bits", bits)
        intervals = intervals.select("nr", F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1)).alias("salt"), "low", "high", "bits")
        inside = hot.join(intervals, ["nr", "salt"]).where("code >= low and code <= high")
        cell = F.expr("shiftright(code, bits) - shiftright(low, bits)").alias("cell")
        cells = inside.groupBy("nr", "low", "high", cell).agg(F.sum("n").alias("n"), F.min("code").alias("first"), F.max("code").alias("last"))
        upto = F.sum("n").over(Window.partitionBy("nr", "low", "high").orderBy("cell"))  # some 500 cells at most
        found = left.join(cells.withColumn("upto", upto), ["nr", "low", "high"]).where("rank <= upto and rank > upto - n")
        drawn = found.select("nr", "parts", "p", F.col("first").alias("low"), F.col("last").alias("high"), F.expr("rank - (upto - n)").alias("rank"))
        last, state = state, written(drawn.unionAll(state.where("low = high")), "intervals", open=F.col("low") < F.col("high"))
        release(last)
    return state.groupBy("nr").agg(*(F.max(F.when(F.col("p") == i, F.col("low"))).alias(f"c{i}") for i in range(len(ps))))


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers and codes to numbers and values."""
    for b in batches:
        yield pa.record_batch([b.column(0), *(pa.array(decode(c.to_numpy())) for c in b.columns[1:])], names=b.schema.names)


def percentiles(counts: DataFrame, groups: list[str], ps: dict[str, float], drop_bits: int = 0, heavy_rows: int = 50_000) -> DataFrame:
    """groups, n, one column per percentile, max_rel_error; from encoded(), summary() or union_of()."""
    named = list(ps.values())
    counts = written(counts.select(*groups, "code", "n"), "codes")
    names = [*groups, "n", *ps]
    schema = T.StructType([*(counts.schema[g] for g in groups), T.StructField("n", T.LongType()), *(T.StructField(p, T.DoubleType()) for p in ps)])
    sizes = counts.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("total"))
    heavy = heavy_groups(sizes, groups, heavy_rows)
    light = without(counts, heavy, groups)
    out = light.repartition(*groups).sortWithinPartitions(*groups).mapInArrow(_within_tasks(len(groups), named, names), schema)
    if heavy is not None:
        hot = salted(counts, heavy, groups, "nr", by=F.xxhash64("code")).groupBy("nr", "salt", "code").agg(F.sum("n").alias("n"))  # a frequent value is one row
        hot = written(hot, "heavy-codes")
        values = _distributed(hot, heavy, named).mapInArrow(_decoded, "nr bigint, " + ", ".join(f"c{i} double" for i in range(len(named))))
        few = values.join(heavy, "nr").select(*groups, F.col("total").alias("n"), *(F.col(f"c{i}").alias(p) for i, p in enumerate(ps)))
        out = out.unionAll(few)
    return out.withColumn("max_rel_error", F.lit(0.0 if drop_bits == 0 else 2.0 ** (drop_bits - 52)))
