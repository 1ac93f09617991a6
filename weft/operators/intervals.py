"""Overlapping and gapped intervals per entity: continuous periods and the gaps between them.

Keyed state: each entity owns an ordered map of disjoint intervals (IntervalMap). Spans are inserted in
the order in which they come; an insertion finds what it overlaps by binary search, merges it and
updates the gaps beside it. Rows are shuffled once by entity and only grouped, not sorted by time; one
map at a time is in a task's memory. weft.streaming.intervals keeps the same map in streaming state.

An entity of slice_rows spans or more is spread over tasks by range of start, with borders that follow
its own spans, so that a task has about slice_rows of them whatever the entity's size and however its
starts crowd. Equal starts are united before that. Each task merges its range in a map of its own; the
latest end of all earlier ranges, one row a range and entity, then decides which intervals go on from
before and where the gaps are. Those rows are tables: nothing of the entities reaches the driver.

Defined cases: rows without entity, start or end are left out. An end before its start is moved by
`wrap` (default one day) or, with wrap=None, the row is left out; an end that is still before its
start is left out. Spans that touch are continuous; a span of no length is a period. Repeated spans
change nothing. Empty input gives empty results. Extra columns are never read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.operators.skew import heavy_groups, part_of, without
from weft.plans.stage import written

DAY_US = 86_400_000_000
#: Ranges over which the large entities are spread at most.
MOST_RANGES = 20_000


class IntervalMap:
    """Disjoint closed intervals in order, and the gap before each (as the end of its predecessor)."""

    __slots__ = ("before", "ends", "starts")

    def __init__(self, starts: list[int] | None = None, ends: list[int] | None = None) -> None:
        self.starts, self.ends = starts or [], ends or []
        self.before: list[int | None] = [None, *self.ends[:-1]] if self.ends else []

    def insert(self, start: int, end: int) -> None:
        starts, ends, before = self.starts, self.ends, self.before
        i, j = bisect_left(ends, start), bisect_right(starts, end)
        if j - i == 1:  # it overlaps one interval, which stays where it is
            if start < starts[i]:
                starts[i] = start
            if end <= ends[i]:
                return
            ends[i] = end
        else:
            if i < j:
                start, end = min(start, starts[i]), max(end, ends[j - 1])
            starts[i:j], ends[i:j], before[i:j] = [start], [end], [ends[i - 1] if i else None]
        if i + 1 < len(before):
            before[i + 1] = end

    def gaps(self) -> Iterator[tuple[int, int]]:
        return zip(self.before[1:], self.starts[1:], strict=True)


def spans(df: DataFrame, entity: Column, start: str, end: str, wrap: int | None = DAY_US) -> DataFrame:
    """entity, s, e in microseconds, for the rows that are spans."""
    us = lambda c: F.unix_micros(df[c].cast("timestamp_ntz").cast("timestamp"))
    rows = df.select(entity.alias("entity"), us(start).alias("s"), us(end).alias("e")).where("entity is not null and s is not null and e is not null")
    if wrap is not None:
        rows = rows.withColumn("e", F.when(F.col("e") < F.col("s"), F.col("e") + wrap).otherwise(F.col("e")))
    return rows.where("e >= s")


MERGED = "entity string, slice int, s bigint, e bigint, prev bigint"


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (entity, s, e) grouped by entity to the intervals of MERGED; slice is the task."""
    task = TaskContext.get().partitionId()
    entities: list[str] = []
    numbers: tuple[list, ...] = ([], [], [])

    def flush() -> pa.RecordBatch:
        n = len(entities)
        batch = pa.record_batch(
            [pa.array(entities, pa.string()), pa.array([task] * n, pa.int32()), *(pa.array(x, pa.int64()) for x in numbers)],
            names=["entity", "slice", "s", "e", "prev"],
        )
        for x in (entities, *numbers):
            x.clear()
        return batch

    def emit() -> None:
        entities.extend([at] * len(state.starts))
        for out, own in zip(numbers, (state.starts, state.ends, state.before), strict=True):
            out.extend(own)

    at, state = None, IntervalMap()
    for batch in batches:
        for entity, s, e in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if entity != at:
                if at is not None:
                    emit()
                    if len(entities) > 20_000:
                        yield flush()
                at, state = entity, IntervalMap()
            state.insert(s, e)
    if at is not None:
        emit()
        yield flush()


def _split(rows: DataFrame, slice_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """(intervals of the ordinary entities, intervals of the large ones by range, or None), both MERGED.

    The latter have `reach` too, the latest end of all earlier ranges of the entity.
    """
    heavy = heavy_groups(rows.groupBy("entity").agg(F.count(F.lit(1)).alias("n")), ["entity"], slice_rows)
    light = without(rows, heavy, ["entity"]).select("entity", "s", "e")
    whole = light.repartition("entity").sortWithinPartitions("entity").mapInArrow(_merge, MERGED)
    if heavy is None:
        return whole, None
    large = rows.join(F.broadcast(heavy.select("entity")), "entity").groupBy("entity", "s").agg(F.max("e").alias("e"))
    ranges = large.repartitionByRange(min(part_of(heavy), MOST_RANGES), "entity", "s").sortWithinPartitions("entity")
    cut = written(ranges.mapInArrow(_merge, MERGED), "ranges")
    earlier = Window.partitionBy("entity").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    reach = cut.groupBy("entity", "slice").agg(F.max("e").alias("top")).select("entity", "slice", F.max("top").over(earlier).alias("reach"))
    return whole, cut.join(reach, ["entity", "slice"])


def _begun(cut: DataFrame) -> DataFrame:
    """The intervals of the large entities that do not go on from before, with the end before them as `prev`."""
    return cut.withColumn("prev", F.greatest("prev", "reach")).where("prev is null or s > prev")


def gaps(rows: DataFrame, slice_rows: int = 50_000) -> DataFrame:
    """Gaps between consecutive periods of spans(): entity, gap_start, gap_end in microseconds."""
    whole, cut = _split(rows, slice_rows)
    named = ["entity", F.col("prev").alias("gap_start"), F.col("s").alias("gap_end")]
    out = whole.where("prev is not null").select(*named)
    return out if cut is None else out.unionAll(_begun(cut).where("prev is not null").select(*named))


def periods(rows: DataFrame, slice_rows: int = 50_000) -> DataFrame:
    """Continuous periods of spans(): entity, period_start, period_end in microseconds."""
    whole, cut = _split(rows, slice_rows)
    out = whole.select("entity", F.col("s").alias("period_start"), F.col("e").alias("period_end"))
    if cut is None:
        return out
    # a period ends where the next gap begins: in its own range, or in the next range that has a gap, or with the entity
    begun = _begun(cut)
    first = begun.groupBy("entity", "slice").agg(F.min("prev").alias("first_prev"))
    every = cut.groupBy("entity", "slice").agg(F.max("e").alias("top")).join(first, ["entity", "slice"], "left")
    later = Window.partitionBy("entity").orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1)
    after = every.select(
        "entity", "slice", F.coalesce(F.last("first_prev", ignorenulls=True).over(later), F.max("top").over(Window.partitionBy("entity"))).alias("final")
    )
    within = begun.withColumn("next", F.lead("prev").over(Window.partitionBy("entity", "slice").orderBy("s")))
    ends = within.join(after, ["entity", "slice"]).select("entity", F.col("s").alias("period_start"), F.coalesce("next", "final").alias("period_end"))
    return out.unionAll(ends)


def as_text(us: Column) -> Column:
    """Microseconds as yyyy-MM-dd HH:mm:ss."""
    return F.date_format(F.timestamp_micros(us), "yyyy-MM-dd HH:mm:ss")


__all__ = ["IntervalMap", "as_text", "gaps", "periods", "spans"]
