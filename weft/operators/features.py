"""One wide row per entity from events: count, latest start and total duration of every event type.

The events are bucketed by entity and sorted by entity, type and event id in one shuffle; each task then
streams its buckets, skips repeated deliveries, turns runs of equal (entity, type) into counters, totals
and latest times, and emits wide rows in which every type has its three columns. An entity of salt_rows
events or more is bucketed by entity and a salt of the event id, about salt_rows events to a bucket; it
has one wide row per salt, and only those rows are added up at the end.

Defined cases: events without entity are left out. A null or blank type is the type `none`. The same
event id under one entity and type counts once, by its delivery with the latest start (then the longest);
events without id all count. Null or negative
durations add nothing (an end before the start is moved by one day first), null starts are no latest
time. A type that an entity never had gives count 0, total 0 and no latest time. An empty table gives
an empty result without type columns. More than max_types types raise an error: none is dropped.
Extra columns are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.operators.intervals import DAY_US
from weft.operators.skew import heavy_groups, salted, without


def slugs(types: list[str]) -> list[str]:
    """A column name for each type; types that would share one get a number."""
    out: list[str] = []
    for t in types:
        base = slug = re.sub(r"[^a-z0-9]+", "_", t.lower())
        n = 2
        while slug in out:
            slug, n = f"{base}_{n}", n + 1
        out.append(slug)
    return out


NEVER = np.iinfo(np.int64).min


class _Wide:
    """Adds runs to rows of width types; a row per (entity, salt)."""

    def __init__(self, types: int, names: list[str], chunk: int) -> None:
        self.types, self.names, self.chunk = types, names, chunk
        self.clear()

    def clear(self) -> None:
        self.entities: list[str] = []
        self.count = np.zeros((self.chunk, self.types), np.int64)
        self.total = np.zeros((self.chunk, self.types), np.int64)
        self.last = np.full((self.chunk, self.types), NEVER, np.int64)

    def batch(self) -> pa.RecordBatch:
        n = len(self.entities)
        columns = [pa.array(self.entities, pa.string())]
        for t in range(self.types):
            last = self.last[:n, t]
            columns += [
                pa.array(self.count[:n, t]),
                pa.array(last, pa.int64(), mask=last == NEVER).cast(pa.timestamp("us")),
                pa.array(self.total[:n, t] / 1e6),
            ]
        return pa.record_batch(columns, names=self.names)


def _stream(types: int, names: list[str], chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide, at, before = _Wide(types, names, chunk), None, None
        for b in batches:
            if not b.num_rows:
                continue
            entity = b.column(0).dictionary_encode()
            words = entity.dictionary.to_pylist()
            code = entity.indices.to_numpy()
            salt, kind = b.column(1).to_numpy(), b.column(2).to_numpy()
            event = b.column(3).fill_null(-1).to_numpy()
            no_event = np.asarray(b.column(3).is_null().to_numpy(zero_copy_only=False))
            start = b.column(4).fill_null(NEVER).to_numpy()
            length = b.column(5).fill_null(0).to_numpy()
            new = np.ones(len(code), bool)
            new[1:] = (code[1:] != code[:-1]) | (salt[1:] != salt[:-1])
            first = new.copy()  # the first delivery of an event
            first[1:] |= (kind[1:] != kind[:-1]) | (event[1:] != event[:-1]) | no_event[1:]
            if before is not None:
                same = (words[code[0]], salt[0]) == at
                new[0] = not same
                first[0] = not (same and before == (kind[0], event[0])) or no_event[0]
            before = (kind[-1], event[-1])
            row = np.cumsum(new) - 1 + len(wide.entities)
            begun = [words[c] for c in code[new]]
            done = 0
            while True:  # whole chunks of rows, then the rest
                room = wide.chunk - len(wide.entities)
                take, begun = begun[:room], begun[room:]
                wide.entities += take
                end = len(row) if not begun else int(np.searchsorted(row, wide.chunk))
                part = slice(done, end)
                keep = first[part]
                r, k = row[part][keep], kind[part][keep]
                np.add.at(wide.count, (r, k), 1)
                np.add.at(wide.total, (r, k), length[part][keep])
                np.maximum.at(wide.last, (r, k), start[part][keep])
                if not begun:
                    break
                yield wide.batch()
                wide.clear()
                row = row - wide.chunk
                done = end
            at = (words[code[-1]], salt[-1])
        if wide.entities:
            yield wide.batch()

    return run


def _added(types: int, names: list[str], chunk: int):
    """Wide rows sorted by entity (one per salt) to one row per entity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = _Wide(types, names, chunk)
        for b in batches:
            column = lambda i: [b.column(c) for c in range(1 + i, b.num_columns, 3)]  # noqa: E731, B023
            count = np.stack([c.to_numpy() for c in column(0)], axis=1)
            last = np.stack([c.cast(pa.int64()).fill_null(NEVER).to_numpy() for c in column(1)], axis=1)
            total = np.stack([np.rint(c.to_numpy() * 1e6).astype(np.int64) for c in column(2)], axis=1)
            for i, entity in enumerate(b.column(0).to_pylist()):
                if not wide.entities or wide.entities[-1] != entity:
                    if len(wide.entities) == chunk:
                        yield wide.batch()
                        wide.clear()
                    wide.entities.append(entity)
                row = len(wide.entities) - 1
                wide.count[row] += count[i]
                wide.total[row] += total[i]
                wide.last[row] = np.maximum(wide.last[row], last[i])
        if wide.entities:
            yield wide.batch()

    return run


def event_features(
    events: DataFrame,
    entity: Column,
    kind: Column,
    event_id: str,
    start: str,
    end: str,
    max_types: int = 4_000,
    salt_rows: int = 50_000,
    chunk: int = 512,
) -> DataFrame:
    """entity and, for every type t, t_n (bigint), t_last (timestamp_ntz) and t_total_s (double seconds)."""
    us = lambda c: F.unix_micros(events[c].cast("timestamp_ntz").cast("timestamp"))
    rows = events.select(
        entity.alias("entity"), F.coalesce(kind, F.lit("none")).alias("kind"), events[event_id].cast("bigint").alias("event"), us(start).alias("s"), us(end).alias("e")
    ).where("entity is not null")
    types = sorted(r.kind for r in rows.select("kind").distinct().limit(max_types + 1).collect())
    if len(types) > max_types:
        raise ValueError(f"more than {max_types} event types")
    numbers = F.broadcast(events.sparkSession.createDataFrame(list(zip(types, range(len(types)))), "kind string, nr int"))  # at most max_types rows
    length = F.when(F.col("e") < F.col("s"), F.col("e") + DAY_US).otherwise(F.col("e")) - F.col("s")
    ready = rows.join(numbers, "kind").select("entity", F.col("nr").alias("kind"), "event", "s", F.greatest(length, F.lit(0)).alias("length"))
    named = slugs(types)
    names = ["entity", *(f"{t}_{x}" for t in named for x in ("n", "last", "total_s"))]
    kinds = {"n": "bigint", "last": "timestamp_ntz", "total_s": "double"}
    schema = ", ".join(["entity string", *(f"`{t}_{x}` {k}" for t in named for x, k in kinds.items())])

    def wide(part: DataFrame, *keys: str) -> DataFrame:
        buckets = part.repartition(*keys).sortWithinPartitions("entity", "salt", "kind", "event", F.col("s").desc_nulls_last(), F.col("length").desc_nulls_last())
        return buckets.select("entity", "salt", "kind", "event", "s", "length").mapInArrow(_stream(len(types), names, chunk), schema)

    heavy = heavy_groups(rows.groupBy("entity").agg(F.count(F.lit(1)).alias("n")), ["entity"], salt_rows)
    out = wide(without(ready, heavy, ["entity"]).withColumn("salt", F.lit(0)), "entity")
    if heavy is not None:  # all deliveries of an event have one salt; events without id are spread row by row
        spread = F.when(F.col("event").isNotNull(), F.xxhash64("event")).otherwise(F.monotonically_increasing_id())
        parts = wide(salted(ready, heavy, ["entity"], by=spread), "entity", "salt")
        out = out.unionAll(parts.repartition("entity").sortWithinPartitions("entity").mapInArrow(_added(len(types), names, chunk), schema))
    return out
