"""The N best rows of every group, ties resolved the same way everywhere.

Partition lower bounds: every task keeps the N best of each group among its own rows; the N-th of them
is a bound, since at least N rows of the group are as good. The survivors are written, the greatest
bound of each group is taken and joined to them by broadcast, and what is worse is filtered out before
anything is shuffled; the rest is ranked. The broadcast holds the `bounds` groups with bounds in most
tasks, so its size is fixed; a group that is not in it has few survivors anyhow. Groups with more than
group_rows survivors are ranked by salt before they are ranked as a whole. A task whose state grows beyond
`flush_rows` rows sends what it has and starts afresh, which only makes its bounds weaker.

Order: score descending, then id ascending. Defined cases: rows without group, score or id are left
out, NaN is no score, infinities are scores, -0.0 and 0.0 tie. Rows equal in score and id are
repeats and each takes a place. Groups with fewer than N rows are kept whole. Empty input gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.operators.skew import MOST, heavy_groups, salted, without
from weft.plans.stage import written


def _best(group: np.ndarray, score: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the n best of each group, in order, and their places from 0."""
    order = np.lexsort((row, -score, group))
    g = group[order]
    start = np.flatnonzero(np.diff(g, prepend=g[0] - 1))
    place = np.arange(len(g)) - np.repeat(start, np.diff(np.append(start, len(g))))
    keep = place < n
    return order[keep], place[keep]


def _local(n: int, names: list[str], chunk: int, flush_rows: int):
    """Rows (group, score, id) to the task's survivors, the n-th of a group marked as a bound."""

    def reduced(held: list[pa.RecordBatch]) -> pa.Table:
        t = pa.Table.from_batches(held)
        group = t.column(0).combine_chunks().dictionary_encode()
        group = group.combine_chunks() if isinstance(group, pa.ChunkedArray) else group
        at, place = _best(group.indices.to_numpy(), t.column(1).to_numpy(), t.column(2).to_numpy(), n)
        out = t.take(pa.array(at)).combine_chunks()
        return out.append_column("bound", pa.array(place == n - 1))

    def send(t: pa.Table) -> Iterator[pa.RecordBatch]:
        for b in t.rename_columns(names).to_batches(max_chunksize=20_000):
            yield b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, filled, need = [], 0, chunk
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            filled += b.num_rows
            if filled >= need:
                t = reduced(held)
                if len(t) > flush_rows:
                    yield from send(t)
                    held, filled, need = [], 0, chunk
                else:
                    held, filled = t.drop_columns(["bound"]).to_batches(), len(t)
                    need = max(chunk, 2 * filled)  # sorted again only once it has doubled
        if held:
            yield from send(reduced(held))

    return run


def top_n(
    rows: DataFrame, group: str, score: str, row_id: str, n: int, chunk: int = 100_000, flush_rows: int = 2_000_000, group_rows: int = 200_000, bounds: int = MOST
) -> DataFrame:
    """group, score, row_id, place (from 1) of the n best rows of each group."""
    names = ["g", "score", "id", "bound"]
    ready = rows.select(F.col(group).cast("string").alias("g"), (F.col(score).cast("double") + F.lit(0.0)).alias("score"), F.col(row_id).cast("bigint").alias("id"))
    ready = ready.where("g is not null and score is not null and not isnan(score) and id is not null")
    kept = written(ready.mapInArrow(_local(n, names, chunk, flush_rows), "g string, score double, id bigint, bound boolean"), "survivors")
    # ~id falls as id rises, so the greatest struct is the best bound
    best = F.max(F.struct("score", F.bitwise_not("id").alias("not_id"))).alias("best")
    bounded = heavy_groups(kept.where("bound").groupBy("g").agg(F.count(F.lit(1)).alias("n"), best), ["g"], 1, bounds)
    level = kept.select("g", "score", "id")
    if bounded is not None:
        as_good = (F.col("score") > F.col("best.score")) | ((F.col("score") == F.col("best.score")) & (F.bitwise_not("id") >= F.col("best.not_id")))
        level = level.join(F.broadcast(bounded.select("g", "best")), "g", "left").where(F.col("best").isNull() | as_good).drop("best")
        many = heavy_groups(bounded.select("g", (F.col("n") * n).alias("n")), ["g"], group_rows)
        if many is not None:  # groups that had bounds in very many tasks are ranked by salt first
            w = Window.partitionBy("g", "salt").orderBy(F.desc("score"), F.asc("id"))
            first = salted(level, many, ["g"]).withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)
            level = without(level, many, ["g"]).unionAll(first.select("g", "score", "id"))
    ranked = level.withColumn("place", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("score"), F.asc("id"))))
    return ranked.where(F.col("place") <= n).select(F.col("g").alias(group), F.col("score").alias(score), F.col("id").alias(row_id), "place")
