"""How often two items occur together, and how much more often than by chance.

Every basket's pairs (a < b) become packed 64-bit codes a << 32 | b. Tasks sort their codes in bounded
runs and run-length count each, so what is shuffled is (code, count) and a very frequent pair is one
row a run. After the shuffle Spark's external sorter spills and multiway-merges the runs of a
partition, and equal neighbours are added up while streaming. Association is measured by lift and by
the odds ratio with continuity correction (one half added to each of the four cells).

Exact pruning: a pair cannot occur more often than its rarer item, so with min_together > 1 only items
in so many baskets form codes. Baskets meet the table of those items by a join: the most frequent items,
a fixed number, are broadcast, so that the shuffled join of the others has no hot item. A basket of more
than wide_basket items is spread over tasks by its first item.

Defined cases: null or empty baskets and rows without basket are left out. Repeated deliveries of a
basket are united; items repeated in a basket count once. Items must be whole numbers in 0 .. 2^31-1
(null items are skipped, others raise an error). Empty input gives no pairs. Extra columns are never
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.operators.skew import MOST, heavy_groups, without
from weft.plans.stage import counts_of, written

RUN = "code bigint, n bigint"
#: Codes that a task sorts in memory at once.
RUN_CODES = 1 << 21


def book_numbers(books: Column) -> Column:
    """The distinct numbers in a list like `b4|B17 |`; parts that are no book are skipped."""
    number = lambda x: F.regexp_extract(F.lower(x), "^[\\s\u00a0]*b([0-9]+)[\\s\u00a0]*$", 1)
    parts = F.filter(F.transform(F.split(books, r"\|"), number), lambda x: x != "")
    return F.array_distinct(F.transform(parts, lambda x: x.cast("bigint")))


def _counted(codes: np.ndarray, n: np.ndarray | None = None) -> pa.RecordBatch:
    """Run-length counts of sorted codes."""
    edge = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    size = np.diff(np.append(edge, len(codes))) if n is None else np.add.reduceat(n, edge)
    return pa.record_batch([pa.array(codes[edge], pa.int64()), pa.array(size, pa.int64())], names=["code", "n"])


def _sorted_runs(limit: int = RUN_CODES):
    """Baskets (items, first, last) to sorted, counted runs of pair codes whose first item is at first .. last - 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, filled = [], 0
        for batch in batches:
            flat = batch.column(0).flatten().to_numpy()
            size = np.diff(batch.column(0).offsets.to_numpy())
            firsts, lasts = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            whole = (firsts == 0) & (lasts >= size)
            owner = np.repeat(np.arange(len(size)), size)
            mine = whole[owner]
            a, o = flat[mine], owner[mine]
            for d in range(1, int(size.max(initial=1))):  # all pairs that are d places apart in their basket
                same = o[d:] == o[:-d] if len(o) > d else np.zeros(0, bool)
                if not same.any():
                    break
                held.append((a[:-d][same] << 32) | a[d:][same])
                filled += len(held[-1])
                if filled >= limit:
                    yield _counted(np.sort(np.concatenate(held)))
                    held, filled = [], 0
            for row in np.flatnonzero(~whole):
                items = flat[owner == row]
                for i in range(int(firsts[row]), min(int(lasts[row]), len(items) - 1)):
                    held.append((items[i] << 32) | items[i + 1 :])
                    filled += len(held[-1])
                    if filled >= limit:
                        yield _counted(np.sort(np.concatenate(held)))
                        held, filled = [], 0
        if filled:
            yield _counted(np.sort(np.concatenate(held)))

    return run


def _merged_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (code, n) with equal neighbours added up, across batches."""
    code, n = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        out = _counted(batch.column(0).to_numpy(), batch.column(1).to_numpy())
        codes, counts = out.column(0).to_numpy(), out.column(1).to_numpy().copy()
        if code == codes[0]:
            counts[0] += n
        elif code is not None:
            yield pa.record_batch([pa.array([code], pa.int64()), pa.array([n], pa.int64())], names=["code", "n"])
        code, n = int(codes[-1]), int(counts[-1])
        if len(codes) > 1:
            yield pa.record_batch([pa.array(codes[:-1]), pa.array(counts[:-1])], names=["code", "n"])
    if code is not None:
        yield pa.record_batch([pa.array([code], pa.int64()), pa.array([n], pa.int64())], names=["code", "n"])


def _frequent(lists: DataFrame, top: DataFrame, rest: DataFrame | None) -> DataFrame:
    """The lists with only the items of these tables."""
    each = lists.select("basket", F.explode("items").alias("item"))
    kept = each.join(F.broadcast(top.select("item")), "item", "left_semi")
    if rest is not None:
        kept = kept.unionByName(without(each, top, ["item"]).join(rest.select("item"), "item", "left_semi"))
    return kept.groupBy("basket").agg(F.array_sort(F.collect_list("item")).alias("items"))


def _numbered(found: DataFrame, item: str, n: str, top: DataFrame, rest: DataFrame | None) -> DataFrame:
    """found with the baskets of an item, by broadcast of the most frequent ones and a shuffled join of the others."""
    out = found.join(F.broadcast(top.select(F.col("item").alias(item), F.col("n").alias(n))), item, "left")
    if rest is None:
        return out
    # pairs that need no other count are spread by keys that are no items
    key = F.when(F.col(n).isNull(), F.col(item)).otherwise(-1 - F.pmod(F.monotonically_increasing_id(), F.lit(10_000)))
    more = rest.select(F.col("item").alias("key"), F.col("n").alias("more"))
    return out.withColumn("key", key).join(more, "key", "left").withColumn(n, F.coalesce(n, "more")).drop("key", "more")


def pairs(rows: DataFrame, basket: str, items: Column, min_together: int = 1, broadcast_items: int = MOST, wide_basket: int = 1_000) -> DataFrame:
    """item_a, item_b, n_ab, n_a, n_b, n, lift, odds_ratio for pairs in at least min_together baskets.

    items is an array of whole numbers per row; n counts the baskets with at least one item.
    """
    each = rows.select(rows[basket].alias("basket"), F.explode(items).alias("item")).where("basket is not null and item is not null")
    fits = F.col("item").between(0, (1 << 31) - 1)
    each = each.select("basket", F.when(fits, F.col("item")).otherwise(F.raise_error(F.lit("items must be in 0 .. 2^31-1")).cast("bigint")).alias("item"))
    lists = written(each.groupBy("basket").agg(F.array_sort(F.collect_set("item")).alias("items")), "baskets", n=F.lit(1))
    n = counts_of(lists)["n"]
    counts = lists.select(F.explode("items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    counts = written(counts, "items", common=F.col("n") >= min_together)
    common = counts.where(F.col("n") >= min_together)
    top = heavy_groups(common, ["item"], min_together, broadcast_items)
    rest = common if counts_of(counts)["common"] > broadcast_items else None
    if top is None:
        top = counts.where(F.lit(False))
    if min_together > 1:
        lists = _frequent(lists, top, rest)
    size = F.size("items")
    # an ordinary basket is one piece; a wide one has a piece for every wide_basket items, which are spread over tasks
    step = F.explode(F.sequence(F.lit(0), size - 1, F.lit(wide_basket)))
    small = lists.where((size > 1) & (size <= wide_basket)).select("items", F.lit(0).alias("first"), size.alias("last"))
    wide = lists.where(size > wide_basket).select("items", step.alias("first")).withColumn("last", F.col("first") + wide_basket)
    runs = small.mapInArrow(_sorted_runs(), RUN).unionAll(wide.repartition(F.xxhash64("items"), "first").mapInArrow(_sorted_runs(), RUN))
    counted = runs.repartition("code").sortWithinPartitions("code").mapInArrow(_merged_runs, RUN)
    both = counted.where(F.col("n") >= min_together).select(
        F.shiftright("code", 32).alias("item_a"), F.col("code").bitwiseAND(0xFFFFFFFF).alias("item_b"), F.col("n").alias("n_ab")
    )
    out = _numbered(_numbered(both, "item_a", "n_a", top, rest), "item_b", "n_b", top, rest).withColumn("n", F.lit(n).cast("bigint"))
    ab, na, nb, total = (F.col(c).cast("double") for c in ("n_ab", "n_a", "n_b", "n"))
    odds = ((ab + 0.5) * (total - na - nb + ab + 0.5)) / ((na - ab + 0.5) * (nb - ab + 0.5))
    return out.select("item_a", "item_b", "n_ab", "n_a", "n_b", "n", (ab * total / (na * nb)).alias("lift"), odds.alias("odds_ratio"))


def more_often(factor: int) -> Column:
    """Whether a pair is together at least `factor` times as often as by chance; exact for counts up to 10^18."""
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    return wide("n_ab") * wide("n") >= (wide("n_a") * wide("n_b")).cast("decimal(37,0)") * factor
