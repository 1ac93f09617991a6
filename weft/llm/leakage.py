"""Evaluation texts inside training texts.

Size-partitioned MinHash containment search. Test items are short and documents long, so a sketch of a
whole document says little about one item in it. Items are therefore partitioned by size: those of `run`
words or more are searched by their windows of `run` consecutive words, shorter ones (with short_items) as
a whole, in a partition for each length. In the partition of size q a query is a set of q - shingle + 1 word
shingles, and a document is searched as its windows of q words, so both sides have one size and a
containment of `threshold` is a Jaccard similarity of at least threshold / (2 - threshold). Signatures are
`bands` codes of `rows` minimum hashes each, as many bands as find that similarity with probability
`recall`; at threshold 1 one band finds every match. Neighbouring windows with one code are one candidate.

The index of the items' codes is a table, joined on (size, band, code). A bitmap of those codes, of a
fixed size, lets the tasks that read the documents drop windows that no code can match; if it fills up, more
candidates reach the join and the result is the same. Index and items are broadcast up to broadcast_rows
rows; beyond that the joins are shuffled, and codes and windows with very many candidates are salted.

Candidates are verified: by exact shingle containment, and at threshold 1 by the words in their order.

Defined cases: null or empty texts match nothing; items shorter than `run` (or, with short_items,
than `shingle`) words match nothing; ids may be any bigint, null ids are left out; repeated documents
and items are one each. Extra columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.words import Words, blocks, mixed, pieces, shingles, sliding_minimum, spoken
from weft.operators.skew import copied, heavy_groups, salted, without
from weft.plans.stage import counts_of, written

WINDOW = "id bigint, size int, band int, code bigint, words string"
#: Bits of the bitmap, as a power of two: at least, and at most (8 MB).
BITMAP = (22, 26)


def signature(threshold: float, recall: float) -> tuple[int, int]:
    """(bands, rows) that find windows of one size with that containment with probability `recall`."""
    if threshold >= 1:
        return 1, 3
    rows = 2
    alike = (threshold / (2 - threshold)) ** rows
    return ceil(log(1 - recall) / log(1 - alike)), rows


def _codes(w: Words, base: np.ndarray, size: int, shingle: int, bands: int, rows: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which windows of `size` words are of one text, and each band's code of every window."""
    n = max(0, len(w.hash) - size + 1)
    whole = w.text[:n] == w.text[size - 1 : size - 1 + n]
    out = []
    for band in range(bands):
        code = np.zeros(n, np.uint64)
        for row in range(rows):
            seed = np.uint64(0x9E3779B97F4A7C15 * (band * rows + row + 1) & 0xFFFFFFFFFFFFFFFF)
            code = code * np.uint64(0x100000001B3) + sliding_minimum(mixed(base ^ seed), size - shingle + 1)[:n]
        out.append(mixed(code))
    return whole, out


def _clean(batch: pa.RecordBatch, overlap: int) -> tuple[list[int], list[str]]:
    ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
    kept = [(i, part) for i, t in zip(ids, texts, strict=True) if i is not None and t for part in pieces(spoken(t), overlap)]
    return [k[0] for k in kept], [k[1] for k in kept]


def _out(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string()]
    for at in range(0, len(rows), 20_000):
        columns = zip(*rows[at : at + 20_000], strict=True)
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["id", "size", "band", "code", "words"])


def _queries(run: int, shingle: int, short_items: bool, bands: int, rows: int):
    """Items to their windows."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = _clean(batch, run - 1)
            for first, last, w in blocks(texts):
                base = shingles(w, shingle)
                length = np.bincount(w.text, minlength=last - first)
                sizes = {run} | ({int(n) for n in np.unique(length) if shingle <= n < run} if short_items else set())
                found = []
                for size in sorted(sizes):
                    mine, codes = _codes(w, base, size, shingle, bands, rows)
                    if size < run:
                        mine = mine & (length[w.text[: len(mine)]] == size)
                    for at in np.flatnonzero(mine).tolist():
                        words = w.joined(at, size)
                        found += [(ids[first + w.text[at]], size, band, int(c[at].astype(np.int64)), words) for band, c in enumerate(codes)]
                yield from _out(found)

    return read


def _search(sizes: list[int], shingle: int, bands: int, rows: int, bitmap: np.ndarray, single: bool):
    """Documents to the stretches of words (with `single`, the windows) whose code may be in the index."""
    mask, overlap = np.uint64(len(bitmap) * 64 - 1), max(sizes, default=1) - 1

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = _clean(batch, overlap)
            for first, _, w in blocks(texts):
                base, found = shingles(w, shingle), []
                for size in sizes:
                    whole, codes = _codes(w, base, size, shingle, bands, rows)
                    if not len(whole):
                        continue
                    for band, code in enumerate(codes):
                        edge = np.ones(len(code), bool)  # a stretch is a run of windows of one text with one code
                        edge[1:] = (code[1:] != code[:-1]) | (whole[1:] != whole[:-1])
                        start = np.flatnonzero(edge)
                        bit = code[start] & mask
                        hit = ((bitmap[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1)).astype(bool) & whole[start]
                        end = np.append(start[1:], len(code))[hit]
                        for s, e in zip(start[hit].tolist(), end.tolist(), strict=True):
                            c, owner = int(code[s].astype(np.int64)), ids[first + w.text[s]]
                            if single:
                                found += [(owner, size, band, c, w.joined(at, size)) for at in range(s, e)]
                            else:
                                found.append((owner, size, band, c, w.joined(s, e - s + size - 1)))
                yield from _out(found)

    return read


def _bitmap(index: DataFrame, codes: int) -> np.ndarray:
    """A bit for each code's lower bits, in 64-bit words; at most 2^BITMAP[1] bits whatever the number of codes."""
    bits = min(BITMAP[1], max(BITMAP[0], ceil(log2(max(1, codes))) + 5))
    place = F.col("code").bitwiseAND((1 << bits) - 1)
    one = F.expr("shiftleft(1L, cast(place & 63 as int))")
    out = np.zeros(1 << (bits - 6), np.uint64)
    for r in index.select(place.alias("place")).groupBy(F.shiftright("place", 6).alias("at")).agg(F.bit_or(one).alias("bits")).collect():
        out[r.at] = np.int64(r.bits).astype(np.uint64)
    return out


def _meet(rows: DataFrame, table: DataFrame, n: int, keys: list[str], broadcast_rows: int, hot_rows: int) -> DataFrame:
    """rows joined to a table of n rows: by broadcast if it is small, else shuffled, with hot keys salted."""
    if n <= broadcast_rows:
        return rows.join(F.broadcast(table), keys)
    hot = heavy_groups(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), keys, hot_rows)
    out = without(rows, hot, keys).join(table, keys)
    if hot is None:
        return out
    return out.unionByName(salted(rows, hot, keys).join(copied(table, hot, keys), [*keys, "salt"]).drop("salt"))


def _shingled(words: Column, shingle: int) -> Column:
    """The distinct shingles of words with one blank between them."""
    parts = F.split(words, " ")
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(parts) - shingle + 1), lambda i: F.array_join(F.slice(parts, i, shingle), " ")))


def leaks(
    documents: DataFrame,
    items: DataFrame,
    doc_id: str,
    text: str,
    item_id: str,
    passage: str,
    run: int = 12,
    shingle: int = 5,
    short_items: bool = False,
    threshold: float = 1.0,
    recall: float = 0.99,
    broadcast_rows: int = 200_000,
    hot_rows: int = 50_000,
) -> DataFrame:
    """doc_id, item_id, n_windows, share: documents that contain a window of the item, and the share of its windows."""
    bands, rows = signature(threshold, recall)
    mine = items.select(items[item_id].cast("bigint"), items[passage].cast("string"))
    windows = written(mine.mapInArrow(_queries(run, shingle, short_items, bands, rows), WINDOW).distinct(), "item-windows", n=F.lit(1))
    index = written(windows.select("size", "band", "code", F.col("words").alias("window")).distinct(), "item-index", n=F.lit(1))
    sizes = sorted(r["size"] for r in index.select("size").distinct().collect())  # at most run - shingle + 1
    bitmap = _bitmap(index, counts_of(index)["n"])
    own = documents.select(documents[doc_id].cast("bigint"), documents[text].cast("string"))
    found = written(own.mapInArrow(_search(sizes, shingle, bands, rows, bitmap, threshold < 1), WINDOW), "candidates")
    pairs = _meet(found, index, counts_of(index)["n"], ["size", "band", "code"], broadcast_rows, hot_rows)
    if threshold >= 1:
        inside = F.contains(F.concat(F.lit(" "), "words", F.lit(" ")), F.concat(F.lit(" "), "window", F.lit(" ")))
    else:
        asked = _shingled(F.col("window"), shingle)
        inside = F.size(F.array_intersect(asked, _shingled(F.col("words"), shingle))) >= threshold * F.size(asked)
    hits = written(pairs.where(inside).select(F.col("id").alias("doc_id"), "size", "window").distinct(), "hits")
    queries = windows.where("band = 0").select(F.col("id").alias("item_id"), "size", F.col("words").alias("window"))
    both = _meet(hits, queries, counts_of(windows)["n"], ["size", "window"], broadcast_rows, hot_rows)
    total = queries.groupBy("item_id").agg(F.count(F.lit(1)).alias("of"))
    found = both.groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("n_windows"))
    out = _meet(found, total, counts_of(windows)["n"], ["item_id"], broadcast_rows, hot_rows)
    return out.select("doc_id", "item_id", "n_windows", (F.col("n_windows") / F.col("of")).alias("share"))
