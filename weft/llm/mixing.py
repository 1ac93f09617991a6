"""A mixture of sources with given shares of the total size in tokens.

The largest total is drawn at which every share holds and no document is needed more than its source's
max_repeats times. Each document of a source then has the same expected number of copies x; floor(x)
are certain, and the fractions are rounded by the pivotal method: two documents at a time exchange
mass, weighted by their tokens so that the tokens of the pair stay the same, until one of the two is
integral; which way is drawn at random with the odds that keep both expectations. Documents are dealt
to buckets of about bucket_rows by a hash of their id. In a bucket all pairs of neighbours of one source
meet at once, then the half that is still fractional, until a source has one such document at most. These
residuals meet again in a reduction tree, `fan_in` buckets at a time, and the last one of a source is drawn
by its fraction. So a source misses its tokens by less than one document.

The vocabulary is read where the job starts and travels with the task, so that executors need no such file.

All draws come from a hash of seed, level and bucket, so a task that runs again draws the same.

Defined cases: documents without text, tokens or source are never drawn. A source without target is
not drawn (target 0 in the report); a target without documents cannot be met and the other shares are
scaled up to sum to 1 (effective_share), both are in the report. Null or negative targets and repeats
count as 0. Repeated ids are documents of their own. An empty table gives an empty draw.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.plans.stage import written


def vocabulary(path: str, most: int = 1 << 26) -> bytes:
    """The vocabulary file, of at most `most` bytes (an error beyond that)."""
    with open(path, "rb") as f:
        data = f.read(most + 1)
    if len(data) > most:
        raise ValueError(f"the vocabulary has more than {most} bytes")
    return data


@lru_cache(maxsize=2)
def _encoding(data: bytes, pattern: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class _Lengths(dict):
    """Tokens of each piece of text; forgets everything when it is full."""

    def __init__(self, encode, most: int = 500_000) -> None:
        super().__init__()
        self.encode, self.most = encode, most

    def __missing__(self, piece: str) -> int:
        n = len(self.encode(piece))
        if len(piece) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[piece] = n
        return n


def token_counter(data: bytes, pattern: str):
    """text -> number of tokens. Merges never cross the pieces of `pattern`, so pieces are counted one by one and remembered."""
    lengths, pieces = _Lengths(_encoding(data, pattern).encode_ordinary), regex.compile(pattern)

    def count(text: str) -> int:
        if len(text) > 1_000_000:  # no list of all pieces
            return sum(lengths[m.group()] for m in pieces.finditer(text))
        return sum(map(lengths.__getitem__, pieces.findall(text)))

    return count


def default_tokenizer() -> tuple[str, str]:
    """Path and pattern of the public byte-level vocabulary."""
    import public_tokenizers as P

    return P.path("byte_bpe_50k.tiktoken"), P.PATTERN


def with_tokens(documents: DataFrame, doc_id: str, source: str, text: str, tokenizer: tuple[str, str] | None = None) -> DataFrame:
    """id, source, tokens of every document with text, without a shuffle."""
    path, pattern = tokenizer or default_tokenizer()
    data = vocabulary(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = token_counter(data, pattern)
        for b in batches:
            tokens = [count(t) for t in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(tokens, pa.int64())], names=["id", "source", "tokens"])

    rows = documents.select(documents[doc_id].cast("bigint").alias("id"), documents[source].cast("string").alias("source"), documents[text].cast("string").alias("text"))
    rows = rows.where("text is not null and text <> '' and source is not null and id is not null")
    return rows.mapInArrow(run, "id bigint, source string, tokens bigint")


def plan(sizes: dict[str, int], targets: dict[str, tuple[float, int]]) -> dict[str, dict]:
    """Per source: tokens, target_share, max_repeats, effective_share and the expected copies of a document."""
    able = {s: t for s, t in targets.items() if t[0] > 0 and t[1] > 0 and sizes.get(s, 0) > 0}
    met = sum(t[0] for t in able.values())
    total = min((cap * sizes[s] / (share / met) for s, (share, cap) in able.items()), default=0.0)
    out = {}
    for s in sorted({*sizes, *targets}):
        share, cap = targets.get(s, (0.0, 0))
        effective = share / met if s in able else 0.0
        out[s] = {"tokens": sizes.get(s, 0), "target_share": share, "max_repeats": cap, "effective_share": effective, "copies": min(float(cap), effective * total / sizes[s]) if s in able else 0.0}
    return out


EPS = 1e-9


def pivotal(fraction: np.ndarray, tokens: np.ndarray, source: np.ndarray, draw) -> np.ndarray:
    """Fractions rounded to 0 or 1 but for one document per source; rows of a source are neighbours.

    draw(n) gives n random numbers. All pairs of neighbours exchange mass at once; who stays fractional goes on.
    """
    f = np.where(fraction <= EPS, 0.0, np.where(fraction >= 1 - EPS, 1.0, fraction))
    while True:
        alive = np.flatnonzero((f > 0) & (f < 1))
        own = source[alive]
        start = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(own) else np.zeros(0, np.int64)
        place = np.arange(len(own)) - np.repeat(start, np.diff(np.append(start, len(own))))
        second = np.flatnonzero(place % 2 == 1)
        if not len(second):
            return f
        a, b = alive[second - 1], alive[second]
        ta, tb, fa, fb = tokens[a], tokens[b], f[a], f[b]
        up, down = np.minimum((1 - fa) * ta, fb * tb), np.minimum(fa * ta, (1 - fb) * tb)  # mass in tokens, to a and from a
        move = np.where(draw(len(a)) * (up + down) < down, up, -down)
        for at, value in ((a, fa + move / ta), (b, fb - move / tb)):
            f[at] = np.where(value <= EPS, 0.0, np.where(value >= 1 - EPS, 1.0, value))


DRAWN = "id bigint, source string, tokens bigint, sure int, copies int, fraction double, bucket bigint"


NAMES = [x.split()[0] for x in DRAWN.split(", ")]


def _round(seed: int, level: int):
    """Rows of DRAWN sorted by bucket and source; fractions are rounded within each bucket."""

    def settled(part: pa.Table, f: np.ndarray) -> pa.Table:
        copies = part.column("sure").to_numpy() + (f > 0.5)
        open_ = (f > 0) & (f < 1)
        part = part.set_column(4, "copies", pa.array(copies.astype(np.int32), mask=open_))
        return part.set_column(5, "fraction", pa.array(f, mask=~open_))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, draw, left = None, None, None  # left: the bucket's documents that are still fractional
        for b in batches:
            bucket = b.column(6).to_numpy()
            edges = np.flatnonzero(np.diff(bucket, prepend=bucket[:1] - 1))
            for first, last in zip(edges.tolist(), [*edges[1:].tolist(), len(bucket)], strict=True):
                part = pa.Table.from_arrays(b.slice(first, last - first).columns, names=NAMES)
                if bucket[first] != at:
                    if left is not None:
                        yield from left.to_batches()
                    at, left = int(bucket[first]), None
                    draw = np.random.default_rng([x & 0xFFFFFFFF for x in (seed, level, at)]).random
                elif left is not None:
                    part = pa.concat_tables([left, part]).sort_by("source")
                source = part.column("source").combine_chunks().dictionary_encode()
                source = source.combine_chunks() if isinstance(source, pa.ChunkedArray) else source
                f = pivotal(part.column("fraction").to_numpy(), part.column("tokens").to_numpy().astype(float), source.indices.to_numpy(), draw)
                part = settled(part, f)
                open_ = pa.array((f > 0) & (f < 1))
                left = part.filter(open_)
                for x in part.filter(pc.invert(open_)).combine_chunks().to_batches():
                    yield x
        if left is not None:
            yield from left.combine_chunks().to_batches()

    return run


def mix(
    documents: DataFrame,
    targets: DataFrame,
    doc_id: str,
    source: str,
    text: str,
    seed: int = 0,
    tokenizer: tuple[str, str] | None = None,
    bucket_rows: int = 10_000,
    fan_in: int = 16,
    max_sources: int = 100_000,
) -> tuple[DataFrame, DataFrame]:
    """(draw, report). draw: doc_id, source, tokens, copies >= 1. report: one row per source.

    targets has source, target_share and max_repeats (at most max_sources rows, an error beyond that).
    """
    spark = documents.sparkSession
    sized = written(with_tokens(documents, doc_id, source, text, tokenizer), "tokens")
    want = targets.groupBy("source").agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("cap")).where("source is not null").limit(max_sources + 1).collect()
    have = sized.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n"), F.max("tokens").alias("largest")).limit(max_sources + 1).collect()
    if max(len(want), len(have)) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    sources = plan({r.source: r.tokens for r in have}, {r.source: (max(r.share or 0.0, 0.0), max(r.cap or 0, 0)) for r in want})
    rates = spark.createDataFrame([(s, float(p["copies"])) for s, p in sources.items() if p["copies"] > 0], "source string, x double")
    n_buckets = max(1, sum(r.n for r in have) // bucket_rows)
    rows = sized.where("tokens > 0").join(F.broadcast(rates), "source")
    sure = F.floor(F.col("x") + 1e-9).cast("int")
    level = rows.select(
        "id", "source", "tokens", sure.alias("sure"), F.lit(None).cast("int").alias("copies"), F.greatest(F.col("x") - sure, F.lit(0.0)).alias("fraction"),
        F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n_buckets)).alias("bucket"),
    )
    settled, turn = [], 0
    while True:
        ready = level.repartition("bucket").sortWithinPartitions("bucket", "source", F.xxhash64("id", F.lit(seed), F.lit(turn)), "id", "tokens")
        out = written(ready.mapInArrow(_round(seed, turn), DRAWN), "draw")
        settled.append(out.where("copies is not null"))
        rest = out.where("copies is null")
        if n_buckets == 1:
            last = F.when(F.pmod(F.xxhash64("id", F.lit(seed), F.lit("last")), F.lit(1_000_003)) / 1_000_003 < F.col("fraction"), 1).otherwise(0)
            settled.append(rest.withColumn("copies", F.col("sure") + last))
            break
        n_buckets, turn = -(-n_buckets // fan_in), turn + 1
        level = rest.withColumn("bucket", F.floor(F.col("bucket") / fan_in))
    drawn = settled[0]
    for s in settled[1:]:
        drawn = drawn.unionByName(s)
    drawn = drawn.where("copies > 0").select(F.col("id").alias(doc_id), "source", "tokens", "copies")
    largest = {r.source: r.largest for r in have}
    facts = spark.createDataFrame(
        [
            (s, p["tokens"], largest.get(s, 0), float(p["target_share"]), int(p["max_repeats"]), float(p["effective_share"]), float(p["copies"]))
            for s, p in sources.items()
        ],
        "source string, source_tokens bigint, largest_document bigint, target_share double, max_repeats int, effective_share double, expected_copies double",
    )
    used = drawn.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("drawn_tokens"), F.sum("copies").alias("drawn_copies"), F.max("copies").alias("most_copies"))
    every = facts.join(F.broadcast(used), "source", "left")  # both have a row per source
    all_tokens = F.sum("drawn_tokens").over(Window.partitionBy())
    report = every.select(
        *facts.columns,
        *(F.coalesce(c, F.lit(0)).alias(c) for c in ("drawn_tokens", "drawn_copies", "most_copies")),
        (F.coalesce("drawn_tokens", F.lit(0)) / all_tokens).alias("actual_share"),
    )
    return drawn, report
