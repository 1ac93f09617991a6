import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import tiktoken  # noqa: F401
from hypothesis import given, settings
from hypothesis import strategies as st

from weft.llm.mixing import NAMES, _encoding, _round, default_tokenizer, mix, pivotal, plan, token_counter, vocabulary, with_tokens

TARGETS = "source string, target_share double, max_repeats int, text string"
DOCS = "doc_id bigint, source string, text string, tokens string, copies int"


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_tokens_are_those_of_the_tokenizer(text):
    data, pattern = vocabulary(default_tokenizer()[0]), default_tokenizer()[1]
    assert token_counter(data, pattern)(text) == len(_encoding(data, pattern).encode_ordinary(text))


def test_long_texts_and_pieces():
    data, pattern = vocabulary(default_tokenizer()[0]), default_tokenizer()[1]
    text = "some words, 12 of them. " * 50_000 + "a" * 5_000
    assert token_counter(data, pattern)(text) == len(_encoding(data, pattern).encode_ordinary(text))
    with pytest.raises(ValueError):
        vocabulary(default_tokenizer()[0], most=10)


def test_plan():
    p = plan({"a": 100, "b": 1000, "c": 5}, {"a": (0.5, 2), "b": (0.3, 4), "gone": (0.2, 1)})
    assert p["a"]["copies"] == 2.0 and abs(p["b"]["copies"] - 0.12) < 1e-9
    assert p["c"]["copies"] == p["gone"]["copies"] == 0 and abs(p["a"]["effective_share"] - 0.625) < 1e-9
    assert plan({}, {}) == {} and plan({"a": 0}, {"a": (1.0, 1)})["a"]["copies"] == 0


@pytest.mark.parametrize("seed", range(4))
def test_pivotal_keeps_tokens_and_leaves_one_per_source(seed):
    rng = np.random.default_rng(seed)
    source, tokens, f = np.repeat([0, 1, 2], [500, 1, 37]), rng.integers(1, 90, 538).astype(float), rng.random(538)
    out = pivotal(f, tokens, source, rng.random)
    open_ = (out > 0) & (out < 1)
    for s in range(3):
        assert open_[source == s].sum() <= 1 and abs(((out - f) * tokens)[source == s].sum()) < 1e-4
    assert len(pivotal(f[:0], tokens[:0], source[:0], rng.random)) == 0
    rate = np.mean([pivotal(np.full(3, 0.3), np.array([1.0, 5.0, 9.0]), np.zeros(3), rng.random) for _ in range(4000)], axis=0)
    assert np.abs(rate - 0.3).max() < 0.03


def test_a_bucket_over_many_batches():
    """Batches as Spark sends them, with fields that are not nullable."""
    rng, n = np.random.default_rng(1), 400
    rows = [(i, "ab"[i % 300 > 200], int(rng.integers(1, 50)), 0, None, float(rng.random()), i // 300) for i in range(n)]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int64()]
    schema = pa.schema([pa.field(c, t, c == "copies") for c, t in zip(NAMES, types)])
    batches = [pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows[i : i + 37]), types)], schema=schema) for i in range(0, n, 37)]
    out = [r for b in _round(5, 0)(iter(batches)) for r in b.to_pylist()]
    assert sorted(r["id"] for r in out) == list(range(n))
    for bucket in (0, 1):
        for source in "ab":
            mine, was = [r for r in out if (r["bucket"], r["source"]) == (bucket, source)], [r for r in rows if (r[6], r[1]) == (bucket, source)]
            assert sum(r["copies"] is None for r in mine) <= 1
            kept = sum(r["tokens"] * (r["fraction"] if r["copies"] is None else r["copies"]) for r in mine)
            assert abs(kept - sum(r[2] * r[5] for r in was)) < 1e-4
    again = [r for b in _round(5, 0)(iter(batches)) for r in b.to_pylist()]
    assert again == out


def make(spark, n=1500):
    rnd = random.Random(9)
    docs = [(i, "big" if i % 3 else rnd.choice(["small", "mid", "other", None]), rnd.choice([None, "", *["word " * rnd.randint(1, 90)] * 9]), "x", 1) for i in range(n)]
    targets = [("big", 0.3, 1, "t"), ("small", 0.4, 3, "t"), ("mid", 0.2, 2, "t"), ("absent", 0.1, 5, "t")]
    return spark.createDataFrame(docs, DOCS).repartition(4), spark.createDataFrame(targets, TARGETS), docs


def test_shares_and_caps(spark):
    docs, targets, rows = make(spark)
    for options in ({"bucket_rows": 40, "fan_in": 3}, {}):
        draw, report = mix(docs, targets, "doc_id", "source", "text", seed=3, **options)
        drawn = draw.collect()
        assert len({r.doc_id for r in drawn}) == len(drawn)
        caps, largest = {"big": 1, "small": 3, "mid": 2}, 92
        facts = {r.source: r for r in report.collect()}
        assert set(facts) == {"big", "small", "mid", "other", "absent"}
        total = sum(r.tokens * r.copies for r in drawn)
        for s, cap in caps.items():
            own = [r for r in drawn if r.source == s]
            assert max(r.copies for r in own) <= cap
            used = sum(r.tokens * r.copies for r in own)
            want = facts[s].expected_copies * facts[s].source_tokens
            assert abs(used - want) <= largest
            assert abs(facts[s].actual_share - used / total) < 1e-12
            low = int(facts[s].expected_copies + 1e-9)
            assert {r.copies for r in own} <= {low, low + 1}
        assert facts["other"].drawn_tokens == facts["absent"].drawn_tokens == 0
        assert facts["small"].most_copies == 3  # the source that binds is used up
    again = mix(docs, targets, "doc_id", "source", "text", seed=3)[0].collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, drawn))


def test_expected_copies_over_seeds(spark):
    docs = spark.createDataFrame([(i, "a", "w " * (1 + i % 5), "", 0) for i in range(12)] + [(100 + i, "b", "w " * 3, "", 0) for i in range(3)], DOCS)
    targets = spark.createDataFrame([("a", 0.5, 1, ""), ("b", 0.5, 1, "")], TARGETS)
    seen, n = Counter(), 60
    for seed in range(n):
        seen.update(r.doc_id for r in mix(docs, targets, "doc_id", "source", "text", seed=seed, bucket_rows=4, fan_in=2)[0].where("source = 'a'").collect())
    rate = mix(docs, targets, "doc_id", "source", "text")[1].where("source = 'a'").first().expected_copies
    assert all(abs(seen[i] / n - rate) < 0.3 for i in range(12)) and abs(sum(seen.values()) / n / 12 - rate) < 0.1


def test_empty(spark):
    docs, targets, _ = make(spark, 10)
    draw, report = mix(docs.limit(0), targets, "doc_id", "source", "text")
    assert draw.collect() == [] and report.count() == 4
    assert with_tokens(docs.limit(0), "doc_id", "source", "text").collect() == []
