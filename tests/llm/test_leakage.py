import random
import re

from weft.llm.leakage import leaks
from weft.llm.words import spoken


def brute(docs, items, run):
    out = {}
    for d, text in docs:
        words = re.findall("[a-z0-9]+", spoken(text or ""))
        have = {tuple(words[i : i + run]) for i in range(len(words) - run + 1)}
        for k, passage in items:
            own = re.findall("[a-z0-9]+", spoken(passage or ""))
            windows = {tuple(own[i : i + run]) for i in range(len(own) - run + 1)}
            if d is not None and windows & have:
                out[d, k] = (len(windows & have), len(windows & have) / len(windows))
    return out


def frames(spark, docs, items):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id bigint, text string, passage string, item_id int")
    return d, spark.createDataFrame([(i, t, "y", 0.5) for i, t in items], "item_id bigint, passage string, text string, size double")


def run(spark, docs, items, **options):
    d, i = frames(spark, docs, items)
    return {(r.doc_id, r.item_id): (r.n_windows, r.share) for r in leaks(d, i, "doc_id", "text", "item_id", "passage", **options).collect()}


def test_agrees_with_brute_force(spark):
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    formula = text(14)
    items = [(i, f"{text(20)} {formula if i % 3 == 0 else ''} {text(20)}") for i in range(12)] + [(50, text(5)), (51, None), (52, "")]
    docs = []
    for d in range(80):
        cut = items[rnd.randint(0, 11)][1].split()
        at, n = rnd.randint(0, 20), rnd.choice([8, 11, 12, 13, 30])
        part = cut[at : at + n]
        if d % 4 == 0:
            part.insert(len(part) // 2, "[Bell (x)]")
        docs.append((d, f"{text(rnd.randint(0, 90))} {' '.join(part).upper()} {text(rnd.randint(0, 90))}"))
    docs += [(100, None), (101, ""), (102, formula * 50), (103, formula), (None, formula), (104, " ".join(t for _, t in items if t))]
    want = brute(docs, items, 12)
    assert want and run(spark, docs, items) == want
    assert run(spark, docs, items, broadcast_rows=0, hot_rows=20) == want


def test_recall_by_size_below_full_containment(spark):
    """At a threshold of 0.8 the found windows are among those of brute force, and at least 0.9 of them in every partition."""
    rnd = random.Random(5)
    text = lambda n: " ".join(f"w{rnd.randint(0, 400)}" for _ in range(n))
    items = [(i, text(rnd.choice([9, 10, 11, 12, 12, 30]))) for i in range(150)]
    docs = []
    for d, (_, passage) in enumerate(items):
        words = passage.split()
        words[rnd.choice([0, 0, -1, -1, 3])] = "other"  # a word at an end, or one inside
        docs.append((d, f"{text(40)} {' '.join(words)} {text(40)}"))
    shingled = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    want = set()
    for k, passage in items:
        own, q = passage.split(), min(12, len(passage.split()))
        for d, t in docs:
            w = t.split()
            if d == k and any(len(a & shingled(w[j : j + q])) >= 0.8 * len(a) for i in range(len(own) - q + 1) for a in [shingled(own[i : i + q])] for j in range(len(w) - q + 1)):
                want.add((d, k))
    found = set(run(spark, docs, items, short_items=True, threshold=0.8))
    size = {k: min(12, len(p.split())) for k, p in items}
    assert {(d, k) for d, k in found if d == k} <= want
    for q in (10, 11, 12):
        mine = {x for x in want if size[x[1]] == q}
        assert mine and len(mine & found) >= 0.9 * len(mine)


def test_short_items_have_their_own_partitions(spark):
    items = [(1, "one two three four five six"), (2, "a b c")]
    docs = [(7, "zero one two three four five six seven"), (8, "one two three four five")]
    assert run(spark, docs, items) == {}
    assert run(spark, docs, items, short_items=True) == {(7, 1): (1, 1.0)}


def test_empty(spark):
    assert run(spark, [], [(1, "a " * 20)]) == {} and run(spark, [(1, "a " * 20)], []) == {}
