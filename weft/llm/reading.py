"""Reading level of each document by smoothed unigram language models, one mixture per level.

A level's model is a mixture of unigram models (a level may be demanding in several ways: by rare words
or by long sentences). Every word is drawn together with the length class of its sentence, so a model
has a distribution over words and one over length classes. The graded texts of a level are grouped by
sentence and word length; each group is a component, smoothed towards its level and that towards all
levels (Dirichlet priors) and weighted by its share of the level's texts. A document gets the level with the
highest posterior (equal priors); the likelihood of a level is that of its mixture, the sum over its
components. Words of one text are far from independent, so that posterior is nearly always 0 or 1;
expected_level is therefore the mean level under the posterior of a single average word. Where there is
no graded sample, fit_seeded() grades texts by a readability formula.

Bracketed interruptions, interruptions between dashes, quoted parts and the speaker's name before a
colon are not part of the speech. A sentence ends with a stop before a capital or after a whole word, with a paragraph, and
with a line unless the next line goes on: where most lines have neither capital nor stop every line is
a sentence; elsewhere a line that begins with a small letter goes on, and in text that is wrapped at
one width so does any line after a full one. Words that no level has have no likelihood, but count as length.

The sample is fitted on the driver; it may have at most `max_panel` rows (an error beyond that, never
a cut). Every document is scored over its whole text, map-side, without a shuffle.

Defined cases: a text that is null, empty or without a known word has level and posterior null. Equal
posteriors give the lower level. Sample rows without level or text are left out. The language of a
document is its lang; where that is null, the one whose unigram model gives its words the highest
likelihood, null if no model knows a word of it. Those models are fitted on per_language labelled
documents of each language. Extra columns are never read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.words import BRACKETED, WORD, blocks, pieces, word_hashes

QUOTED = re.compile("“[^”]*”|„[^“”]*[“”]|«[^»]*»|\"[^\"\n]*\"")
ASIDE = re.compile(r"[—–]\s[^—–\n]{1,80}?\s[—–]")
CUT = re.compile(r"(?<=\w)[-‐¬\u00ad][^\S\n]*\r?\n\s*(?=\w)")
SPEAKER = re.compile(r"^[^\n.!?:]{1,60}:\s", re.M)

SCORE = "id bigint, lang string, level int, posterior double, expected_level double, n_words bigint"


def speech(text: str) -> str:
    """What was spoken in a text: without interruptions, quotations and name, broken words joined."""
    out = ASIDE.sub("\n", QUOTED.sub(" ", BRACKETED.sub(" ", text)))
    return CUT.sub("", SPEAKER.sub(" ", out))


STOP = re.compile(r"[.!?]+[\"”’)]*\s+(?=[\"“„‘(]*[A-ZÄÖÜÀÉ])|(?<=[a-z]{3})(?<!etc)[.!?]+\s+(?=[a-z])")
MARKED = re.compile(r"[A-ZÄÖÜÀÉ.!?]")
CLASSES = np.array([6, 11, 17, 24, 31, 45])  # upper ends of the length classes of sentences, in words


def sentences(text: str) -> list[str]:
    """The sentences of a speech() in its own letter case."""
    lines = [x.strip() for x in text.split("\n")]
    width = max(map(len, lines))
    inner = [len(x) for x, y in zip(lines, lines[1:]) if x and y]
    wrapped = width <= 100 and len(inner) >= 4 and float(np.median(inner)) >= 0.75 * width
    full = [x for x in lines if x]
    if sum(not MARKED.search(x) for x in full) >= (0.85 if wrapped else 0.6) * len(full):
        return full
    parts: list[list[str]] = [[]]
    for x in lines:
        before = parts[-1][-1] if parts[-1] else ""
        goes_on = bool(x) and bool(before) and (x[0].islower() or (wrapped and len(before) + len(x.split(" ", 1)[0]) >= width - 1 and before[-1] not in ".!?"))
        if not goes_on:
            parts.append([])
        if x:
            parts[-1].append(x)
    return [s for p in parts if p for s in STOP.split(" ".join(p)) if s]


def length_class(n_words: np.ndarray) -> np.ndarray:
    return np.searchsorted(CLASSES, n_words, "left")


class _Graded:
    """Counts of one graded text."""

    def __init__(self, text: str) -> None:
        own = [w for w in (WORD.findall(s.lower()) for s in sentences(speech(text))) if w]
        self.words = Counter(w for s in own for w in s)
        self.classes = np.zeros(len(CLASSES) + 1)
        for s in own:
            self.classes[length_class(len(s))] += len(s)
        n = max(1, sum(self.words.values()))
        self.shape = np.array([np.log(n / max(1, len(own))), sum(len(w) * k for w, k in self.words.items()) / n / 3])


def _groups(shapes: np.ndarray, most: int) -> np.ndarray:
    """Group of each text: centres are chosen farthest first, while they are clearly apart, then settled."""
    far = lambda: np.min([np.abs(shapes - c).sum(1) for c in centres], axis=0)
    centres = [shapes.mean(0)]
    centres = [shapes[far().argmax()]]
    while len(centres) < most and far().max() > 0.25:
        centres.append(shapes[far().argmax()])
    for _ in range(10):
        own = np.argmin([np.abs(shapes - c).sum(1) for c in centres], axis=0)
        centres = [shapes[own == k].mean(0) if (own == k).any() else centres[k] for k in range(len(centres))]
    return own


class LevelModels:
    """Components of all levels: level, log P(word) in the order of the words' hashes, log P(length class)."""

    def __init__(self, texts: dict[int, list[_Graded]], prior: float, components: int) -> None:
        self.levels = np.array(sorted(texts), np.int32)
        vocabulary = sorted({w for own in texts.values() for t in own for w in t.words})
        number = {w: i for i, w in enumerate(vocabulary)}

        def count(own: list[_Graded]) -> tuple[np.ndarray, np.ndarray]:
            words = np.zeros(len(vocabulary))
            for t in own:
                for w, k in t.words.items():
                    words[number[w]] += k
            return words, sum((t.classes for t in own), np.zeros(len(CLASSES) + 1))

        def smoothed(x: np.ndarray, towards: np.ndarray, mass: float) -> np.ndarray:
            return (x + mass * towards) / (x.sum() + mass)

        every = count([t for own in texts.values() for t in own])
        share = smoothed(every[0], np.full(len(vocabulary), 1 / max(1, len(vocabulary))), 1.0)
        spread = np.full(len(CLASSES) + 1, 1 / (len(CLASSES) + 1))
        rows, weight = [], []
        for number_of, level in enumerate(self.levels):
            own = texts[int(level)]
            words, classes = count(own)
            level_words, level_classes = smoothed(words, share, prior), smoothed(classes, spread, prior)
            group = _groups(np.array([t.shape for t in own]), components)
            for k in np.unique(group):
                part = count([t for t, g in zip(own, group) if g == k])
                weight.append(np.log((group == k).mean()))
                rows.append((number_of, np.log(smoothed(part[0], level_words, prior)), np.log(smoothed(part[1], level_classes, prior))))
        h = word_hashes(vocabulary)
        order = np.argsort(h)
        self.hash, self.level_of, self.log_weight = h[order], np.array([r[0] for r in rows]), np.array(weight)
        self.log_p, self.log_class = np.array([r[1][order] for r in rows]).T.copy(), np.array([r[2] for r in rows]).T.copy()

    def likelihood(self, total: np.ndarray) -> np.ndarray:
        """Log likelihoods of the levels from those of the components: a level is the mixture of its components."""
        out = np.empty((len(total), len(self.levels)))
        for level in range(len(self.levels)):
            own = (total + self.log_weight)[:, self.level_of == level]
            top = own.max(1, keepdims=True)
            out[:, level] = (top + np.log(np.exp(own - top).sum(1, keepdims=True)))[:, 0]
        return out


def _posterior(likelihood: np.ndarray) -> np.ndarray:
    post = np.exp(likelihood - likelihood.max(1, keepdims=True))
    return post / post.sum(1, keepdims=True)


class LanguageModels:
    """Unigram models of languages: log P(word) in the order of the words' hashes, and that of any other word."""

    def __init__(self, counts: dict[str, dict[str, int]], unseen: float = 0.05) -> None:
        self.languages = sorted(counts)
        vocabulary = sorted({w for own in counts.values() for w in own})
        n = np.array([[counts[x].get(w, 0) for x in self.languages] for w in vocabulary], float).reshape(len(vocabulary), len(self.languages))
        other = unseen / (len(vocabulary) + 1)  # one for all languages, however large their samples
        h = word_hashes(vocabulary)
        order = np.argsort(h)
        self.hash, self.log_p, self.log_other = h[order], np.log((1 - unseen) * n[order] / np.maximum(n.sum(0), 1) + other), np.log(other)

    def best(self, hashes: np.ndarray, owner: np.ndarray, n: int) -> list[str | None]:
        """The language of each of n documents, from their words' hashes and owners."""
        total, known = np.zeros((n, len(self.languages))), np.zeros(n, np.int64)
        if len(hashes) and len(self.hash):
            at = np.minimum(np.searchsorted(self.hash, hashes), len(self.hash) - 1)
            seen = self.hash[at] == hashes
            np.add.at(total, owner, np.where(seen[:, None], self.log_p[at], self.log_other))
            np.add.at(known, owner, seen)
        return [self.languages[b] if k else None for b, k in zip(total.argmax(1).tolist(), known.tolist(), strict=True)] if self.languages else [None] * n


def fit_languages(
    documents: DataFrame, doc_id: str, text: str, lang: str, per_language: int = 300, max_languages: int = 100, max_words: int = 20_000
) -> LanguageModels:
    """Models of the languages of `lang`, from the per_language labelled documents of each with the smallest hash of the id.

    At most max_languages languages (an error beyond that) and the max_words most frequent words of each sample.
    """
    rows = documents.select(documents[doc_id].cast("bigint").alias("id"), documents[text].cast("string").alias("text"), documents[lang].cast("string").alias("lang"))
    labelled = rows.where("lang is not null and id is not null")
    chosen = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")) <= per_language
    ids = labelled.select("id", "lang").withColumn("chosen", chosen).where("chosen").drop("chosen").distinct()
    sample = labelled.join(F.broadcast(ids.limit(per_language * max_languages + 1)), ["id", "lang"])
    words = sample.select("lang", F.explode(F.split(F.lower("text"), "[^a-z0-9]+")).alias("word")).where("word <> ''")
    counts = words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    out: dict[str, dict[str, int]] = {}
    for r in counts.withColumn("place", place).where(F.col("place") <= max_words).limit(max_words * max_languages + 1).collect():
        out.setdefault(r.lang, {})[r.word] = r.n
    if len(out) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    return LanguageModels(out)


def fit(panel: DataFrame, level: str, text: str, prior: float = 50.0, components: int = 3, max_panel: int = 20_000) -> LevelModels:
    """Models from graded texts, at most max_panel of them."""
    rows = panel.select(panel[level].cast("int").alias("level"), panel[text].cast("string").alias("text")).where("level is not null and text is not null")
    rows = rows.limit(max_panel + 1).collect()
    if len(rows) > max_panel:
        raise ValueError(f"the graded sample has more than {max_panel} rows")
    return _fitted([(r.level, r.text) for r in rows], prior, components)


def _fitted(rows: list[tuple[int, str]], prior: float, components: int) -> LevelModels:
    texts: dict[int, list[_Graded]] = {}
    for level, text in sorted(rows):
        texts.setdefault(level, []).append(_Graded(text))
    if not texts:
        raise ValueError("there is no graded text")
    return LevelModels(texts, prior, components)


def formula_level(text: str, borders: tuple[float, ...] = (4.2, 4.7, 5.2, 6.5)) -> int | None:
    """A level from the mean word length and words a sentence, for seeding models without a graded sample."""
    own = sentences(speech(text))
    words = WORD.findall(" ".join(own).lower())
    if not words:
        return None
    score = sum(map(len, words)) / len(words) + min(len(words) / len(own), 40) / 40
    return 1 + sum(score > b for b in borders)


def fit_seeded(texts: DataFrame, text: str, max_rows: int = 2_000, prior: float = 50.0, components: int = 3) -> LevelModels:
    """Models from at most max_rows texts (those with the smallest hash) graded by formula_level."""
    rows = texts.select(texts[text].cast("string").alias("text")).where("text is not null").orderBy(F.xxhash64("text"), "text").limit(max_rows).collect()
    return _fitted([(level, r.text) for r in rows if (level := formula_level(r.text)) is not None], prior, components)


def _score(model: LevelModels, languages: LanguageModels):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = model.log_p.shape[1]
        for batch in batches:
            ids, texts, langs = (batch.column(i).to_pylist() for i in range(3))
            parts: list[str] = []
            owners: list[int] = []
            for i, text in enumerate(texts):
                if text:
                    own = [p for s in sentences(speech(text)) for p in pieces(s.lower(), 0)]
                    parts += own
                    owners += [i] * len(own)
            owner, n = np.array(owners, np.int64), len(ids)
            unlabelled = np.array([x is None for x in langs], bool)
            open_hash, open_owner = [], []
            total, words = np.zeros((n, width)), np.zeros(n, np.int64)
            for first, last, w in blocks(parts):
                if unlabelled.any():
                    mine = owner[first + w.text]
                    open_hash.append(w.hash[unlabelled[mine]])
                    open_owner.append(mine[unlabelled[mine]])
                at = np.minimum(np.searchsorted(model.hash, w.hash), len(model.hash) - 1)
                known = model.hash[at] == w.hash
                if not known.any():
                    continue
                length = np.bincount(w.text, minlength=last - first)
                part = w.text[known]
                edge = np.flatnonzero(np.diff(part, prepend=-1))
                size, here = np.diff(np.append(edge, len(part))), part[edge]
                score = np.add.reduceat(model.log_p[at[known]], edge, axis=0) + size[:, None] * model.log_class[length_class(length[here])]
                np.add.at(total, owner[first + here], score)
                np.add.at(words, owner[first + here], size)
            if open_hash:
                own = languages.best(np.concatenate(open_hash), np.concatenate(open_owner), n)
                langs = [own[i] if x is None else x for i, x in enumerate(langs)]
            none = words == 0
            likelihood = model.likelihood(total)
            post, word = _posterior(likelihood), _posterior(likelihood / np.maximum(words, 1)[:, None])
            best = likelihood.argmax(1)
            yield pa.record_batch(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(langs, pa.string()),
                    pa.array(model.levels[best], pa.int32(), mask=none),
                    pa.array(post[np.arange(n), best], pa.float64(), mask=none),
                    pa.array(word @ model.levels, pa.float64(), mask=none),
                    pa.array(words),
                ],
                names=["id", "lang", "level", "posterior", "expected_level", "n_words"],
            )

    return run


def reading_levels(documents: DataFrame, model: LevelModels, doc_id: str, text: str, lang: str, languages: LanguageModels | None = None) -> DataFrame:
    """SCORE of every document: the level with the highest posterior, that posterior, and the mean level.

    languages tell the language of documents without one; if not given they are fitted on the labelled documents.
    """
    languages = languages or fit_languages(documents, doc_id, text, lang)
    rows = documents.select(documents[doc_id].cast("bigint"), documents[text].cast("string"), documents[lang].cast("string"))
    return rows.mapInArrow(_score(model, languages), SCORE)
