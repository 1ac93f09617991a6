import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.llm.reading import fit, fit_languages, fit_seeded, formula_level, reading_levels, sentences, speech

EASY = "the dog is big. we see the dog and the cat. you can run. the cat is small. "
HARD = "Administrative jurisdiction exacerbates constitutionality, whereas remuneration subordinates apportionment of harmonisation. "
DOCS = "doc_id bigint, text string, lang string, level string, posterior string"


@pytest.fixture
def model(spark):
    panel = spark.createDataFrame([(1, 1, EASY), (2, 5, HARD), (3, None, "x"), (4, 3, None)], "panel_id int, level int, text string")
    return fit(panel, "level", "text")


def scores(spark, model, rows):
    df = spark.createDataFrame([(*r, "a", "b") for r in rows], DOCS)
    return {r.id: r for r in reading_levels(df, model, "doc_id", "text", "lang").collect()}


def levels(spark, model, rows):
    return {i: (r.lang, r.level) for i, r in scores(spark, model, rows).items()}


def test_the_speech_as_a_whole_decides(spark, model):
    rows = [
        (1, EASY * 3 + f"He said “{HARD}” once. " + HARD, "en"), (2, HARD * 3 + "[Deputy X: the dog is big] " + EASY[:20], "en"), (3, None, "en"), (4, "", None), (5, "zzz qqq", "en"),
        (6, "Name of Speaker: " + EASY, None), (7, "der hund und die katze", None), (10, "die katze und der hund ist da", "de"), (11, "le chat et le chien", "fr"), (12, "xyzzy", None), (13, "qqq", None), (8, HARD.lower().replace(".", "\n") * 4, "en"), (9, EASY * 5000 + HARD, "en"),
    ]
    got = levels(spark, model, rows)
    assert got == {1: ("en", 1), 2: ("en", 5), 3: ("en", None), 4: (None, None), 5: ("en", None), 6: ("en", 1), 7: ("de", None), 8: ("en", 5), 9: ("en", 1), 10: ("de", None), 11: ("fr", None), 12: (None, None), 13: ("en", None)}


def test_speech():
    assert "bell" not in speech("a [Bell] b") and "quoted" not in speech('a "quoted part" b') and "infrastructure" in speech("infra-\nstructure")
    assert "no" not in speech("we go — Lee: no! — on").split()


def test_sentences():
    assert sentences("We go. No. 4 is it! “Yes.” They stay") == ["We go", "No. 4 is it", "“Yes", "They stay"]
    assert sentences("Revised record\nwe go home now\nthey stay here\nyou see it\n") == ["Revised record", "we go home now", "they stay here", "you see it"]
    assert sentences("One ends here\nTwo goes\non here.\n\nThree") == ["One ends here", "Two goes on here.", "Three"]
    wrapped = "The first line of this text is full and\nGoes on with a name of a place that is\nwrapped where the line of the page ends\nand so on until the long sentence stops.\nHere a second sentence begins on a line\nshort."
    assert sentences(wrapped)[0].startswith("The first line of this text is full and Goes on") and len(sentences(wrapped)) == 2
    assert sentences("") == []


def test_bounds_and_seeding(spark):
    panel = spark.createDataFrame([(1, EASY)] * 3, "level int, text string")
    with pytest.raises(ValueError):
        fit(panel, "level", "text", max_panel=2)
    with pytest.raises(ValueError):
        fit(panel.limit(0), "level", "text")
    assert formula_level(EASY) < formula_level(HARD) and formula_level("") is None
    texts = spark.createDataFrame([(EASY,), (HARD,), (None,), ("",)], "text string")
    seeded = fit_seeded(texts, "text")
    got = levels(spark, seeded, [(1, EASY, "en"), (2, HARD, "en")])
    assert got[1][1] < got[2][1]


def test_held_out_accuracy(spark):
    """Models of two thirds of the graded texts grade the other third; over all three folds."""
    rows = duckdb.sql("select panel_id, level, text from '/root/testdata/sf0.001/reading_panel.parquet'").fetchall()
    got = {}
    for fold in range(3):
        panel = spark.createDataFrame([r[1:] for r in rows if r[0] // 3 % 3 != fold], "level int, text string")
        got |= scores(spark, fit(panel, "level", "text"), [(r[0], r[2], "en") for r in rows if r[0] // 3 % 3 == fold])
    wrong = [(r[1], got[r[0]].level) for r in rows if got[r[0]].level != r[1]]
    assert len(wrong) / len(rows) <= 0.15, wrong
    assert {r[0] for r in rows if r[1] == 5} == {i for i, r in got.items() if r.level == 5}


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang is not null and n_chars > 0").withColumn("even", F.col("doc_id") % 2 == 0)
    models = fit_languages(docs.where("even"), "doc_id", "text", "lang", per_language=100)
    other = docs.where("not even").select("doc_id", "text", F.col("lang").alias("was"), F.lit(None).cast("string").alias("lang"))
    panel = spark.createDataFrame([(1, EASY)], "level int, text string")
    got = reading_levels(other, fit(panel, "level", "text"), "doc_id", "text", "lang", models).join(other.select(F.col("doc_id").alias("id"), "was"), "id")
    rows = got.select("lang", "was").collect()
    assert len(rows) > 300 and sum(r.lang == r.was for r in rows) / len(rows) > 0.98
    with pytest.raises(ValueError):
        fit_languages(docs, "doc_id", "text", "lang", max_languages=2)


def test_a_level_is_the_sum_of_its_components(model):
    total = np.log(np.random.default_rng(1).random((7, len(model.level_of))))
    for level in range(len(model.levels)):
        own = model.level_of == level
        assert np.allclose(np.exp(model.likelihood(total))[:, level], (np.exp(total + model.log_weight)[:, own]).sum(1))


def test_empty(spark, model):
    assert levels(spark, model, []) == {}
