from pyspark.sql import functions as F

from weft.functions import keys, scalars


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("c"))).collect()]


def test_keys(spark):
    values = ["P12", " p0012 ", "p0", "p000", "", " \t ", None, "UNKNOWN", "007", "p10", "P?"]
    assert column(spark, values, keys.canonical_key) == ["p12", "p12", "p0", "p0", None, None, None, "unknown", "7", "p10", "p?"]
    assert column(spark, [" 007 ", "x", "", None, "-3"], keys.whole_number) == [7, None, None, None, -3]
    assert column(spark, [" 5,500 ", "6 000.5", "007", "n/a", "", None, "NaN", "Infinity", "1d", "1e3", "-2", "."], keys.decimal_text) == [5500, 6000.5, 7, None, None, None, None, None, None, 1000, -2, None]
    assert column(spark, [" Ab ", "  ", None], keys.label) == ["ab", None, None]


def test_scalars(spark):
    assert column(spark, ["", " 2.5 ", "x", None], scalars.number) == [0, 2.5, None, None]
    assert column(spark, ["", " 2.5 ", "x", None], scalars.number_or_null) == [None, 2.5, None, None]
    assert column(spark, [7, 12345, None], lambda c: scalars.pad_start(c, 3, "0"), "int") == ["007", "12345", None]
    assert column(spark, [7, None], lambda c: scalars.text("v=", c), "int") == ["v=7", "v=null"]
    assert column(spark, ["a|b", "a", None], lambda c: scalars.piece(c, "|", 1)) == ["b", None, None]
    assert column(spark, ["x"], lambda c: scalars.now_ms())[0] > 1.6e12


def test_session_settings(spark):
    from weft.session import SETTINGS, session

    assert session(spark__sql__caseSensitive="false") is not None and "spark.sql.adaptive.enabled" in SETTINGS
    spark.conf.set("spark.sql.caseSensitive", "false")
