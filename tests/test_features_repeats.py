from datetime import datetime, timedelta

from pyspark.sql import functions as F

from weft.operators.features import event_features

T0 = datetime(2020, 1, 1)


def test_repeated_id_with_two_starts_counts_once_in_a_salted_entity(spark):
    rows = [("hot", i, T0 + timedelta(minutes=i + d), T0 + timedelta(minutes=i + d + 1 + d)) for i in range(100) for d in (0, 3)]
    rows += [("hot", i, None, T0) for i in range(100)] + [("hot", None, T0, T0), ("hot", None, T0, T0)]
    df = spark.createDataFrame(rows, "who string, id bigint, s timestamp_ntz, e timestamp_ntz").repartition(5)
    for options in ({}, {"salt_rows": 20}):
        got = event_features(df, F.col("who"), F.lit("ok"), "id", "s", "e", **options).collect()
        assert [tuple(r) for r in got] == [("hot", 102, T0 + timedelta(minutes=102), 100 * 4 * 60.0)]
