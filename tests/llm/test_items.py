from weft.llm.queries import p8_items


def test_short_items_are_reported(spark, tmp_path):
    spark.createDataFrame([(7, "zero one two three four five six seven")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "one two three four five six"), (2, "a b c")], "item_id bigint, passage string").write.parquet(f"{tmp_path}/eval_items.parquet")
    assert [tuple(r) for r in p8_items(spark, str(tmp_path)).collect()] == [(1, 1, 1, 1.0)]
