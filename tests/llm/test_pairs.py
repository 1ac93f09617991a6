from weft.llm.queries import p7_pairs


def test_rare_pairs_are_reported(spark, tmp_path):
    rows = [(1, "b1|b2"), (2, "b1|b2|b3"), (3, "b4")]
    spark.createDataFrame(rows, "basket_id bigint, books string").write.parquet(f"{tmp_path}/explode_test.parquet")
    got = p7_pairs(spark, str(tmp_path)).select("item_a", "item_b", "n_ab", "n_a", "n_b", "lift").collect()
    assert sorted(map(tuple, got)) == [(1, 2, 2, 2, 2, 1.5), (1, 3, 1, 2, 1, 1.5), (2, 3, 1, 2, 1, 1.5)]
