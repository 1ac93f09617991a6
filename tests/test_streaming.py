from weft.streaming.intervals import gap_changes


def test_late_spans_close_gaps(spark, tmp_path):
    batches = [[("a", 0, 10), ("a", 20, 30), ("b", 5, 6)], [("a", 8, 22)], [("b", 100, 101)]]
    source = str(tmp_path / "in")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "entity string, s bigint, e bigint").coalesce(1).write.mode("append").parquet(f"{source}/part={i}")
    stream = spark.readStream.schema("entity string, s bigint, e bigint, part int").option("maxFilesPerTrigger", 1).parquet(source)
    seen = []
    q = (
        gap_changes(stream.select("entity", "s", "e"))
        .writeStream.outputMode("update")
        .option("checkpointLocation", str(tmp_path / "ck"))
        .foreachBatch(lambda df, _: seen.extend(map(tuple, df.collect())))
        .start()
    )
    q.processAllAvailable()
    q.stop()
    assert sorted(seen) == [("a", 10, 20, "closed"), ("a", 10, 20, "open"), ("b", 6, 100, "open")]
