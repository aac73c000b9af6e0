from panelwright.streaming.lags import stream_lag


def test_lags_across_batches(spark, tmp_path):
    cols = "firm string, fiscal_year long, x double"
    for i, rows in enumerate([[("A", 2020, 1.0), ("A", 2021, 2.0), ("B", 2020, 5.0)], [("A", 2022, 3.0), ("B", 2022, 6.0)]]):
        spark.createDataFrame(rows, cols).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in/b{i}")
    stream = spark.readStream.schema(cols).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in/*")
    q = stream_lag(stream, "x").writeStream.format("memory").queryName("lags").option("checkpointLocation", f"file://{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    got = {(r["firm"], r["fiscal_year"]): r["lagged"] for r in spark.table("lags").collect()}
    assert got == {("A", 2020): None, ("A", 2021): 1.0, ("A", 2022): 2.0, ("B", 2020): None, ("B", 2022): None}
