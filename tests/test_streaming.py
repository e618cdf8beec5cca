"""A stream gives the same sums as the table it is made of."""

from netscale.streaming.series import windowed_series


def test_stream_equals_table(spark, tmp_path):
    rows = [(i, f"2024-01-01 {i % 5:02d}:{i % 60:02d}:00", "ab"[i % 2], float(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, ts string, kind string, value double").selectExpr("id", "cast(ts as timestamp) as ts", "kind", "value")
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = windowed_series(stream, "kind").writeStream.outputMode("complete").format("memory").queryName("sums").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    got = {tuple(r) for r in spark.table("sums").collect()}
    assert got == {tuple(r) for r in windowed_series(df, "kind").collect()} and len(got) == 10
