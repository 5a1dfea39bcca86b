"""The streaming extension: a stream over files gives what the batch gives."""

from graphloom.streaming.windows import event_windows


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(500).selectExpr("timestamp_seconds(id * 37) as ts", "concat('t', id % 3) as event_type", "cast(id as double) as value")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = event_windows(stream).writeStream.outputMode("complete").format("memory").queryName("win").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted(map(tuple, spark.table("win").collect()))
    assert got == sorted(map(tuple, event_windows(rows).collect())) and len(got) > 50
