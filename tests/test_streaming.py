from datetime import datetime

from inodelake.streaming.append import log_sizes


def test_stream_equals_batch(spark, tmp_path):
    rows = [(1, datetime(2024, 1, 1, 0, m), t) for m, t in ((1, "a"), (2, "b\n"), (15, None), (16, "é"))]
    schema = "file_id long, ts timestamp, line string"
    spark.createDataFrame(rows[:2], schema).write.parquet(str(tmp_path / "in"))
    spark.createDataFrame(rows[2:], schema).write.mode("append").parquet(str(tmp_path / "in"))
    stream = log_sizes(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("sizes").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r["file_id"], r["lines"], r["bytes"]) for r in spark.table("sizes").collect())
    want = sorted((r["file_id"], r["lines"], r["bytes"]) for r in log_sizes(spark.createDataFrame(rows, schema)).collect())
    assert got == want == [(1, 2, 4), (1, 2, 4)]
