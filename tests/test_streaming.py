"""The same windows on a stream and on a table."""

from pyspark.sql import functions as F

from sparrowlake.streaming.windows import windowed


def test_stream_equals_table(spark, tmp_path):
    rows = spark.sql("SELECT TIMESTAMP '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, CAST(id * 7 AS INT), 0) AS ts, IF(id % 2 = 0, 'a', 'b') AS event_type, CAST(id AS DOUBLE) AS value FROM range(200)")
    path = str(tmp_path / "events")
    rows.repartition(3).write.parquet(path)
    stream = windowed(spark.readStream.schema(rows.schema).parquet(path), "1 hour")
    query = stream.writeStream.outputMode("complete").format("memory").queryName("windows_out").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted(map(tuple, spark.table("windows_out").collect()))
    assert got == sorted(map(tuple, windowed(rows, "1 hour").collect())) and len(got) > 40
    late = windowed(rows, "10 minutes", session=True).agg(F.sum("n")).first()[0]
    assert late == 200
