from pyspark.sql import functions as F

from rankweave.streaming.streams import late_groups, stream_time_bucket


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    source, sink, checkpoint = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "ts timestamp, kind string"

    def arrive(*rows):
        """One file with these rows, and a run of the stream over it."""
        listed = spark.createDataFrame(rows, "ts string, kind string")
        listed.select(F.col("ts").cast("timestamp").alias("ts"), "kind").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        query = stream_time_bucket(stream, "ts", "6 hours", [F.count("*").alias("n")], ["kind"], "1 hour", sink, checkpoint)
        query.awaitTermination()
        return query

    def closed():
        found = spark.read.parquet(sink).orderBy("bucket", "kind").collect()
        return [(r["bucket"].strftime("%d %H"), r["kind"], r["n"]) for r in found]

    # Out of order within a run is not late.
    first = arrive(("2024-01-01 10:00:00", "a"), ("2024-01-01 02:00:00", "a"), ("2024-01-01 01:00:00", "b"))
    assert closed() == [("01 00", "a", 1), ("01 00", "b", 1)]
    assert late_groups(first) == 0
    # 03:00 is behind 09:00; 08:00 is too, but its bucket is still open.
    second = arrive(("2024-01-01 03:00:00", "a"), ("2024-01-01 08:00:00", "a"), ("2024-01-01 20:00:00", "b"), (None, "a"))
    assert closed() == [("01 00", "a", 1), ("01 00", "b", 1), ("01 06", "a", 2)]
    assert late_groups(second) >= 1
