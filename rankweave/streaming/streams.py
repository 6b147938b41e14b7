"""Streams over the same operators.

The functions take a streaming DataFrame and a checkpoint path and give back the
started query. ``once`` runs over what is there and stops.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rankweave.operators.maintain import append_segment
from rankweave.operators.queue import fold
from rankweave.operators.text_index import StoredIndex
from rankweave.operators.timeseries import time_bucket


def _start(writer, once: bool) -> StreamingQuery:
    return (writer.trigger(availableNow=True) if once else writer).start()


def stream_time_bucket(
    stream: DataFrame, ts: str, width: str, aggs: list[Column], by: list[str], watermark: str,
    sink: str, checkpoint: str, once: bool = True,
) -> StreamingQuery:
    """Append each bucket to a Parquet table once the watermark has passed it."""
    buckets = time_bucket(stream, ts, width, aggs, by, watermark=watermark)
    writer = buckets.writeStream.outputMode("append").format("parquet")
    return _start(writer.option("path", sink).option("checkpointLocation", checkpoint), once)


def late_groups(query: StreamingQuery) -> int:
    """How many rows the watermark has refused in the batches that Spark still reports.

    Rows of a batch that share a key are counted once: they are added up before they
    reach the state. Spark reports the last ``spark.sql.streaming.numRecentProgressUpdates``
    batches.
    """
    return sum(state.numRowsDroppedByWatermark for batch in query.recentProgress for state in batch.stateOperators)


def stream_into_index(stream: DataFrame, spark: SparkSession, path: str, name: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Add every micro-batch to a stored text index as a segment.

    A batch is known by the stream's name and its number. A batch that is run again
    after a failure is found in the manifest and passed over.
    """

    def add(batch: DataFrame, number: int) -> None:
        append_segment(StoredIndex.open(spark, path), batch, batch=(name, number))

    writer = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return _start(writer, once)


def stream_queue_state(stream: DataFrame, sink: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Keep the fold of a queue log: every batch writes the messages it changed.

    Spark holds one state row per message. The sink has one folder per batch, written
    over if a batch is run again.
    """
    changed = fold(stream)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    writer = changed.writeStream.outputMode("update").foreachBatch(write)
    return _start(writer.option("checkpointLocation", checkpoint), once)


def read_queue_state(spark: SparkSession, sink: str) -> DataFrame:
    """The newest state of every message out of :func:`stream_queue_state`."""
    rows = spark.read.option("basePath", sink).parquet(sink)
    columns = [c for c in rows.columns if c != "batch"]
    newest = rows.groupBy("queue", "msg_id").agg(F.max_by(F.struct(*columns), F.col("batch")).alias("__s"))
    return newest.select("__s.*")
