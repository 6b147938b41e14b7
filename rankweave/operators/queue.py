"""Message queues as an append-only log and its fold.

Log columns: ``queue, event_ts, op, msg_id, message, vt``. ``op`` is create, send,
read, archive or delete; ``vt`` is the time until which a read hides its message.
What a queue holds at a moment follows from the log alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankweave.session import running_total

LOG_SCHEMA = "queue string, event_ts timestamp, op string, msg_id long, message string, vt timestamp"
# Folders of a log that are looked for one by one; for more the log's folder is listed.
LISTED = 1_000


def create_queue(spark: SparkSession, queue: str, now: str) -> DataFrame:
    """The log row that opens a queue."""
    if not queue:
        raise ValueError("a queue needs a name")
    row = spark.createDataFrame([(queue, "create")], "queue string, op string")
    return _log_row(row, F.lit(now).cast("timestamp"))


def _log_row(df: DataFrame, now: Column, vt: Column | None = None) -> DataFrame:
    has = set(df.columns)
    return df.select(
        "queue",
        now.alias("event_ts"),
        "op",
        (F.col("msg_id") if "msg_id" in has else F.lit(None)).cast("long").alias("msg_id"),
        (F.col("message") if "message" in has else F.lit(None)).cast("string").alias("message"),
        (F.lit(None).cast("timestamp") if vt is None else vt).alias("vt"),
    )


def list_queues(log: DataFrame) -> DataFrame:
    """(queue, created_at) of the opened queues."""
    return log.where("op = 'create'").groupBy("queue").agg(F.min("event_ts").alias("created_at"))


def send(log: DataFrame, queue: str, messages: DataFrame, message: str, now: str, order: list[str] | None = None) -> DataFrame:
    """Log rows for new messages, numbered on from the queue's last one.

    Numbers follow ``order``, which must be unique, or the text of the message.
    """
    last = log.where((F.col("queue") == queue) & (F.col("op") == "send")).agg(F.coalesce(F.max("msg_id"), F.lit(0))).first()[0]
    order = order or [message]
    rows = messages.withColumn("__one", F.lit(1))
    numbered = running_total(rows, [], order, "__one", "__place")
    return _log_row(
        numbered.select(
            F.lit(queue).alias("queue"),
            F.lit("send").alias("op"),
            (F.col("__place") + F.lit(last)).alias("msg_id"),
            F.col(message).alias("message"),
        ),
        F.lit(now).cast("timestamp"),
    )


def fold(log: DataFrame) -> DataFrame:
    """(queue, msg_id, message, sent_at, read_ct, vt, state): one row per message.

    ``state`` is live, archived or deleted. Only the newest read matters for ``vt``.
    """
    rows = log.where(F.col("op").isin("send", "read", "archive", "delete"))
    is_op = lambda name: F.col("op") == name
    return (
        rows.groupBy("queue", "msg_id")
        .agg(
            F.max(F.when(is_op("send"), F.col("message"))).alias("message"),
            F.min(F.when(is_op("send"), F.col("event_ts"))).alias("sent_at"),
            F.count(F.when(is_op("read"), 1)).alias("read_ct"),
            F.max_by("vt", F.when(is_op("read"), F.struct("event_ts", "vt"))).alias("vt"),
            F.max(F.when(is_op("delete"), 2).when(is_op("archive"), 1).otherwise(0)).alias("__state"),
        )
        .withColumn("state", F.element_at(F.array(F.lit("live"), F.lit("archived"), F.lit("deleted")), F.col("__state") + 1))
        .drop("__state")
        .where("sent_at is not null")
    )


def visible(log: DataFrame, now: str) -> DataFrame:
    """Messages that a read at ``now`` may return."""
    at = F.lit(now).cast("timestamp")
    seen = fold(log.where(F.col("event_ts") <= at))
    return seen.where((F.col("state") == "live") & (F.col("vt").isNull() | (F.col("vt") <= at)))


def read(log: DataFrame, queue: str, vt: int, qty: int, now: str) -> tuple[DataFrame, DataFrame]:
    """(messages, log rows): the ``qty`` oldest visible messages, hidden for ``vt`` seconds."""
    for name, value, least in (("vt", vt, 0), ("qty", qty, 1)):
        if isinstance(value, bool) or not isinstance(value, int) or value < least:
            raise ValueError(f"{name} must be an integer >= {least}, got {value!r}")
    taken = visible(log.where(F.col("queue") == queue), now).orderBy("msg_id").limit(qty)
    at = F.lit(now).cast("timestamp")
    until = F.timestamp_add("SECOND", F.lit(vt), at)
    messages = taken.select("msg_id", (F.col("read_ct") + 1).alias("read_ct"), "sent_at", until.alias("vt"), "message")
    rows = taken.select("queue", "msg_id", F.lit("read").alias("op"))
    return messages, _log_row(rows, at, until)


def read_each(log: DataFrame, qty: int, now: str) -> DataFrame:
    """(queue, place, msg_id, message): the ``qty`` oldest visible messages of every queue."""
    order = Window.partitionBy("queue").orderBy("msg_id")
    return (
        visible(log, now)
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= qty)
        .select("queue", "place", "msg_id", "message")
    )


def _mark(log: DataFrame, queue: str, ids: DataFrame, op: str, now: str) -> DataFrame:
    at = F.lit(now).cast("timestamp")
    live = fold(log.where(F.col("queue") == queue)).where("state = 'live'")
    rows = live.join(ids.select(F.col(ids.columns[0]).cast("long").alias("msg_id")).distinct(), "msg_id", "left_semi")
    return _log_row(rows.select("queue", "msg_id", F.lit(op).alias("op")), at)


def archive(log: DataFrame, queue: str, ids: DataFrame, now: str) -> DataFrame:
    """Log rows that move messages to the archive; unknown ids are passed over."""
    return _mark(log, queue, ids, "archive", now)


def delete(log: DataFrame, queue: str, ids: DataFrame, now: str) -> DataFrame:
    """Log rows that take messages out altogether."""
    return _mark(log, queue, ids, "delete", now)


def archived(log: DataFrame) -> DataFrame:
    """Messages in the archives, with when they got there."""
    moved = log.where("op = 'archive'").groupBy("queue", "msg_id").agg(F.min("event_ts").alias("archived_at"))
    return fold(log).where("state = 'archived'").join(moved, ["queue", "msg_id"]).select(
        "queue", "msg_id", "message", "sent_at", "archived_at"
    )


def append(log_rows: DataFrame, path: str, width: int | None = None) -> None:
    """Append log rows to a stored log, one folder per ``width`` message numbers if given.

    Rows are dealt by folder first, so that a folder gets one file, whatever the number of
    tasks that give the rows; rows without a number stay in many.
    """
    if width is None:
        log_rows.write.mode("append").parquet(path)
        return
    part = F.coalesce(F.floor(F.col("msg_id") / F.lit(width)).cast("long"), F.lit(-1).cast("long"))
    spark = log_rows.sparkSession
    # Files take more time than bytes, so tasks are not joined by their bytes.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    spread = F.when(F.col("part") < 0, F.pmod(F.xxhash64(*log_rows.columns), F.lit(tasks))).otherwise(0)
    dealt = log_rows.withColumn("part", part).repartition(tasks, "part", spread)
    dealt.write.mode("append").partitionBy("part").parquet(path)


def _folders(spark: SparkSession, path: str, first: int, last: int) -> list[str]:
    """The folders of parts ``first`` to ``last`` that are there."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    named = [f"{path}/part={n}" for n in range(first, last + 1)]
    return [name for name in named if files.exists(jvm.org.apache.hadoop.fs.Path(name))]


def open_log(spark: SparkSession, path: str, width: int | None = None, first: int | None = None, last: int | None = None) -> DataFrame:
    """A stored log, partitioned or not.

    With the ``width`` that it was written with, ``first`` and ``last`` give the message
    numbers wanted, ends included, and only the folders that hold them are read; where these
    are at most ``LISTED``, no others are even listed.
    """
    names = [c.split()[0] for c in LOG_SCHEMA.split(", ")]
    paths = []
    if width is not None and first is not None and last is not None and last // width - first // width < LISTED:
        paths = _folders(spark, path, first // width, last // width)
    # The types are those that were written.
    log = spark.read.option("basePath", path).parquet(*(paths or [path]))
    if first is not None:
        log = log.where(F.col("msg_id") >= first)
        log = log if width is None else log.where(F.col("part") >= first // width)
    if last is not None:
        log = log.where(F.col("msg_id") <= last)
        log = log if width is None else log.where(F.col("part") <= last // width)
    return log.select(*names)
