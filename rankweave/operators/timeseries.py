"""Time buckets, time-partitioned tables and range partition plans."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the Monday that day and week buckets are counted from.
ORIGIN = "2000-01-03 00:00:00"
CHUNK = "chunk_start"


def _seconds(spark: SparkSession, width: str) -> int:
    """Length of an interval text such as '15 minutes'."""
    one = spark.sql("SELECT unix_timestamp(timestamp'2001-01-01' + cast(:w AS INTERVAL)) - "
                    "unix_timestamp(timestamp'2001-01-01') AS s", {"w": width})
    seconds = int(one.first()["s"])
    if seconds <= 0:
        raise ValueError(f"width must be positive, got {width!r}")
    return seconds


def bucket_start(ts: Column, width: str, spark: SparkSession, origin: str = ORIGIN) -> Column:
    """Start of the bucket of ``ts``; buckets count from ``origin``. Drops rows without a time."""
    return F.window(ts, width, startTime=_offset(spark, width, origin))["start"]


def _offset(spark: SparkSession, width: str, origin: str) -> str:
    at = datetime.fromisoformat(origin).replace(tzinfo=timezone.utc).timestamp()
    return f"{int(at) % _seconds(spark, width)} seconds"


def time_bucket(
    df: DataFrame, ts: str, width: str, aggs: list[Column], by: list[str] | None = None,
    origin: str = ORIGIN, watermark: str | None = None,
) -> DataFrame:
    """(bucket, *by, *aggs) over buckets of fixed width.

    Rows without a time are in a bucket of their own, NULL. On a stream give a
    ``watermark``: a bucket is sent once it has passed, and such rows are in none.
    """
    rows = df.withWatermark(ts, watermark) if watermark else df
    window = F.window(ts, width, startTime=_offset(df.sparkSession, width, origin))
    grouped = rows.groupBy(window.alias("__w"), *(by or [])).agg(*aggs)
    out = grouped.select(F.col("__w.start").alias("bucket"), *[c for c in grouped.columns if c != "__w"])
    if df.isStreaming:
        return out
    # A window passes over rows without a time; the scan for them prunes by statistics.
    void = F.lit(None).cast(out.schema["bucket"].dataType).alias("bucket")
    return out.unionByName(df.where(F.col(ts).isNull()).groupBy(void, *(by or [])).agg(*aggs))


def write_chunked(df: DataFrame, ts: str, width: str, path: str, mode: str = "append", splits: int = 4) -> None:
    """Write a table in one folder per time chunk; rows without a time have a folder too.

    Rows move once, by chunk and a hash of the row, so that a busy chunk is written by
    up to ``splits`` tasks.
    """
    start = F.date_format(bucket_start(F.col(ts), width, df.sparkSession), "yyyy-MM-dd HH_mm_ss")
    split = F.pmod(F.xxhash64(*df.columns), F.lit(splits))
    void = df.where(F.col(ts).isNull()).withColumn(CHUNK, F.lit(None).cast("string"))
    (
        df.where(F.col(ts).isNotNull())
        .withColumn(CHUNK, start)
        .unionByName(void)
        .repartition(F.col(CHUNK), split)
        .write.mode(mode)
        .partitionBy(CHUNK)
        .parquet(path)
    )


def read_chunked(spark: SparkSession, path: str, ts: str, width: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """Rows with since <= ts < until; only the chunks that can hold them are opened."""
    rows = spark.read.option("basePath", path).parquet(path)
    start = F.to_timestamp(F.col(CHUNK).cast("string"), "yyyy-MM-dd HH_mm_ss")
    if since is not None:
        at = F.lit(since).cast("timestamp")
        rows = rows.where((F.col(ts) >= at) & (start > F.timestamp_add("SECOND", F.lit(-_seconds(spark, width)), at)))
    if until is not None:
        at = F.lit(until).cast("timestamp")
        rows = rows.where((F.col(ts) < at) & (start < at))
    return rows.drop(CHUNK)


def chunk_catalog(df: DataFrame, ts: str, width: str) -> DataFrame:
    """(chunk, first_ts, last_ts, n_rows) of the chunks a table has or would have."""
    return time_bucket(
        df, ts, width,
        [F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("n_rows")],
    ).withColumnRenamed("bucket", "chunk")


def chunks(spark: SparkSession, path: str, ts: str) -> DataFrame:
    """The same catalogue read off a written table."""
    rows = spark.read.option("basePath", path).parquet(path)
    start = F.to_timestamp(F.col(CHUNK).cast("string"), "yyyy-MM-dd HH_mm_ss")
    return rows.groupBy(start.alias("chunk")).agg(
        F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("n_rows")
    )


def partition_plan(df: DataFrame, key: str, width: int) -> DataFrame:
    """(part, range_start, range_end, n_rows) of every range between the lowest and highest.

    A range without rows is listed with n_rows 0.
    """
    if isinstance(width, bool) or not isinstance(width, int) or width < 1:
        raise ValueError(f"width must be an integer >= 1, got {width!r}")
    part = F.floor(F.col(key) / F.lit(width)).cast("long")
    counted = df.where(F.col(key).isNotNull()).groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    ends = df.agg(F.min(part).alias("a"), F.max(part).alias("b")).first()
    spark = df.sparkSession
    whole = spark.range(0 if ends["a"] is None else ends["a"], 0 if ends["b"] is None else ends["b"] + 1)
    return whole.select(F.col("id").alias("part")).join(counted, "part", "left").select(
        "part",
        (F.col("part") * width).alias("range_start"),
        ((F.col("part") + 1) * width).alias("range_end"),
        F.coalesce("n", F.lit(0)).alias("n_rows"),
    )
