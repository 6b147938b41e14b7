"""Session helpers shared by the operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Rows a small side may have before it is shuffled instead of broadcast.
BROADCAST_ROWS = 200_000


def local_session(cores: int = 8, shuffle_partitions: int | None = None) -> SparkSession:
    """A session for tests and benchmarks; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("rankweave")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and working tables, which all executors share.

    It is the one that ``spark.checkpoint.dir`` names, else the context's checkpoint
    folder. A machine-local temporary folder is taken only where driver and executors
    are one process (tests); a cluster without a shared folder fails.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not root and context.getCheckpointDir() is not None:
        root = context.getCheckpointDir()
    if not root:
        root = spark.conf.get("rankweave.fallback.dir", "") or ""
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="rankweave-")
        spark.conf.set("rankweave.fallback.dir", root)
    return root.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage through a reliable checkpoint, so lost executors do no harm."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(spark) + "/checkpoints")
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str = "stage") -> DataFrame:
    """Cut the lineage through a Parquet table in the shared folder.

    Unlike a checkpoint, later reads prune columns and push filters down.
    """
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no further than needed."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast when the row count is checked to be small, else leave it."""
    return F.broadcast(df) if at_most(df, rows) else df


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on columns that may hold NULL, which here equals NULL.

    Without keys ``right`` must be one row; it is then put beside every row.
    """
    renamed = right.select(*[F.col(c).alias(f"__r_{c}") for c in keys], *[c for c in right.columns if c not in keys])
    if not keys:
        return left.join(F.broadcast(renamed.limit(1)))
    condition = F.lit(True)
    for c in keys:
        condition = condition & F.col(c).eqNullSafe(F.col(f"__r_{c}"))
    return left.join(renamed, condition, how).drop(*[f"__r_{c}" for c in keys])


def running_total(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    value: str,
    out: str = "running",
) -> DataFrame:
    """Exact running sum of ``value`` per ``keys`` in ``order``, safe for hot keys.

    A plain window would put a whole key into one task. Here the rows are range
    partitioned by (keys, order), so a hot key spans many tasks; each task sums its
    own stretch and adds the totals of the stretches before it. (keys, order) must
    be unique for the result to be determined.
    """
    ranged = df.repartitionByRange(*[F.col(c) for c in keys + order]).withColumn(
        "__part", F.spark_partition_id()
    )
    # Range bounds are sampled, so the assignment is fixed before it is used twice.
    ranged = durable(ranged)
    part_keys = keys + ["__part"]
    totals = ranged.groupBy(*part_keys).agg(F.sum(value).alias("__sum"))
    before = (
        Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = totals.select(
        *part_keys, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before")
    )
    within = (
        Window.partitionBy(*part_keys)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = ranged.withColumn("__local", F.sum(value).over(within))
    return (
        null_safe_join(local, offsets, part_keys)
        .withColumn(out, F.col("__local") + F.col("__before"))
        .drop("__part", "__local", "__before")
    )
