"""Where rows come from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the supplied tables."""
    if name not in TABLES:
        raise ValueError(f"no such table: {name!r}")
    return spark.read.parquet(f"{folder}/{name}.parquet")
