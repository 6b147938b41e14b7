"""Dotted label paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ancestors(path: Column) -> Column:
    """Every prefix of a path, the path itself last."""
    labels = F.split(path, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(F.slice(labels, F.lit(1), n), ".")
    )


def depth(path: Column) -> Column:
    return F.size(F.split(path, r"\."))


def is_descendant(path: Column, of: Column) -> Column:
    """Whether ``path`` is ``of`` or lies below it."""
    return (path == of) | F.startswith(path, F.concat(of, F.lit(".")))


def descendants(df: DataFrame, path: str, root: str) -> DataFrame:
    """Rows at or below ``root``."""
    return df.where(is_descendant(F.col(path), F.lit(root)))


def hierarchy_rollup(df: DataFrame, path: str, aggs: list[Column]) -> DataFrame:
    """(path, depth, *aggs) for every node, over all rows at or below it.

    Rows are first put together per full path by the shuffle of the same group-by's
    partial step, so the root is no hot key.
    """
    nodes = df.withColumn("__node", F.explode(ancestors(F.col(path))))
    grouped = nodes.groupBy("__node").agg(*aggs)
    return grouped.select(
        F.col("__node").alias("path"), depth(F.col("__node")).alias("depth"), *[c for c in grouped.columns if c != "__node"]
    )
