"""Assertions about tables, each one a row of the result."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _one(df: DataFrame, ok: Column, description: str, detail: Column) -> DataFrame:
    return df.select(ok.alias("ok"), F.lit(description).alias("description"), F.when(~ok, detail).alias("detail"))


def rows_equal(a: DataFrame, b: DataFrame, description: str) -> DataFrame:
    """Both tables hold the same rows, equal rows counted.

    Rows are counted per side in one group-by, instead of two difference passes.
    """
    names = a.columns
    both = a.select(*names, F.lit(1).alias("__s")).unionByName(b.select(*names, F.lit(-1).alias("__s")))
    gap = both.groupBy(*names).agg(F.sum("__s").alias("__s")).agg(
        F.coalesce(F.sum(F.greatest("__s", F.lit(0))), F.lit(0)).alias("extra"),
        F.coalesce(F.sum(F.greatest(-F.col("__s"), F.lit(0))), F.lit(0)).alias("missing"),
    )
    return _one(
        gap,
        (F.col("extra") == 0) & (F.col("missing") == 0),
        description,
        F.concat_ws(" ", F.lit("extra rows:"), "extra", F.lit("missing rows:"), "missing"),
    )


def row_count_is(df: DataFrame, n: int, description: str) -> DataFrame:
    counted = df.agg(F.count("*").alias("n"))
    return _one(counted, F.col("n") == n, description, F.concat(F.lit("rows: "), F.col("n").cast("string")))


def is_empty(df: DataFrame, description: str) -> DataFrame:
    return row_count_is(df, 0, description)


def holds_for_all(df: DataFrame, condition: Column | str, description: str) -> DataFrame:
    """The condition is true for every row; NULL counts as broken."""
    test = F.expr(condition) if isinstance(condition, str) else condition
    broken = df.agg(F.count(F.when(~F.coalesce(test, F.lit(False)), 1)).alias("n"))
    return _one(broken, F.col("n") == 0, description, F.concat(F.lit("broken rows: "), F.col("n").cast("string")))


def has_columns(df: DataFrame, columns: list[str], description: str) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    return _one(
        df.sparkSession.range(1), F.lit(not missing), description, F.lit("missing: " + ", ".join(missing))
    )


def is_unique(df: DataFrame, key: list[str], description: str) -> DataFrame:
    twice = df.groupBy(*key).count().where("count > 1").agg(F.count("*").alias("n"))
    return _one(twice, F.col("n") == 0, description, F.concat(F.lit("repeated keys: "), F.col("n").cast("string")))


def assert_tables(spark: SparkSession, assertions: list[DataFrame]) -> DataFrame:
    """(ok, n, description, detail): the results, numbered in the given order."""
    if not assertions:
        return spark.createDataFrame([], "ok boolean, n int, description string, detail string")
    numbered = [a.select("ok", F.lit(i).alias("n"), "description", "detail") for i, a in enumerate(assertions, start=1)]
    return reduce(DataFrame.unionByName, numbered)
