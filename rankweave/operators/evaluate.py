"""Measures of retrieval runs and of timings."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.operators.analyze import token_arrays
from rankweave.session import broadcast_if_small, durable, null_safe_join, running_total


def recall_at_k(hits: DataFrame, truth: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, recall) out of hits (query_id, rank, id) and truth (query_id, id).

    Found within the first ``k``, over the smaller of ``k`` and the size of the
    truth. A query with hits and no truth gets NaN.
    """
    wanted = truth.select("query_id", "id").distinct()
    size = wanted.groupBy("query_id").agg(F.count("*").alias("n"))
    found = (
        hits.where(F.col("rank") <= k)
        .select("query_id", "id")
        .distinct()
        .join(wanted, ["query_id", "id"], "left_semi")
        .groupBy("query_id")
        .agg(F.count("*").alias("found"))
    )
    asked = hits.select("query_id").union(size.select("query_id")).distinct()
    return (
        asked.join(size, "query_id", "left")
        .join(found, "query_id", "left")
        .select(
            "query_id",
            F.when(F.col("n") > 0, F.coalesce("found", F.lit(0)) / F.least(F.lit(k), F.col("n")))
            .otherwise(F.lit(math.nan))
            .alias("recall"),
        )
    )


def mean_recall(recalls: DataFrame) -> DataFrame:
    """One row (mean_recall, n_queries) over the queries that have a truth."""
    return recalls.where(~F.isnan("recall")).agg(
        F.avg("recall").alias("mean_recall"), F.count("*").alias("n_queries")
    )


def rbo(rank_a: DataFrame, rank_b: DataFrame, p: float = 0.9, depth: int = 10) -> DataFrame:
    """(query_id, rbo): rank-biased overlap of two runs (query_id, rank, id).

    An id counts at every depth from the later of its two ranks on, so it adds a
    weight that depends on that rank only and no depth has to be listed.
    """
    each = [p ** (d - 1) / d for d in range(1, depth + 1)]
    total = sum(p ** (d - 1) for d in range(1, depth + 1))
    tail = F.array(*[F.lit(sum(each[d:]) / total) for d in range(depth)])
    a = rank_a.where(F.col("rank") <= depth).select("query_id", "id", F.col("rank").alias("ra"))
    b = rank_b.where(F.col("rank") <= depth).select("query_id", "id", F.col("rank").alias("rb"))
    shared = a.join(b, ["query_id", "id"]).select(
        "query_id", F.element_at(tail, F.greatest("ra", "rb").cast("int")).alias("w")
    )
    asked = rank_a.select("query_id").union(rank_b.select("query_id")).distinct()
    return (
        asked.join(shared, "query_id", "left")
        .groupBy("query_id")
        .agg(F.round(F.coalesce(F.sum("w"), F.lit(0.0)), 6).alias("rbo"))
    )


def containment_truth(df: DataFrame, id_col: str, text_col: str, terms: DataFrame, analyzer: str = "unicode") -> DataFrame:
    """(query_id, id): rows that hold the exact token of ``terms`` (query_id, term)."""
    arrays = token_arrays(df.select(id_col, text_col), id_col, text_col, analyzer)
    held = arrays.select("id", F.explode(F.array_distinct("tokens")).alias("term"))
    return held.join(broadcast_if_small(terms.distinct()), "term").select("query_id", "id").distinct()


def pick_terms_by_df(stats: DataFrame, lo: float, hi: float, k: int, min_df: int = 3) -> DataFrame:
    """(pick, term, df): ``k`` terms stepped through a band of the df order.

    ``stats`` is (term, df). Terms are ordered by df, then by text; the places are
    exact and numbered without bringing the vocabulary into one task.
    """
    known = stats.where(F.col("df") >= min_df).select("term", "df", F.lit(1).alias("one"))
    placed = durable(running_total(known, [], ["df", "term"], "one", "place"))
    n = placed.count()
    if n == 0:
        raise ValueError(f"no term with df >= {min_df}")
    start = int(n * lo)
    band = min(max(start + 1, int(n * hi)), n) - start
    step = max(1, band // k)
    picks = [(i, start + min(i * step, band - 1) + 1) for i in range(k)]
    wanted = stats.sparkSession.createDataFrame(picks, "pick int, place long")
    return placed.join(F.broadcast(wanted), "place").select("pick", "term", "df")


def percentiles(df: DataFrame, keys: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """Exact interpolated percentiles per key, one column per entry of ``points``.

    Equal values are counted first. The running count then tells which values
    stand at the two places around a percentile, also for a key with a third of
    all rows, as no task has to hold a key.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"))
    upto = running_total(counted, keys, [value], "__n", "__upto")
    size = counted.groupBy(*keys).agg(F.sum("__n").alias("__size"), F.min(value).alias("min"))
    placed = null_safe_join(upto, size, keys)
    columns = []
    for name, p in points.items():
        at = (F.col("__size") - 1) * F.lit(p)
        low, high = F.floor(at), F.ceil(at)

        def holds(place):
            return (F.col("__upto") > place) & (F.col("__upto") - F.col("__n") <= place)

        low_value = F.max(F.when(holds(low), F.col(value)))
        high_value = F.max(F.when(holds(high), F.col(value)))
        part = F.max(at - low)
        columns.append((low_value + (high_value - low_value) * part).alias(name))
    return placed.groupBy(*keys).agg(*columns, F.max("min").alias("min"))


def latency_summary(timings: DataFrame, case: str, group: str, value: str) -> tuple[DataFrame, DataFrame]:
    """Per case p50, p95 and min; per class the mean p50, highest p95 and lowest min."""
    per_case = percentiles(timings, [group, case], value, {"p50": 0.5, "p95": 0.95})
    per_class = per_case.groupBy(group).agg(
        F.round(F.avg("p50"), 6).alias("p50"),
        F.round(F.max("p95"), 6).alias("p95"),
        F.min("min").alias("min"),
    )
    return per_case, per_class
