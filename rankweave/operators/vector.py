"""Exact and list-based nearest neighbours over array columns."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from rankweave.functions.vectors import METRICS, check_vector, distance, literal, norm, same_size
from rankweave.session import work_path

PLACES = 6
# Query vectors and base vectors that meet in one task, and queries compared at once.
QUERY_BLOCK = 4_096
BASE_BLOCK = 8_192
AT_ONCE = 128
# Rows kept beyond k before distances are measured again without cancellation.
SPARE = 8
# Parts of a list whose nearest rows are found apart.
SALTS = 32


def knn(
    df: DataFrame, id_col: str, vec_col: str, query: Sequence[float], k: int, metric: str = "l2"
) -> DataFrame:
    """(id, distance) of the ``k`` nearest rows; equal distances go by id.

    Rows with no finite distance (NULL vectors, components that are no finite numbers, zero
    vectors under cosine) are left out, as ``knn_join`` does; a vector
    of another size than the query's is an error. Every task keeps its best ``k``, so no
    more than that is merged.
    """
    wanted = check_vector(query)
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}, got {metric!r}")
    own = same_size(F.col(vec_col), len(wanted))
    far = distance(own, literal(wanted), metric)
    finite = F.when(~F.isnan(far) & (far < float("inf")), far)
    measured = df.select(F.col(id_col).alias("id"), F.round(finite, PLACES).alias("distance"))
    # Filtering after the limit keeps the distance from being worked out twice.
    top = measured.orderBy(F.col("distance").asc_nulls_last(), "id").limit(k)
    return top.where("distance is not null")


def _block_top(
    ids: np.ndarray, base: np.ndarray, qids: np.ndarray, queries: np.ndarray, k: int, metric: str
) -> pd.DataFrame:
    """Best ``k`` base rows of one block for every query of one block.

    Products find somewhat more than ``k`` rows; their distances are then worked out from
    differences, as the products cancel for long vectors that are close.
    """
    # A component that is no number would spoil the bounds of the whole block.
    finite = np.isfinite(base).all(axis=1)
    ids, base = ids[finite], base[finite]
    if not len(ids):
        return pd.DataFrame({"query_id": qids[:0], "id": ids, "distance": np.zeros(0)})
    order = np.argsort(ids, kind="stable")
    ids, base = ids[order], base[order]
    square, parts = (base**2).sum(axis=1), []
    for low in range(0, len(qids), AT_ONCE):
        some = queries[low : low + AT_ONCE]
        product = some @ base.T
        if metric == "cosine":
            size = np.sqrt((some**2).sum(axis=1))[:, None] * np.sqrt(square)
            with np.errstate(divide="ignore", invalid="ignore"):
                rough = np.where(size > 0, 1.0 - product / size, np.inf)
        else:
            rough = square - 2.0 * product
        width = min(len(ids), k + SPARE)
        # Equal rough distances at the cut all stay, so ties still go by id.
        cut = np.partition(rough, width - 1, axis=1)[:, width - 1]
        slack = 1e-9 * (1.0 + np.abs(cut)) if metric == "cosine" else 1e-12 * (square.max() + (some**2).sum(axis=1))
        row, column = np.nonzero(rough <= (cut + slack)[:, None])
        if metric == "cosine":
            exact = rough[row, column]
        else:
            exact = np.sqrt(((base[column] - some[row]) ** 2).sum(axis=1))
        exact = np.round(exact, PLACES) + 0.0
        by = np.lexsort((column, exact, row))
        row, column, exact = row[by], column[by], exact[by]
        keep = (np.arange(len(row)) - np.searchsorted(row, row) < k) & np.isfinite(exact)
        parts.append(pd.DataFrame({"query_id": qids[low + row[keep]], "id": ids[column[keep]], "distance": exact[keep]}))
    return pd.concat(parts)


def _best(near: pd.DataFrame, k: int) -> pd.DataFrame:
    """The ``k`` nearest of each query out of those of several blocks."""
    near = near.sort_values(["query_id", "distance", "id"], kind="stable")
    return near[near.groupby("query_id", dropna=False).cumcount() < k]


def _stack(vectors: pd.Series) -> np.ndarray:
    return np.vstack([np.asarray(v, dtype=np.float64) for v in vectors])


def _sized(df: DataFrame, vec_col: str) -> DataFrame:
    """``df`` with its non-NULL vectors, an error where they differ in size."""
    rows = df.where(F.col(vec_col).isNotNull())
    first = rows.select(F.size(vec_col)).first()
    return rows if first is None else rows.withColumn(vec_col, same_size(F.col(vec_col), first[0]))


def knn_join(
    queries: DataFrame,
    query_id: str,
    query_vec: str,
    df: DataFrame,
    id_col: str,
    vec_col: str,
    k: int,
    metric: str = "l2",
    query_block: int = QUERY_BLOCK,
    base_block: int = BASE_BLOCK,
) -> DataFrame:
    """(query_id, rank, id, distance): the ``k`` nearest rows of every query vector.

    Queries and rows are cut into blocks of a bounded size, and each block of queries
    meets each block of rows in a task, which passes on ``k`` rows per query. Blocks
    smaller than ``QUERY_BLOCK`` and ``BASE_BLOCK`` are dealt several to a task, as every
    task more is a copy more of the vectors. All pairs
    are compared: large tables of queries are better asked through ``ivf_knn_join``.
    Vectors that differ in size are an error.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}, got {metric!r}")
    asked = _sized(queries, query_vec).select(
        F.col(query_id).alias("query_id"), F.col(query_vec).cast("array<double>").alias("qvec")
    )
    rows = _sized(df, vec_col).select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    q_blocks = asked.count() // max(query_block, QUERY_BLOCK) + 1
    b_blocks = rows.count() // max(base_block, BASE_BLOCK) + 1
    return _ranked(_met(asked, rows, [], q_blocks, b_blocks, k, metric, query_block, base_block), k)


def _met(
    asked: DataFrame, rows: DataFrame, within: list[str], q_blocks, b_blocks, k: int, metric: str,
    query_block: int = QUERY_BLOCK, base_block: int = BASE_BLOCK,
) -> DataFrame:
    """(query_id, id, distance): each block of queries with each block of rows that agree on ``within``.

    The numbers of blocks are constants or columns of both sides. In a task up to
    ``query_block`` queries and ``base_block`` rows are compared at a time.
    """
    q_count, b_count = (F.lit(n) if isinstance(n, int) else n for n in (q_blocks, b_blocks))
    none = F.lit(0).cast("long")
    left = asked.withColumn("qb", F.pmod(F.xxhash64("query_id"), q_count)).withColumn(
        "bb", F.explode(F.sequence(none, b_count.cast("long") - 1))
    )
    right = rows.withColumn("bb", F.pmod(F.xxhash64("id"), b_count)).withColumn(
        "qb", F.explode(F.sequence(none, q_count.cast("long") - 1))
    )
    types = {f.name: f.dataType.simpleString() for f in [*asked.schema, *rows.schema]}

    def compare(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if q.empty or b.empty:
            return pd.DataFrame({"query_id": q["query_id"][:0], "id": b["id"][:0], "distance": pd.Series(dtype=float)})
        queries, base = _stack(q["qvec"]), _stack(b["vec"])
        if queries.shape[1] != base.shape[1]:
            raise ValueError(f"queries have {queries.shape[1]} components, rows {base.shape[1]}")
        ids, qids, parts = b["id"].to_numpy(), q["query_id"].to_numpy(), []
        for at in range(0, len(qids), query_block):
            some = slice(at, at + query_block)
            best = [
                _block_top(ids[low : low + base_block], base[low : low + base_block], qids[some], queries[some], k, metric)
                for low in range(0, len(ids), base_block)
            ]
            parts += best if len(best) == 1 else [_best(pd.concat(best), k)]
        return pd.concat(parts)

    keys = [*within, "qb", "bb"]
    schema = f"query_id {types['query_id']}, id {types['id']}, distance double"
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, schema)


def _ranked(near: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return (
        near.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "id", "distance")
    )


# -- lists ---------------------------------------------------------------------


class IvfIndex:
    """Rows stored by the nearest of a set of centres."""

    def __init__(self, spark: SparkSession, path: str, metric: str, centers: list[list[float]]) -> None:
        self.spark, self.path, self.metric, self.centers = spark, path, metric, centers

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> "IvfIndex":
        body = json.loads(spark.read.parquet(f"{path}/centers").first()["body"])
        return cls(spark, path, body["metric"], body["centers"])

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def nearest_lists(self, query: Sequence[float], probes: int) -> list[int]:
        """Numbers of the ``probes`` centres closest to the query."""
        centers = np.asarray(self.centers)
        point = np.asarray(query, dtype=np.float64)
        if self.metric == "cosine":
            point = point / (np.linalg.norm(point) or 1.0)
        gap = ((centers - point) ** 2).sum(axis=1)
        return [int(i) for i in np.argsort(gap, kind="stable")[:probes]]


def build_ivf(
    df: DataFrame,
    id_col: str,
    vec_col: str,
    lists: int,
    path: str | None = None,
    metric: str = "l2",
    centers: Sequence[Sequence[float]] | None = None,
    splits: int = 8,
    seed: int = 42,
) -> IvfIndex:
    """Store every row below the list of its nearest centre.

    The centres are learnt on all rows by k-means, or given. Under cosine the vectors are
    brought to length one first. A list is written by up to ``splits`` tasks.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    spark = df.sparkSession
    path = path or work_path(spark, "ivf")
    rows = _sized(df.select(id_col, vec_col), vec_col).select(
        F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec")
    )
    placed = F.col("vec")
    if metric == "cosine":
        rows = rows.withColumn("size", norm(F.col("vec"))).where("size > 0")
        placed = F.transform(F.col("vec"), lambda x: x / F.col("size"))
    rows = rows.withColumn("placed", placed)
    if centers is None:
        vectors = rows.withColumn("features", array_to_vector("placed"))
        model = KMeans(k=lists, seed=seed, maxIter=20, featuresCol="features", predictionCol="list").fit(
            vectors.select("features")
        )
        centers = model.clusterCenters()
    known = [[float(x) for x in c] for c in centers]
    points, sizes = np.asarray(known), (np.asarray(known) ** 2).sum(axis=1)

    @F.pandas_udf("int")
    def nearest_list(batch: pd.Series) -> pd.Series:
        return pd.Series(np.argmin(sizes - 2 * _stack(batch) @ points.T, axis=1)) if len(batch) else pd.Series(dtype=int)

    (
        rows.select("id", "vec", nearest_list("placed").alias("list"))
        .repartition("list", F.pmod(F.xxhash64("id"), F.lit(splits)))
        .write.mode("overwrite")
        .partitionBy("list")
        .parquet(f"{path}/rows")
    )
    body = json.dumps({"metric": metric, "centers": known})
    spark.createDataFrame([(body,)], StructType([StructField("body", StringType())])).coalesce(1).write.mode(
        "overwrite"
    ).parquet(f"{path}/centers")
    return IvfIndex(spark, path, metric, known)


def ivf_knn(index: IvfIndex, query: Sequence[float], k: int, probes: int = 1) -> DataFrame:
    """(id, distance) from the ``probes`` nearest lists only, exactly ranked."""
    chosen = index.nearest_lists(check_vector(query), probes)
    return knn(index.rows().where(F.col("list").isin(*chosen)), "id", "vec", query, k, index.metric)


def ivf_knn_join(
    index: IvfIndex, queries: DataFrame, query_id: str, query_vec: str, k: int, probes: int | None = 1
) -> DataFrame:
    """(query_id, rank, id, distance): each query against the rows of its ``probes`` nearest lists.

    With ``probes`` None the result is exact: a query goes to every list that may hold one
    of its ``k`` nearest rows by the triangle inequality, and to no other.

    Within a list, blocks of queries meet blocks of rows; their numbers follow from the
    counted sizes, so neither a large list nor a popular one is one task's work.
    """
    points, metric = np.asarray(index.centers), index.metric
    bounds = _list_bounds(index, k) if probes is None else None
    asked = _sized(queries, query_vec).select(
        F.col(query_id).alias("query_id"), F.col(query_vec).cast("array<double>").alias("qvec")
    )

    @F.pandas_udf("array<int>")
    def lists_of(batch: pd.Series) -> pd.Series:
        vectors = _stack(batch)
        if metric == "cosine":
            sizes = np.sqrt((vectors**2).sum(axis=1))[:, None]
            vectors = vectors / np.where(sizes > 0, sizes, 1)
        if bounds is not None:
            return pd.Series(_lists_in_reach(vectors, points, *bounds, metric))
        # A query's own square changes no order; slices keep batch x lists small.
        squares, found = (points**2).sum(axis=1), []
        for low in range(0, len(vectors), AT_ONCE):
            gap = squares - 2.0 * vectors[low : low + AT_ONCE] @ points.T
            found += list(np.argsort(gap, axis=1, kind="stable")[:, :probes])
        return pd.Series(found)

    asked = asked.withColumn("list", F.explode(lists_of("qvec")))
    rows = index.rows().select("id", "vec", F.col("list").cast("int").alias("list"))

    def blocks(df: DataFrame, size: int, name: str) -> DataFrame:
        return df.groupBy("list").agg(F.ceil(F.count("*") / size).cast("long").alias(name))

    # One row for each list, whose number the index bounds.
    counted = F.broadcast(blocks(asked, QUERY_BLOCK, "qn").join(blocks(rows, BASE_BLOCK, "bn"), "list"))

    def with_counts(df: DataFrame) -> DataFrame:
        # New names for the numbers, as both sides have them from one table.
        return df.join(counted, "list").select(
            *df.columns, (F.col("qn") + 0).alias("q_blocks"), (F.col("bn") + 0).alias("b_blocks")
        )

    near = _met(
        with_counts(asked), with_counts(rows), ["list"], F.col("q_blocks"), F.col("b_blocks"), k, metric
    )
    return _ranked(near, k)


def _list_bounds(index: IvfIndex, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each list, the greatest distance of a row to its centre, and the ``k``-th least.

    The first is below zero for an empty list, the second infinite for one of fewer rows.
    """
    points, unit = np.asarray(index.centers), index.metric == "cosine"

    @F.pandas_udf("double")
    def to_center(vectors: pd.Series, lists: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series(dtype=float)
        placed = _stack(vectors)
        if unit:
            placed = placed / np.sqrt((placed**2).sum(axis=1))[:, None]
        gap = np.sqrt(((placed - points[lists.to_numpy()]) ** 2).sum(axis=1))
        return pd.Series(np.where(np.isfinite(gap), gap, np.nan))

    gaps = index.rows().select(F.col("list").cast("int").alias("list"), to_center("vec", F.col("list").cast("int")).alias("gap"))
    gaps = gaps.where(~F.isnan("gap"))
    # A list may hold a third of all rows: its first are found in salted parts, then of those.
    salted = gaps.withColumn("salt", F.pmod(F.xxhash64("gap"), F.lit(SALTS)))
    for keys in (["list", "salt"], ["list"]):
        nth = F.row_number().over(Window.partitionBy(*keys).orderBy("gap"))
        salted = salted.withColumn("nth", nth).where(F.col("nth") <= k).drop("nth")
    first = salted
    inner = first.groupBy("list").agg(F.count("*").alias("n"), F.max("gap").alias("kth"))
    radius, kth = np.full(len(points), -1.0), np.full(len(points), np.inf)
    # One row for each list, whose number the index bounds.
    for r in gaps.groupBy("list").agg(F.max("gap").alias("radius")).join(inner, "list").toLocalIterator():
        radius[r["list"]] = r["radius"]
        if r["n"] == k:
            kth[r["list"]] = r["kth"]
    return radius, kth


def _lists_in_reach(vectors: np.ndarray, points: np.ndarray, radius: np.ndarray, kth: np.ndarray, metric: str) -> list[np.ndarray]:
    """The lists of each query whose nearest possible row is no further than ``k`` rows surely are."""
    found = []
    for vector in vectors:
        gap = np.sqrt(((points - vector) ** 2).sum(axis=1))
        least, most = np.maximum(gap - radius, 0.0), (gap + kth).min()
        # Distances are rounded, and those that are equal then go by id.
        slack = 2 * 10.0**-PLACES
        if metric == "cosine":
            # Of vectors of length one: half the square of their distance.
            near = least**2 / 2 <= most**2 / 2 + slack
        else:
            near = least <= most + slack + 1e-9 * gap
        found.append(np.flatnonzero(near & (radius >= 0)).astype(np.int32))
    return found
