"""Approximate nearest neighbours by inner product, with an adaptive scan of dimensions.

Largest inner product becomes least distance: a stored vector gets one more component
that brings all to the same length, a query a zero there. All are turned by one random
rotation, so that any leading components estimate the whole distance. Stored vectors
are dealt to lists around centres; a query looks into the lists with the nearest
centres. In a list the vectors stand in blocks of columns: after each block a hypothesis
test on the partial distances gives up the candidates that are too far, and only the
others are read on. What is left is scored exactly, on the original vectors.

The number of lists to look into is found by measurement: a bounded set of queries is
answered by brute force, and the fewest lists with the wanted recall are taken.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankweave.llm.common import map_groups
from rankweave.session import stored

# Bounds of the sample that centres are fitted on, and of the lists; each sample vector
# also bounds how far a query's neighbours can be.
TRAIN_ROWS = 10_000
MAX_LISTS = 4_096
ROUNDS = 8
# Queries that are answered by brute force, and the recall their lists must give.
MEASURED, RECALL = 200, 0.96
# Columns read between two tests, and the width of the test in standard errors.
COLUMNS, DOUBT = 16, 1.5
# Stored vectors and queries that meet in one task.
STORED_BLOCK, QUERY_BLOCK = 2_048, 512
# Queries whose distances are held at once.
AT_ONCE = 64


@dataclass
class Lists:
    """Centres in the rotated space, the rotation, and the common squared length."""

    centres: np.ndarray
    rotation: np.ndarray
    length: float

    def stored(self, vectors: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.length - (vectors**2).sum(axis=1), 0))
        return np.concatenate([vectors, rest[:, None]], axis=1) @ self.rotation

    def asked(self, vectors: np.ndarray) -> np.ndarray:
        return vectors @ self.rotation[:-1]

    def order(self, turned: np.ndarray) -> np.ndarray:
        """Squared distances to all centres, less the vectors' own length."""
        return (self.centres**2).sum(axis=1) - 2 * turned @ self.centres.T


def _fit(sample: np.ndarray, length: float, lists: int) -> Lists:
    """Rotation and centres (Lloyd's rounds) from the sample."""
    random = np.random.default_rng(7)
    rotation, _ = np.linalg.qr(random.standard_normal((sample.shape[1] + 1,) * 2))
    made = Lists(np.zeros((1, len(rotation))), rotation, length)
    turned = made.stored(sample)
    lists = max(1, min(lists, len(turned)))
    made.centres = turned[random.choice(len(turned), lists, replace=False)]
    for _ in range(ROUNDS):
        nearest = made.order(turned).argmin(axis=1)
        filled, at = np.unique(nearest, return_inverse=True)
        sums = np.zeros((len(filled), turned.shape[1]))
        np.add.at(sums, at, turned)
        made.centres[filled] = sums / np.bincount(at)[:, None]
    return made


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of equally long lists as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def usable(vectors: DataFrame, key: str, vector: str, size: int | None = None) -> DataFrame:
    """(id, vec) without repeats: non-null ids, vectors of finite numbers that are not all zero.

    Vectors have ``size`` components, or as many as most have (ties: the fewer).
    """
    whole = vectors.select(F.col(key).alias("id"), F.col(vector).alias("vec")).where(
        F.col("id").isNotNull()
        & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("vec", lambda x: x != 0)
    )
    if size is None:
        most = whole.groupBy(F.size("vec").alias("size")).count().orderBy(F.desc("count"), "size").first()
        size = most["size"] if most else 0
    return whole.where(F.size("vec") == size).distinct()


def nearest(
    vectors: DataFrame,
    asked: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    k: int = 20,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` stored vectors found nearest to each query.

    ``asked`` has the queries, with the same columns. A query's own id is no candidate.
    Score is the inner product in double precision; nearer first, ties to the smaller id.
    Rows with a null id, null, zero or not finite vectors, or another number of components
    than most take no part; repeated rows count once; other columns are not read.

    Of equal vectors only the ``k + 1`` smallest ids can be among the results, so others
    are left out before anything is compared; equal queries are answered once.
    """
    rows = stored(usable(vectors, key, vector), "vectors")
    squares = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    total, length, low = rows.agg(F.count("*"), F.max(squares), F.min(F.size("vec"))).first()
    void = rows.sparkSession.createDataFrame([], f"query_id {rows.schema['id'].dataType.simpleString()}, rank int, vec_id {rows.schema['id'].dataType.simpleString()}, score double")
    if not total:
        return void
    queries = stored(usable(asked, key, vector, low), "queries")
    share = min(1.0, TRAIN_ROWS / total)
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) <= int(share * (1 << 20))).select("vec").toArrow()
    if not sample.num_rows:
        sample = rows.limit(1).select("vec").toArrow()
    known = _matrix(sample["vec"])
    model = _fit(known, length, min(MAX_LISTS, math.isqrt(total)))
    shared = rows.sparkSession.sparkContext.broadcast((model, model.stored(known).astype(np.float32)))
    identity, element = rows.schema["id"].dataType.simpleString(), rows.schema["vec"].dataType.simpleString()

    def assign(batches):
        made, _ = shared.value
        for batch in batches:
            turned = made.stored(_matrix(batch.column(1)))
            lists = made.order(turned).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.int32())], ["id", "vec", "list"])

    same = Window.partitionBy("vec").orderBy("id")
    kept = rows.withColumn("nth", F.row_number().over(same)).where(F.col("nth") <= k + 1).drop("nth")
    base = stored(kept.mapInArrow(assign, f"id {identity}, vec {element}, list int"), "lists")
    grouped = stored(queries.groupBy("vec").agg(F.min("id").alias("qid")), "questions")
    probes = _measured_probes(base, grouped, shared, k)

    sizes = np.zeros(len(model.centres), np.int64)
    for row in base.groupBy("list").count().collect():
        sizes[row["list"]] = row["count"]

    def probe(batches):
        made, seen = shared.value
        seen = seen.astype(np.float64)
        own, home = (seen**2).sum(axis=1), made.order(seen).argmin(axis=1)
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                turned = made.asked(_matrix(part.column(0)))
                order = made.order(turned).argsort(axis=1)
                # As many lists as were measured, and more where they are short.
                held = np.cumsum(sizes[order], axis=1)
                wanted = np.maximum(probes, 1 + (held < 4 * k).sum(axis=1))
                looks = np.arange(order.shape[1]) < wanted[:, None]
                # A bound from the sample vectors of these lists: that of more than are asked for.
                far = own - 2 * turned @ seen.T + (turned**2).sum(axis=1)[:, None]
                rank = order.argsort(axis=1)
                far[np.take_along_axis(rank, np.broadcast_to(home, far.shape), 1) >= wanted[:, None]] = np.inf
                nth = 2 * k + 1
                bound = np.partition(far, nth, axis=1)[:, nth] if far.shape[1] > nth else np.full(len(far), np.inf)
                row, column = np.nonzero(looks)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [part.column(1).take(at), part.column(0).take(at), pa.array(order[row, column], pa.int32()), pa.array(bound[row])],
                    ["id", "vec", "list", "bound"],
                )

    # Lists and the queries that look into them are cut to blocks; all blocks of a list meet.
    looking = stored(grouped.select("vec", "qid").mapInArrow(probe, f"id {identity}, vec {element}, list int, bound double"), "probes")
    blocks = (
        base.groupBy("list").agg(F.ceil(F.count("*") / STORED_BLOCK).cast("int").alias("stored_blocks"))
        .join(looking.groupBy("list").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("query_blocks")), "list")
    )

    def dealt(df: DataFrame, own: str, other: str, asks: bool) -> DataFrame:
        number = F.pmod(F.xxhash64("id"), F.col(own)).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        both = df.join(F.broadcast(blocks), "list").withColumn("mine", number).withColumn("theirs", every)
        x, y = ("theirs", "mine") if asks else ("mine", "theirs")
        bound = F.col("bound") if asks else F.lit(None).cast("double")
        return both.select("list", F.col(x).alias("x"), F.col(y).alias("y"), F.lit(asks).alias("asks"), "id", "vec", bound.alias("bound"))

    rows_of = dealt(base, "stored_blocks", "query_blocks", False).unionByName(
        dealt(looking, "query_blocks", "stored_blocks", True)
    )
    found = map_groups(
        rows_of, ["list", "x", "y"], f"qid {identity}, id {identity}, score double", lambda: _scanner(shared.value[0], k)
    )
    nth = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))
    best = (
        found.withColumn("nth", nth)
        .where(F.col("nth") <= k + 1)
        .groupBy("qid")
        .agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("low"), "id"))).alias("best"))
    )
    named = queries.join(grouped, "vec").select(F.col("id").alias("query_id"), "qid").join(best, "qid")
    own = F.slice(F.filter("best", lambda b: b["id"] != F.col("query_id")), 1, k)
    return named.select("query_id", F.posexplode(own).alias("rank", "b")).select(
        "query_id",
        (F.col("rank") + 1).alias("rank"),
        F.col("b.id").alias("vec_id"),
        (-F.col("b.low")).alias("score"),
    )


def _measured_probes(base: DataFrame, grouped: DataFrame, shared, k: int) -> int:
    """The fewest lists that hold enough of the true neighbours of some queries.

    The queries are those with the smallest hashes of their ids; the driver gets at most
    ``MEASURED`` times ``k`` rows.
    """
    some = grouped.orderBy(F.xxhash64("qid")).limit(MEASURED).toArrow()
    if not some.num_rows:
        return 1
    asked, ids = _matrix(some["vec"]), some["qid"].to_pylist()
    sent = base.sparkSession.sparkContext.broadcast(asked)
    identity = base.schema["id"].dataType.simpleString()

    def brute(batches):
        for batch in batches:
            scores = sent.value @ _matrix(batch.column(1)).T
            nth = min(k + 1, scores.shape[1])
            top = np.argpartition(-scores, nth - 1, axis=1)[:, :nth]
            at = pa.array(top.ravel())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.arange(len(scores)), nth), pa.int32()), batch.column(0).take(at), batch.column(2).take(at), pa.array(np.take_along_axis(scores, top, 1).ravel())],
                ["q", "id", "list", "score"],
            )

    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
    true = (
        base.mapInArrow(brute, f"q int, id {identity}, list int, score double")
        .withColumn("nth", nth)
        .where(F.col("nth") <= k + 1)
        .select("q", "id", "list")
        .toPandas()
    )
    true = true[[ids[q] != i for q, i in zip(true["q"], true["id"])]]
    model = shared.value[0]
    order = model.order(model.asked(asked))
    rank = order.argsort(axis=1).argsort(axis=1)
    needed = np.sort(rank[true["q"], true["list"]]) + 1
    if not len(needed):
        return 1
    return int(needed[min(len(needed) - 1, math.ceil(RECALL * len(needed)) - 1)])


def _scanner(model: Lists, k: int):
    """A function that scans one block of a list for one block of queries."""

    def work(table: pa.Table):
        asks = table["asks"].to_numpy()
        vectors = _matrix(table["vec"])
        base, queries = vectors[~asks], vectors[asks]
        if not len(base) or not len(queries):
            return None
        ids = table["id"].combine_chunks()
        base_ids, query_ids = ids.filter(pa.array(~asks)), ids.filter(pa.array(asks))
        bounds = table["bound"].to_numpy()[asks]
        # Blocks of columns, each contiguous: a scan touches only the blocks it needs.
        turned, width = model.stored(base), model.rotation.shape[0]
        cuts = list(range(0, width, COLUMNS))
        blocks = [np.ascontiguousarray(turned[:, c : c + COLUMNS]) for c in cuts]
        turned_queries, number = model.asked(queries), np.array(base_ids.to_pylist())
        who, what, score = [], [], []
        for low in range(0, len(queries), AT_ONCE):
            part = slice(low, low + AT_ONCE)
            row, column = _scan(blocks, cuts, turned_queries[part], bounds[part], width)
            exact = np.einsum("ij,ij->i", base[column], queries[part][row])
            order = np.lexsort((number[column], -exact, row))
            row, column, exact = row[order], column[order], exact[order]
            nth = np.arange(len(row)) - np.searchsorted(row, row)
            who.append(row[nth <= k] + low)
            what.append(column[nth <= k])
            score.append(exact[nth <= k])
        return pa.RecordBatch.from_arrays(
            [query_ids.take(pa.array(np.concatenate(who))), base_ids.take(pa.array(np.concatenate(what))), pa.array(np.concatenate(score))],
            ["qid", "id", "score"],
        )

    return work


def _scan(
    blocks: list[np.ndarray], cuts: list[int], queries: np.ndarray, bounds: np.ndarray, width: int
) -> tuple[np.ndarray, np.ndarray]:
    """(query, candidate) numbers of the pairs that no test gives up.

    After d of D columns the partial squared distance times D / d estimates the whole; a
    candidate is given up if it is beyond the query's bound by (1 + doubt / sqrt(d))^2.
    After the last column the test is exact, but for rounding.
    """
    own, first = queries[:, :COLUMNS], blocks[0]
    table = (own**2).sum(axis=1)[:, None] + (first**2).sum(axis=1) - 2 * own @ first.T
    row, column = np.nonzero(table <= _reach(bounds, min(COLUMNS, width), width)[:, None])
    partial = table[row, column]
    for cut, block in zip(cuts[1:], blocks[1:]):
        apart = block[column] - queries[row, cut : cut + COLUMNS]
        partial = partial + np.einsum("ij,ij->i", apart, apart)
        near = partial <= _reach(bounds, min(cut + COLUMNS, width), width)[row]
        row, column, partial = row[near], column[near], partial[near]
    return row, column


def _reach(bounds: np.ndarray, seen: int, width: int) -> np.ndarray:
    """The largest partial squared distances that the test lets pass."""
    wide = (1 + DOUBT / math.sqrt(seen)) ** 2 if seen < width else 1 + 1e-6
    return bounds * wide * seen / width + 1e-9
