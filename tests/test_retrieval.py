import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankweave.operators import evaluate as E
from rankweave.operators.hybrid import check_fusion, hybrid_many, hybrid_search
from rankweave.operators.text_index import FrameIndex
from rankweave.operators.text_search import search
from rankweave.operators.vector import IvfIndex, _list_bounds, _lists_in_reach, build_ivf, ivf_knn, ivf_knn_join, knn, knn_join
from rankweave.session import running_total

VECTORS = [
    (1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [0.0, 0.0, 1.0]),
    (4, [0.9, 0.1, 0.0]), (5, [0.1, 0.9, 0.0]), (6, [0.0, 0.1, 0.9]),
]
RRF = [
    (1, "unrelated gamma", [1.0, 0.0, 0.0]), (2, "unrelated delta", [0.0, 1.0, 0.0]),
    (3, "alpha alpha", [-0.4, 0.9165151, 0.0]), (4, "alpha alpha alpha", [-0.5, 0.8660254, 0.0]),
    (5, "unrelated epsilon", [-0.3, 0.9539392, 0.0]),
]


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame(VECTORS, "id int, emb array<float>")


@pytest.fixture(scope="module")
def rrf(spark):
    return spark.createDataFrame(RRF, "id int, body string, embedding array<float>")


def near(df):
    return [r["id"] for r in df.orderBy("distance", "id").collect()]


def test_exact_and_list_search_agree(spark, vectors, tmp_path):
    assert near(knn(vectors, "id", "emb", [1, 0, 0], 3)) == [1, 4, 5]
    build_ivf(vectors, "id", "emb", lists=3, path=str(tmp_path / "ivf"))
    index = IvfIndex.open(spark, str(tmp_path / "ivf"))
    assert near(ivf_knn(index, [1, 0, 0], 3, probes=3)) == [1, 4, 5]
    assert near(ivf_knn(index, [1, 0, 0], 1, probes=1)) == [1]


def test_rows_without_a_distance_are_left_out(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, None), (3, [1.0, 1.0])], "id int, emb array<float>")
    assert near(knn(df, "id", "emb", [1, 0], 5, "cosine")) == [3]
    queries = spark.createDataFrame([(9, [1.0, 0.0]), (8, None)], "q int, v array<float>")
    rows = knn_join(queries, "q", "v", df, "id", "emb", 5, "cosine").collect()
    assert [(r["query_id"], r["id"]) for r in rows] == [(9, 3)]


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize("block", [100, 2])
def test_join_agrees_with_single_searches(vectors, metric, block):
    joined = knn_join(vectors, "id", "emb", vectors, "id", "emb", 3, metric, block, block).collect()
    for ident, vector in VECTORS:
        single = knn(vectors, "id", "emb", vector, 3, metric).orderBy("distance", "id").collect()
        mine = sorted((r for r in joined if r["query_id"] == ident), key=lambda r: r["rank"])
        assert [(r["id"], r["distance"]) for r in mine] == [(r["id"], r["distance"]) for r in single]


@pytest.mark.parametrize("bad", [[], [1, float("nan")], [1, "x"], [True, 1]])
def test_bad_query_vectors(vectors, bad):
    with pytest.raises(ValueError):
        knn(vectors, "id", "emb", bad, 3)


@pytest.mark.parametrize(
    "candidates, k, weights, limit, expected",
    [
        (1, 1, (0.4, 0.6), 3, [1, 4, 3]),
        (2, 1, (0.5, 0.5), 4, [1, 4, 2, 3]),
        (3, 2, (0.4, 0.6), 5, [1, 2, 4, 5, 3]),
        (3, 4, (0.4, 0.6), 5, [1, 2, 5, 4, 3]),
    ],
)
def test_fusion_orders(rrf, candidates, k, weights, limit, expected):
    index = FrameIndex(rrf, "id", "body")
    hits = hybrid_search(
        index, rrf, "alpha", "embedding", [1, 0, 0], limit=limit, candidate_limit=candidates, rrf_k=k, weights=weights
    )
    assert [r["id"] for r in hits.orderBy(F.col("score").desc(), "id").collect()] == expected


def test_fusion_by_hand(spark):
    df = spark.createDataFrame(
        [(1, "PostgreSQL database kernel internals", [0.9, 0.5, 0.1]), (2, "The database index and query planner", [0.1, 0.0, 0.0]),
         (3, "Storage engine write path", [0.11, 0.01, 0.0])],
        "id int, body string, embedding array<float>",
    )
    index = FrameIndex(df, "id", "body")
    text = {r["id"]: r["rank"] for r in search(index, "database", 10).collect()}
    vec = {i: n for n, i in enumerate(near(knn(df, "id", "embedding", [0.1, 0, 0], 10, "cosine")), 1)}
    rows = hybrid_search(index, df, "database", "embedding", [0.1, 0.0, 0.0], limit=3, rrf_k=1, weights=(0.5, 0.5)).collect()
    for r in rows:
        score = sum(0.5 / (1 + arm[r["id"]]) for arm in (text, vec) if r["id"] in arm)
        assert r["score"] == pytest.approx(score, abs=1e-9)
        assert (r["bm25_rank"], r["vector_rank"]) == (text.get(r["id"]), vec.get(r["id"]))
        assert (r["snippet"] is None) == (r["id"] == 3)
    assert len(rows) == 3


@pytest.mark.parametrize(
    "kwargs",
    [{"limit": 0}, {"limit": True}, {"limit": 1.5}, {"rrf_k": 0}, {"rrf_k": False}, {"rrf_k": "6"},
     {"weights": (1,)}, {"weights": (1, 2, 3)}, {"weights": (0, 0)}, {"weights": (-1, 1)},
     {"weights": (float("inf"), 1)}, {"weights": (float("nan"), 1)}, {"weights": ("a", 1)}, {"weights": (True, 1)}],
)
def test_bad_fusion_arguments(kwargs):
    with pytest.raises(ValueError):
        check_fusion(**{"limit": 5, "rrf_k": 60, "weights": (0.4, 0.6), **kwargs})


def test_scan_guard(rrf, tmp_path):
    index = FrameIndex(rrf, "id", "body")
    with pytest.raises(RuntimeError, match="threshold 5.*'embedding'"):
        hybrid_search(index, rrf, "alpha", "embedding", [1, 0, 0], scan_threshold=5)
    assert hybrid_search(index, rrf, "alpha", "embedding", [1, 0, 0], scan_threshold=6).count() == 5
    lists = build_ivf(rrf, "id", "embedding", lists=2, path=str(tmp_path / "v"), metric="cosine")
    hits = hybrid_search(index, rrf, "alpha", "embedding", [1, 0, 0], scan_threshold=1, vector_index=lists)
    assert hits.count() == 5


def test_many_fusions_agree_with_single_ones(spark, rrf):
    index = FrameIndex(rrf, "id", "body")
    queries = spark.createDataFrame([(1, "alpha", [1.0, 0.0, 0.0]), (2, "gamma", [0.0, 1.0, 0.0])], "q int, t string, v array<float>")
    rows = hybrid_many(index, rrf, "embedding", queries, "q", "t", "v", limit=4).collect()
    for q in queries.collect():
        single = hybrid_search(index, rrf, q["t"], "embedding", q["v"], limit=4).orderBy(F.col("score").desc(), "id").collect()
        mine = sorted((r for r in rows if r["query_id"] == q["q"]), key=lambda r: r["rank"])
        assert [(r["id"], r["score"], r["bm25_rank"], r["vector_rank"]) for r in mine] == [
            (r["id"], r["score"], r["bm25_rank"], r["vector_rank"]) for r in single
        ]


def test_recall(spark):
    hits = spark.createDataFrame([(1, 1, 10), (1, 2, 11), (1, 3, 12), (2, 1, 10), (3, 1, 1)], "query_id int, rank int, id int")
    truth = spark.createDataFrame([(1, 10), (1, 12), (1, 99), (2, 11)], "query_id int, id int")
    out = E.recall_at_k(hits, truth, 2)
    values = {r["query_id"]: r["recall"] for r in out.collect()}
    assert values[1] == pytest.approx(0.5) and values[2] == 0 and math.isnan(values[3])
    mean = E.mean_recall(out).first()
    assert mean["mean_recall"] == pytest.approx(0.25) and mean["n_queries"] == 2


def reference_rbo(a, b, p=0.9, depth=10):
    terms = [(p ** (d - 1), len(set(a[:d]) & set(b[:d])) / d) for d in range(1, depth + 1)]
    return sum(w * x for w, x in terms) / sum(w for w, _ in terms)


def test_rbo(spark):
    a, b = [1, 2, 3, 4, 5], [2, 1, 9, 4]
    frame = lambda ids: spark.createDataFrame([(1, n, i) for n, i in enumerate(ids, 1)], "query_id int, rank int, id int")
    assert E.rbo(frame(a), frame(b)).first()["rbo"] == pytest.approx(reference_rbo(a, b), abs=1e-6)
    assert E.rbo(frame(a), frame([8, 9])).first()["rbo"] == 0


def test_percentiles_and_running_totals(spark):
    rows = [("hot", float(v)) for v in range(40)] + [("cold", 5.0), ("cold", 7.0)]
    df = spark.createDataFrame(rows, "c string, v double").withColumn("g", F.lit("g"))
    per_case, per_class = E.latency_summary(df, "c", "g", "v")
    values = {r["c"]: (r["p50"], r["p95"], r["min"]) for r in per_case.collect()}
    assert values["hot"] == (19.5, pytest.approx(37.05), 0.0)
    assert values["cold"] == (6.0, pytest.approx(6.9), 5.0)
    one = per_class.first()
    assert (one["p50"], one["p95"], one["min"]) == (12.75, pytest.approx(37.05), 0.0)
    total = running_total(df.select("c", "v"), ["c"], ["v"], "v").where("c = 'hot'").agg(F.max("running")).first()[0]
    assert total == sum(range(40))


def test_term_picks(spark):
    stats = spark.createDataFrame([(f"t{i:02d}", i) for i in range(1, 21)], "term string, df long")
    picks = [r["term"] for r in E.pick_terms_by_df(stats, 0.0, 0.5, 3).orderBy("pick").collect()]
    assert picks == ["t03", "t06", "t09"]
    with pytest.raises(ValueError):
        E.pick_terms_by_df(stats, 0, 1, 3, min_df=100)


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_exact_join_through_lists(spark, metric):
    """Clustered vectors with ties: the rows of the join of all pairs, from few lists for each query."""
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(12, 6)) * 20
    rows = [(i, (centers[i % 12] + rng.normal(size=6)).round(1).tolist()) for i in range(600)]
    rows += [(600 + i, rows[0][1]) for i in range(9)] + [(700, None), (701, [0.0] * 6)]
    df = spark.createDataFrame(rows, "id int, v array<double>")
    index = build_ivf(df, "id", "v", 12, metric=metric, centers=centers / (np.linalg.norm(centers, axis=1)[:, None] if metric == "cosine" else 1))
    exact = ivf_knn_join(index, df, "id", "v", 7, probes=None)
    every = knn_join(df, "id", "v", df, "id", "v", 7, metric)
    assert sorted(map(tuple, exact.collect())) == sorted(map(tuple, every.collect()))
    held = np.array([v for _, v in rows[:600]])
    if metric == "cosine":
        held = held / np.linalg.norm(held, axis=1)[:, None]
    reach = _lists_in_reach(held, np.asarray(index.centers), *_list_bounds(index, 7), metric)
    assert np.mean([len(r) for r in reach]) < 4
    few = ivf_knn_join(index, df, "id", "v", 1_000, probes=None)
    assert few.count() == knn_join(df, "id", "v", df, "id", "v", 1_000, metric).count()


def test_every_vector_asks_its_lists(spark, tmp_path):
    """The list join of the plans leaves no vector out, whatever its id."""
    from rankweave.plans.retrieval import ivf_join_probes

    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(40)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    asked = [r["query_id"] for r in ivf_join_probes(spark, str(tmp_path)).collect()]
    assert sorted(set(asked)) == list(range(40))


def test_small_blocks_share_a_task(spark, monkeypatch):
    """Blocks far below the bounds of a task make no more copies of the vectors, and the same rows."""
    from rankweave.operators import vector

    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=3).round(1).tolist()) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, v array<double>")
    met, dealt = vector._met, []
    monkeypatch.setattr(vector, "_met", lambda *args: dealt.append(args[3:5]) or met(*args))
    small = knn_join(df, "id", "v", df, "id", "v", 4, query_block=7, base_block=9)
    assert dealt == [(1, 1)]
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, knn_join(df, "id", "v", df, "id", "v", 4).collect()))
