"""Queries on vectors, fusion and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankweave.operators import evaluate
from rankweave.operators.hybrid import hybrid_many, hybrid_search
from rankweave.operators.query import Or
from rankweave.operators.text_index import FrameIndex
from rankweave.operators.text_search import query_terms, search_many
from rankweave.operators.vector import IvfIndex, build_ivf, ivf_knn, ivf_knn_join, knn, knn_join
from rankweave.plans.text import TOKENS, WHITESPACE, bm25_sql, many_sql
from rankweave.session import stored
from rankweave.sources import table


def _embeddings(spark, folder) -> DataFrame:
    return table(spark, folder, "embeddings").select("vec_id", "embedding")


def _first_vector(spark, folder) -> list[float]:
    """The query vector of the single searches: the embedding with the lowest id."""
    return list(_embeddings(spark, folder).orderBy("vec_id").select("embedding").first()["embedding"])


def knn_l2(spark, folder):
    near = knn(_embeddings(spark, folder), "vec_id", "embedding", _first_vector(spark, folder), 20, "l2")
    return near.withColumnRenamed("id", "vec_id")


def knn_cosine(spark, folder):
    near = knn(_embeddings(spark, folder), "vec_id", "embedding", _first_vector(spark, folder), 20, "cosine")
    return near.withColumnRenamed("id", "vec_id")


def knn_join_all(spark, folder, metric="l2", **kwargs):
    vectors = _embeddings(spark, folder)
    return knn_join(vectors, "vec_id", "embedding", vectors, "vec_id", "embedding", 5, metric, **kwargs)


def knn_join_cosine(spark, folder):
    return knn_join_all(spark, folder, "cosine")


def knn_join_blocked(spark, folder):
    return knn_join_all(spark, folder, query_block=100, base_block=128)


def ivf_full_probe(spark, folder):
    """With every list probed the index must agree with the exact search."""
    index = build_ivf(_embeddings(spark, folder), "vec_id", "embedding", lists=8)
    near = ivf_knn(index, _first_vector(spark, folder), 20, probes=8)
    return near.withColumnRenamed("id", "vec_id")


def _given_centers(spark, folder, unit: bool = False) -> list[list[float]]:
    """The embeddings with the eight lowest ids, as stated centres."""
    rows = _embeddings(spark, folder).orderBy("vec_id").limit(8).collect()
    points = [[float(x) for x in r["embedding"]] for r in rows]
    return [[x / sum(y * y for y in p) ** 0.5 for x in p] for p in points] if unit else points


def ivf_join_probes(spark, folder):
    """Every vector that has an id against the rows of its two nearest lists."""
    vectors = _embeddings(spark, folder)
    index = build_ivf(vectors, "vec_id", "embedding", 8, centers=_given_centers(spark, folder))
    return ivf_knn_join(index, vectors.where("vec_id IS NOT NULL"), "vec_id", "embedding", 5, probes=2)


def knn_join_pivots(spark, folder):
    """The exact join through lists, each query only where the triangle inequality sends it."""
    vectors = _embeddings(spark, folder)
    index = build_ivf(vectors, "vec_id", "embedding", 8, centers=_given_centers(spark, folder))
    return ivf_knn_join(index, vectors, "vec_id", "embedding", 5, probes=None)


def ivf_recall(spark, folder):
    """Mean share of the true 20 nearest found with 1, 2, 4 and 8 of 8 lists, by every vector whose id 20 divides."""
    vectors = _embeddings(spark, folder)
    asked = vectors.where("vec_id % 20 = 0")
    index = build_ivf(vectors, "vec_id", "embedding", 8, metric="cosine", centers=_given_centers(spark, folder, True))
    truth = stored(knn_join(asked, "vec_id", "embedding", vectors, "vec_id", "embedding", 20, "cosine").select("query_id", "id"), "truth")
    rows = None
    for probes in (1, 2, 4, 8):
        each = evaluate.recall_at_k(ivf_knn_join(index, asked, "vec_id", "embedding", 20, probes), truth, 20)
        one = each.agg(F.round(F.avg("recall"), 6).alias("recall")).select(F.lit(probes).alias("probes"), "recall")
        rows = one if rows is None else rows.unionByName(one)
    return rows


def _joined(spark, folder) -> DataFrame:
    """All documents, with the embedding under their id where there is one."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    vectors = _embeddings(spark, folder).withColumnRenamed("vec_id", "doc_id")
    return docs.join(vectors, "doc_id", "left")


def _joined_lists(both: DataFrame) -> IvfIndex | None:
    """The vectors of ``_joined`` in lists; all are to be probed, for the rows of the exact search."""
    held = both.where("aggregate(embedding, 0D, (s, x) -> s + x * x) > 0")
    rows = held.orderBy("doc_id").select("embedding").limit(8).collect()
    points = [[float(x) for x in r["embedding"]] for r in rows]
    units = [[x / sum(y * y for y in p) ** 0.5 for x in p] for p in points]
    return build_ivf(both, "doc_id", "embedding", len(units), metric="cosine", centers=units) if units else None


def hybrid_rrf(spark, folder):
    both = _joined(spark, folder)
    lists = _joined_lists(both)
    index = FrameIndex(both, "doc_id", "text")
    hits = hybrid_search(
        index, both, Or("the", "of"), "embedding", _first_vector(spark, folder), limit=20, snippet="none",
        vector_index=lists, probes=len(lists.centers) if lists else 1,
    )
    return hits.drop("snippet").withColumnRenamed("id", "doc_id")


def hybrid_many_rrf(spark, folder):
    both = _joined(spark, folder)
    lists = _joined_lists(both)
    index = FrameIndex(both, "doc_id", "text")
    vectors = _embeddings(spark, folder).withColumnRenamed("vec_id", "item_id")
    queries = table(spark, folder, "benchmark").join(vectors, "item_id", "left")
    hits = hybrid_many(
        index, both, "embedding", queries, "item_id", "text", "embedding", limit=10,
        vector_index=lists, probes=len(lists.centers) if lists else 1,
    )
    return hits.drop("snippet")


# -- evaluation ----------------------------------------------------------------


def _rarest_terms(spark, folder, index: FrameIndex) -> DataFrame:
    """(query_id, term): the rarest indexed term of each benchmark text."""
    terms = query_terms(table(spark, folder, "benchmark"), "item_id", "text")
    rarest = F.min(F.struct("df", "term"))
    return (
        terms.join(index.term_stats(), "term").groupBy("query_id").agg(rarest.alias("r")).select("query_id", "r.term")
    )


def _documents_index(spark, folder, analyzer="unicode") -> FrameIndex:
    return FrameIndex(table(spark, folder, "documents").select("doc_id", "text"), "doc_id", "text", analyzer)


def containment(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    terms = _rarest_terms(spark, folder, _documents_index(spark, folder))
    return evaluate.containment_truth(docs, "doc_id", "text", terms)


def recall_at_10(spark, folder):
    hits = search_many(_documents_index(spark, folder), table(spark, folder, "benchmark"), "item_id", "text", 10)
    recalls = evaluate.recall_at_k(hits, containment(spark, folder), 10)
    return recalls.withColumn("recall", F.round("recall", 6))


def rbo_at_10(spark, folder):
    """Agreement of the rankings under two analyzers."""
    queries = table(spark, folder, "benchmark")
    a = search_many(_documents_index(spark, folder), queries, "item_id", "text", 10)
    b = search_many(_documents_index(spark, folder, "whitespace"), queries, "item_id", "text", 10)
    return evaluate.rbo(a, b)


def terms_by_df(spark, folder):
    return evaluate.pick_terms_by_df(_documents_index(spark, folder).term_stats(), 0.25, 0.9, 50)


def _timings(spark, folder) -> DataFrame:
    return table(spark, folder, "events").select(
        "event_type", F.col("user_id"), "value"
    )


def latency_per_case(spark, folder):
    per_case, _ = evaluate.latency_summary(_timings(spark, folder), "user_id", "event_type", "value")
    return per_case.select(
        "event_type", "user_id", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"), F.col("min").alias("low")
    )


def latency_per_class(spark, folder):
    _, per_class = evaluate.latency_summary(_timings(spark, folder), "user_id", "event_type", "value")
    return per_class.withColumnRenamed("min", "low")


QUERIES = {
    "knn_l2": knn_l2,
    "knn_cosine": knn_cosine,
    "knn_join": knn_join_all,
    "knn_join_cosine": knn_join_cosine,
    "knn_join_blocked": knn_join_blocked,
    "knn_join_pivots": knn_join_pivots,
    "ivf_full_probe": ivf_full_probe,
    "ivf_recall": ivf_recall,
    "ivf_join_probes": ivf_join_probes,
    "hybrid_rrf": hybrid_rrf,
    "hybrid_many": hybrid_many_rrf,
    "containment_truth": containment,
    "recall_at_10": recall_at_10,
    "rbo_at_10": rbo_at_10,
    "terms_by_df": terms_by_df,
    "latency_summary": latency_per_case,
    "latency_by_class": latency_per_class,
}

_L2 = "round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) + 0"
_COSINE = "round(list_cosine_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) + 0"


def _knn_sql(distance: str, k: int = 20) -> str:
    return (
        f"SELECT b.vec_id, {distance} AS distance FROM (SELECT * FROM embeddings ORDER BY vec_id LIMIT 1) a, embeddings b "
        f"ORDER BY distance, b.vec_id LIMIT {k}"
    )


def _knn_join_sql(distance: str) -> str:
    return f"""
SELECT query_id, rank::INT AS rank, id, distance FROM (
  SELECT query_id, id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank
  FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, {distance} AS distance FROM embeddings a, embeddings b))
WHERE rank <= 5"""


_BOTH = "docs AS (SELECT doc_id, text, embedding FROM documents LEFT JOIN embeddings ON vec_id = doc_id)"
_RAREST = f"""
words AS (SELECT doc_id AS id, unnest(list_distinct({TOKENS})) AS term FROM documents),
freq AS (SELECT term, count(*) AS df FROM words GROUP BY 1),
asked AS (SELECT item_id AS query_id, unnest(list_distinct({TOKENS})) AS term FROM benchmark),
rarest AS (SELECT query_id, term FROM (SELECT query_id, term,
  row_number() OVER (PARTITION BY query_id ORDER BY df, term) AS r FROM asked JOIN freq USING (term)) WHERE r = 1),
truth AS (SELECT query_id, id FROM rarest JOIN words USING (term))"""
_RBO_TOTAL = sum(0.9**d for d in range(10))


def _lists_sql(unit: bool) -> str:
    """Each vector's lists in order of distance, the centres being the eight lowest ids."""
    point = "embedding::DOUBLE[]"
    if unit:
        point = f"list_transform({point}, lambda x: x / sqrt(list_inner_product({point}, {point})))"
    return f"""
placed AS (SELECT vec_id, embedding, {point} AS p FROM embeddings WHERE embedding IS NOT NULL),
centres AS (SELECT row_number() OVER (ORDER BY vec_id) AS list, p AS c FROM placed ORDER BY vec_id LIMIT 8),
looks AS (SELECT vec_id, list, row_number() OVER (PARTITION BY vec_id ORDER BY list_distance(p, c), list) AS nth
  FROM placed, centres),
homes AS (SELECT vec_id, embedding, list FROM placed JOIN looks USING (vec_id) WHERE nth = 1)"""


def _fused_sql(text: str, near: str, keys: str) -> str:
    return f"""
arms AS (SELECT {keys}, 0.4::DOUBLE / (60 + rank) AS c, rank AS bm25_rank, NULL::BIGINT AS vector_rank FROM {text}
  UNION ALL SELECT {keys}, 0.6::DOUBLE / (60 + rank), NULL, rank FROM {near}),
fused AS (SELECT {keys}, round(sum(c), 9) AS score, max(bm25_rank) AS bm25_rank, max(vector_rank) AS vector_rank
  FROM arms GROUP BY ALL)"""


def _as(ctes: str, *names: str, suffix: str) -> str:
    """The same CTEs a second time under other names."""
    import re

    for name in names:
        ctes = re.sub(rf"\b{name}\b(?!\()", name + suffix, ctes)
    return ctes


_MANY_NAMES = ("lens", "corpus", "tfs", "dfs", "impact", "qterms", "scored", "hits")

ORACLES = {
    "knn_l2": _knn_sql(_L2),
    "knn_cosine": _knn_sql(_COSINE),
    "knn_join": _knn_join_sql(_L2),
    "knn_join_cosine": _knn_join_sql(_COSINE),
    "knn_join_blocked": _knn_join_sql(_L2),
    "knn_join_pivots": _knn_join_sql(_L2),
    "ivf_full_probe": _knn_sql(_L2),
    "ivf_join_probes": f"""
WITH {_lists_sql(False)},
found AS (SELECT a.vec_id AS query_id, b.vec_id AS id, {_L2} AS distance FROM placed a
  JOIN looks USING (vec_id) JOIN homes b USING (list) WHERE nth <= 2)
SELECT query_id, rank::INT AS rank, id, distance FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM found) WHERE rank <= 5""",
    "ivf_recall": f"""
WITH {_lists_sql(True)},
q AS (SELECT * FROM placed WHERE vec_id % 20 = 0),
truth AS (SELECT query_id, id FROM (SELECT a.vec_id AS query_id, b.vec_id AS id,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COSINE}, b.vec_id) AS rank FROM q a, placed b) WHERE rank <= 20),
tried AS (SELECT unnest([1, 2, 4, 8]) AS probes),
found AS (SELECT probes, a.vec_id AS query_id, b.vec_id AS id,
  row_number() OVER (PARTITION BY a.vec_id, probes ORDER BY {_COSINE}, b.vec_id) AS rank
  FROM q a JOIN looks USING (vec_id) JOIN homes b USING (list) JOIN tried ON nth <= probes)
SELECT probes, round(count(truth.id) / (20.0 * (SELECT count(*) FROM q)), 6) AS recall
FROM found LEFT JOIN truth ON found.query_id = truth.query_id AND found.id = truth.id AND rank <= 20
GROUP BY 1""",
    "hybrid_rrf": f"""
WITH {_BOTH}, {bm25_sql('docs')},
t AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM
  (SELECT id, round(sum(s), 6) AS score FROM impact WHERE term IN ('the', 'of') GROUP BY 1) ORDER BY rank LIMIT 100),
v AS (SELECT id, row_number() OVER (ORDER BY distance, id) AS rank FROM
  (SELECT b.doc_id AS id, {_COSINE} AS distance FROM (SELECT * FROM embeddings ORDER BY vec_id LIMIT 1) a, docs b WHERE b.embedding IS NOT NULL)
  ORDER BY rank LIMIT 100),
{_fused_sql('t', 'v', 'id')}
SELECT id AS doc_id, score, bm25_rank, vector_rank FROM fused ORDER BY score DESC, id LIMIT 20""",
    "hybrid_many": f"""
WITH {_BOTH}, asks AS (SELECT item_id, text, embedding FROM benchmark LEFT JOIN embeddings ON vec_id = item_id),
{many_sql(50, source='docs', queries='asks')},
v AS (SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM
  (SELECT a.item_id AS query_id, b.doc_id AS id, {_COSINE} AS distance FROM asks a, docs b
   WHERE a.embedding IS NOT NULL AND b.embedding IS NOT NULL)) WHERE rank <= 50),
{_fused_sql('hits', 'v', 'query_id, id')}
SELECT query_id, rank::INT AS rank, id, score, bm25_rank, vector_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM fused) WHERE rank <= 10""",
    "containment_truth": f"WITH {_RAREST} SELECT query_id, id FROM truth",
    "recall_at_10": f"""
WITH {many_sql(10)}, {_RAREST},
sizes AS (SELECT query_id, count(*) AS n FROM truth GROUP BY 1),
found AS (SELECT query_id, count(*) AS found FROM hits JOIN truth USING (query_id, id) GROUP BY 1)
SELECT query_id, round(coalesce(found, 0) / least(10, n), 6) AS recall
FROM sizes LEFT JOIN found USING (query_id)""",
    "rbo_at_10": f"""
WITH {many_sql(10)},
{_as(many_sql(10, tokens=WHITESPACE).replace('toks AS (', 'wtoks AS (', 1).replace('FROM toks', 'FROM wtoks'), *_MANY_NAMES, suffix='_w')},
depth AS (SELECT unnest(range(1, 11)) AS d),
asked AS (SELECT DISTINCT query_id FROM hits UNION SELECT DISTINCT query_id FROM hits_w),
agree AS (SELECT query_id, d, count(*) AS n FROM hits a JOIN hits_w b USING (query_id, id) JOIN depth ON a.rank <= d AND b.rank <= d GROUP BY 1, 2)
SELECT query_id, round(coalesce(sum(pow(0.9, d - 1) * n / d), 0) / {_RBO_TOTAL!r}, 6) AS rbo
FROM asked LEFT JOIN agree USING (query_id) GROUP BY 1""",
    "terms_by_df": f"""
WITH words AS (SELECT doc_id, unnest(list_distinct({TOKENS})) AS term FROM documents),
freq AS (SELECT term, count(*) AS df FROM words GROUP BY 1 HAVING count(*) >= 3),
placed AS (SELECT term, df, row_number() OVER (ORDER BY df, term) - 1 AS place, count(*) OVER () AS n FROM freq),
band AS (SELECT DISTINCT floor(n * 0.25::DOUBLE)::BIGINT AS lo,
  greatest(floor(n * 0.25::DOUBLE)::BIGINT + 1, floor(n * 0.9::DOUBLE)::BIGINT) AS hi FROM placed),
picks AS (SELECT i AS pick, lo + least(i * greatest(1, (hi - lo) // 50), hi - lo - 1) AS place FROM band, range(50) r(i))
SELECT pick::INT AS pick, term, df FROM picks JOIN placed USING (place)""",
    "latency_summary": """
SELECT event_type, user_id, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, min(value) AS low
FROM events WHERE value IS NOT NULL GROUP BY 1, 2""",
    "latency_by_class": """
SELECT event_type, round(avg(p50), 6) AS p50, round(max(p95), 6) AS p95, min(low) AS low FROM (
  SELECT event_type, user_id, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, min(value) AS low
  FROM events WHERE value IS NOT NULL GROUP BY 1, 2) GROUP BY 1""",
}
