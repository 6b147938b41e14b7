"""Headline timings over the supplied tables; prints one JSON line.

``BENCH_SF_DIR`` names the folder of the tables, ``BENCH_CPUS`` the cores. The tables are
copied into several files each before the clock starts. Stored
indexes are built below the session's shared folder. ``BENCH_QUERIES`` (names with
commas) restricts the run while iterating.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame  # noqa: E402

from rankweave import plans  # noqa: E402
from rankweave.operators.maintain import append_segment  # noqa: E402
from rankweave.operators.query import And, Or, Term  # noqa: E402
from rankweave.operators.text_index import FrameIndex  # noqa: E402
from rankweave.operators.text_search import search, search_many  # noqa: E402
from rankweave.session import local_session, work_path  # noqa: E402
from rankweave.sources import TABLES, table  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
ONLY = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n]
REPEATS = 5

REGISTERED = [
    "tokenize_unicode", "word_stats", "search_bm25_topk", "bool_query", "phrase_query", "near_query",
    "bm25_query_or", "negative_score", "highlight", "search_many", "search_many_pruned", "bm25f_weighted",
    "verify_index", "term_score_bounds", "knn_l2", "knn_cosine", "knn_join", "hybrid_rrf", "hybrid_many",
    "recall_at_10", "rbo_at_10", "terms_by_df", "latency_summary", "time_bucket_agg", "partition_plan",
    "version_read", "version_diff", "version_merge", "prov_distinct_formula", "prov_join_count",
    "prov_probability", "queue_read", "json_schema_summary", "xml_table", "trigram_similarity", "trigram_join",
    "hierarchy_rollup", "unaccent", "graph_two_hop", "graph_traverse", "classify_batch", "assert_tables",
]


def drain(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return time.perf_counter() - start


def in_files(spark) -> str:
    """A copy of the tables in several files each, as a cluster's tables are.

    The supplied files have one row group, which is one task however many cores wait.
    """
    target = work_path(spark, "tables")
    for name in TABLES:
        table(spark, FOLDER, name).repartition(2 * CPUS).write.parquet(f"{target}/{name}.parquet")
    return target


def main() -> None:
    spark = local_session(CPUS)
    spark.sparkContext.setLogLevel("ERROR")
    folder = in_files(spark)
    docs = table(spark, folder, "documents").select("doc_id", "text")
    n_docs = docs.count()
    queries, latency, seconds = plans.all_queries(), {}, {}
    # Runs outside the clock start the workers and compile the common code.
    drain(queries["search_bm25_topk"](spark, folder))

    if not ONLY or "index" in ONLY:
        built = {}

        def build() -> None:
            built["index"] = FrameIndex(docs, "doc_id", "text").write(work_path(spark, "bench"), buckets=16)

        build()
        seconds["index_build"] = timed(build)
        index = built["index"]
        more = docs.selectExpr("doc_id + 1000000000 as doc_id", "text")
        singles = {
            "rare_term": Term("quick"),
            "common_term": Term("the"),
            "three_terms": And("the", "of", "and"),
            "any_of_three": Or("the", "la", "und"),
        }
        for name, query in singles.items():
            search(index, query, 10).collect()
            times = [timed(lambda: search(index, query, 10).collect()) for _ in range(REPEATS)]
            seconds[f"stored_{name}"] = latency[name] = statistics.median(times)
        asked = table(spark, folder, "benchmark")
        seconds["stored_search_many"] = timed(lambda: drain(search_many(index, asked, "item_id", "text", 10)))
        seconds["stored_search_many_pruned"] = timed(
            lambda: drain(search_many(index, asked, "item_id", "text", 10, prune=True))
        )
        seconds["index_ingest"] = timed(lambda: append_segment(index, more))

    for name in ONLY or REGISTERED:
        if name in queries:
            seconds[name] = timed(lambda: drain(queries[name](spark, folder)))

    line = {
        "metric": "headline queries, total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": {n: round(s, 3) for n, s in seconds.items()},
        "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
    }
    if "index_build" in seconds:
        line["rates"] = {
            "index_build_docs_per_sec": round(n_docs / seconds["index_build"], 1),
            "ingest_docs_per_sec": round(n_docs / seconds["index_ingest"], 1),
            "search_many_queries_per_sec": round(
                table(spark, folder, "benchmark").count() / seconds["stored_search_many"], 1
            ),
        }
    print(json.dumps(line), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
