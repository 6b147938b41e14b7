import pytest
from pyspark.sql import functions as F

from rankweave.operators import analyze as A
from rankweave.operators.maintain import (
    append_segment, compact, delete_docs, index_analysis, index_health, index_stats, reindex, segment_info,
    term_score_bounds, verify_index,
)
from rankweave.operators.query import Or
from rankweave.operators.text_index import FrameIndex, StoredIndex
from rankweave.operators.text_search import match, search, search_count, search_many, term_impacts, term_tops


def texts(spark, rows):
    return spark.createDataFrame(rows, "id int, body string")


def count(index, text):
    return search_count(index, text).first()["n"]


@pytest.fixture()
def base(spark, tmp_path):
    df = texts(
        spark,
        [
            (1, "postgres kernel memory buffer checkpoint internals"),
            (2, "postgres kernel buffer manager"),
            (3, "vacuum freeze and the transaction id wraparound"),
            (4, "kernel scheduler notes"),
        ],
    )
    return FrameIndex(df, "id", "body").write(str(tmp_path / "index"), buckets=4)


def test_writes_are_seen_and_deletes_vanish(spark, base):
    assert count(base, "wraparound") == 1
    more = append_segment(base, texts(spark, [(5, "transaction id wraparound protection"), (6, "kernel panic notes")]))
    assert count(more, "wraparound") == 2
    assert segment_info(more).count() == 2 > segment_info(base).count()
    less = delete_docs(more, spark.createDataFrame([(5,)], "id int"))
    assert count(less, "wraparound") == 1
    back = append_segment(less, texts(spark, [(5, "wraparound again")]))
    assert count(back, "wraparound") == 2
    assert count(StoredIndex.open(spark, base.path), "wraparound") == 2


def test_segments_score_like_one_index(spark, base):
    more = append_segment(base, texts(spark, [(5, "transaction id wraparound"), (6, "kernel panic notes")]))
    more = delete_docs(more, spark.createDataFrame([(2,)], "id int"))
    whole = FrameIndex(more.source, "id", "body")
    query = Or("kernel", "notes", "wraparound")
    expected = [(r["id"], r["score"]) for r in search(whole, query, 10).orderBy("rank").collect()]
    assert [(r["id"], r["score"]) for r in search(more, query, 10).orderBy("rank").collect()] == expected
    packed = compact(more)
    with pytest.raises(RuntimeError, match="not the current"):
        compact(more)
    for index in (packed, reindex(packed, more.source)):
        found = [(r["id"], r["score"]) for r in search(index, query, 10).orderBy("rank").collect()]
        assert found == expected
        assert verify_index(index, more.source).count() == 0
    assert segment_info(packed).first()["dead"] == 0


def test_a_repeated_stream_batch_changes_nothing(spark, base):
    rows = texts(spark, [(7, "kernel seven")])
    once = append_segment(base, rows, batch=("s", 0))
    twice = append_segment(once, rows, batch=("s", 0))
    assert count(twice, "kernel") == count(once, "kernel") == 4
    assert twice.manifest == once.manifest


def test_health(spark, tmp_path):
    df = spark.range(1, 21).select(
        F.col("id").cast("int"), F.when(F.col("id") % 2 == 0, "common beer").otherwise("common wine").alias("body")
    )
    index = FrameIndex(df, "id", "body").write(str(tmp_path / "h"), buckets=2)
    index = delete_docs(index, spark.createDataFrame([(2,), (4,)], "id int"))
    stats = index_stats(index).first()
    assert (stats["segments"], stats["immutable_segments"], stats["dead_documents"]) == (1, 1, 2)
    assert stats["analysis_matches"] is None and stats["analysis_detail"] is None
    assert index_health(index).first()["dead_ratio"] == pytest.approx(0.1)
    with pytest.raises(TypeError):
        index_stats(FrameIndex(df, "id", "body"))


def test_dictionary_drift(spark, tmp_path):
    words = spark.createDataFrame([("数据库", 500, "n"), ("星河", 5, "n"), ("协议", 50, "n")], A.DICTIONARY_SCHEMA)
    df = texts(spark, [(1, "星河数据库协议")])
    index = FrameIndex(df, "id", "body", "words", dictionary=words).write(str(tmp_path / "z"), buckets=2)
    assert index_analysis(index).first()["matches"] is True
    extra = spark.createDataFrame([("星河数据库协议", 1000000, "n")], A.DICTIONARY_SCHEMA)
    more = A.add_words(words, extra)
    drift = index_analysis(index, more).first()
    assert drift["matches"] is False and drift["status"] == "dictionary drift; REINDEX required"
    assert [r["id"] for r in match(index, "数据库").collect()] == [1]
    again = reindex(index, df, more)
    assert index_analysis(again, more).first()["status"] == "matches"
    assert match(again, "数据库").count() == 0 and match(again, "星河数据库协议").count() == 1
    assert index_stats(again, more).first()["analysis_matches"] is True
    plain = FrameIndex(texts(spark, [(1, "alpha beta")]), "id", "body").write(str(tmp_path / "p"))
    row = index_analysis(plain).first()
    assert row["status"] == "not applicable" and row["matches"] is None and row["recorded_version"] is None


def test_verify_finds_damage(spark, base):
    changed = base.source.withColumn("body", F.when(F.col("id") == 4, "kernel planner notes").otherwise(F.col("body")))
    messages = {r["message"] for r in verify_index(base, changed).collect()}
    assert messages == {"posting is not in the text", "text is not in the index"}
    extra = spark.read.parquet(f"{base.path}/doc_stats/segment=1").where("id = 1").withColumn("id", F.lit(99))
    extra.write.mode("append").parquet(f"{base.path}/doc_stats/segment=1")
    assert [r["message"] for r in verify_index(base).collect()] == ["length differs from the sum of frequencies"]


def test_bounds_hold(base):
    bounds = {r["term"]: r["max_score"] for r in term_score_bounds(base).collect()}
    best = search(base, "kernel", 1).first()["score"]
    assert bounds["kernel"] == best


def levels(index):
    return {(r["field"], r["term"], r["tf"]): (r["n"], r["shortest"]) for r in index.live_levels().collect()}


def test_levels_follow_appends_deletes_and_compaction(spark, base):
    more = append_segment(base, texts(spark, [(5, "kernel kernel"), (6, "kernel one two three four five six seven")]))
    held = levels(more)
    assert held["body", "kernel", 1] == (4, 3) and held["body", "kernel", 2] == (1, 2)
    less = delete_docs(more, spark.createDataFrame([(5,), (4,), (99,)], "id int"))
    held = levels(less)
    assert ("body", "kernel", 2) not in held and ("body", "scheduler", 1) not in held
    # A dead document's length stays until the index is compacted.
    assert held["body", "kernel", 1] == (3, 3)
    df = {r["term"]: r["df"] for r in less.term_stats().collect()}
    assert df == {r["term"]: r["df"] for r in FrameIndex(less.source, "id", "body").term_stats().collect()}
    assert less.term_stats(["kernel", "scheduler", "absent"]).collect() == [("kernel", 3)]
    exact = {r["term"]: r["max_score"] for r in term_score_bounds(less).collect()}
    assert exact["kernel"] == search(less, "kernel", 1).first()["score"]
    packed = compact(less)
    assert levels(packed)["body", "kernel", 1] == (3, 4)
    assert {r["term"]: r["max_score"] for r in term_score_bounds(packed).collect()} == exact
    for index in (more, less, packed):
        assert verify_index(index).count() == 0
    back = append_segment(delete_docs(packed, spark.createDataFrame([(6,)], "id int")), texts(spark, [(6, "kernel")]))
    assert back.term_stats(["kernel", "seven"]).collect() == [("kernel", 3)]


def test_levels_of_several_fields(spark, tmp_path):
    rows = [(1, "alpha beta", "alpha"), (2, "beta", "gamma alpha alpha"), (3, None, "alpha"), (4, "", "")]
    df = spark.createDataFrame(rows, "id int, title string, body string")
    frame = FrameIndex(df, "id", [], field_weights={"title": 2.0, "body": 1.0})
    index = frame.write(str(tmp_path / "f"), buckets=3)
    assert {r["term"]: r["df"] for r in index.term_stats().collect()} == {"alpha": 3, "beta": 2, "gamma": 1}
    tops = {r["term"]: (r["df"], r["top"]) for r in term_tops(index).collect()}
    for row in term_impacts(index).collect():
        assert row["tfn"] <= tops[row["term"]][1] + 1e-12
    asked = spark.createDataFrame([(1, "alpha beta"), (2, "gamma"), (3, "absent")], "q int, text string")
    for prune in (False, True):
        found = search_many(index, asked, "q", "text", 2, prune=prune).orderBy("query_id", "rank").collect()
        assert found == search_many(frame, asked, "q", "text", 2).orderBy("query_id", "rank").collect()
    less = delete_docs(index, spark.createDataFrame([(1,)], "id int"))
    assert {r["term"]: r["df"] for r in less.term_stats().collect()} == {"alpha": 2, "beta": 1, "gamma": 1}
    assert verify_index(less).count() == 0


def test_an_empty_index_has_no_levels(spark, tmp_path):
    index = FrameIndex(texts(spark, []), "id", "body").write(str(tmp_path / "e"), buckets=2)
    assert index.term_stats().count() == 0 and term_score_bounds(index).count() == 0
    assert search(index, Or("kernel"), 3).count() == 0
    more = append_segment(index, texts(spark, [(1, "kernel"), (2, None)]))
    assert more.term_stats().collect() == [("kernel", 1)]


def test_damaged_levels_are_found(spark, base):
    path = f"{base.path}/term_levels/segment=1"
    extra = spark.read.parquet(path).where("term = 'kernel'").limit(1)
    extra.write.mode("append").partitionBy("bucket").parquet(path)
    assert [r["message"] for r in verify_index(base).collect()] == ["term levels differ from the postings"]


def test_files_of_a_bucket_grow_in_number(spark, tmp_path, monkeypatch):
    """A segment of many tokens is written in more parts, and reads the same."""
    from rankweave.operators import text_index

    rows = [(i, " ".join(f"w{(i * j) % 97}" for j in range(20))) for i in range(300)]
    docs = spark.createDataFrame(rows, "id long, text string")
    small = FrameIndex(docs, "id", "text").write(f"{tmp_path}/small", buckets=2)
    monkeypatch.setattr(text_index, "FILE_TOKENS", 300)
    large = FrameIndex(docs, "id", "text").write(f"{tmp_path}/large", buckets=2)
    for name in ("postings", "term_levels"):
        files = [sum(1 for _ in tmp_path.glob(f"{kind}/{name}/segment=1/bucket=0/*.parquet")) for kind in ("small", "large")]
        assert files[0] == 1 and files[1] > 3
    assert sorted(map(tuple, small.postings().collect())) == sorted(map(tuple, large.postings().collect()))
    assert sorted(map(tuple, small.term_stats().collect())) == sorted(map(tuple, large.term_stats().collect()))
    gone = delete_docs(large, docs.where("id < 5").select("id"))
    assert verify_index(gone).count() == 0


def test_every_part_of_a_bucket_is_a_task_of_its_own(spark, tmp_path):
    """Parts dealt by a hash of their numbers meet in one task, which then reads several."""
    rows = [(i, " ".join(f"w{(i * j) % 97}" for j in range(20))) for i in range(300)]
    docs = spark.createDataFrame(rows, "id long, text string")
    index = FrameIndex(docs, "id", "text").write(f"{tmp_path}/index", buckets=5, splits=7)
    for name in ("postings", "term_levels"):
        files = [sum(1 for _ in tmp_path.glob(f"index/{name}/segment=1/bucket={b}/*.parquet")) for b in range(5)]
        tasks = {f.name.split("-")[1] for f in tmp_path.glob(f"index/{name}/segment=1/bucket=*/*.parquet")}
        assert sum(files) == len(tasks) and (name == "term_levels" or files == [7] * 5)
    assert verify_index(index, docs).count() == 0


def test_texts_are_compared_in_tasks_that_grow_in_number(spark, tmp_path, monkeypatch):
    """Positions of index and texts meet in a task for about ``FILE_TOKENS`` tokens, not in a fixed number."""
    from rankweave.operators import text_index

    rows = [(i, " ".join(f"w{(i * j) % 97}" for j in range(20))) for i in range(60)]
    docs = spark.createDataFrame(rows, "id long, text string")
    index = FrameIndex(docs, "id", "text").write(f"{tmp_path}/index", buckets=1)
    monkeypatch.setattr(text_index, "FILE_TOKENS", 60)
    changed = docs.where("id <> 5").withColumn("text", F.when(F.col("id") == 7, "w0 w7 other").otherwise(F.col("text")))
    findings = verify_index(index, changed)
    plan = findings._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning(id" in line and "at#" in line]
    assert len(dealt) == 2 and all(", 20), REPARTITION_BY_NUM" in line for line in dealt)
    found = {(r["location"], r["message"]) for r in findings.collect()}
    assert ("doc/7/text/other", "text is not in the index") in found
    assert {m for at, m in found if at.startswith("doc/5/")} == {"posting is not in the text"}
    assert {at.split("/")[1] for at, _ in found} == {"5", "7"}
