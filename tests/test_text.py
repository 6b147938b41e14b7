import re

import pytest
from pyspark.sql import functions as F

from rankweave.operators import analyze as A
from rankweave.operators.query import And, Boost, Field, Near, Not, Or, Phrase, Term, Then, analyze_query
from rankweave.operators.text_index import FrameIndex, StoredIndex, build_index, check_field_weights, check_unique_ids
from rankweave.operators import text_search
from rankweave.operators.text_search import (
    bm25_query, headline, lexeme_filter, match, negative_score, score_all, score_inspect, search,
    search_count, search_many,
)

WORDS = [
    ("数据库", 5000, "n"), ("数据", 3000, "n"), ("数据库系统", 800, "n"), ("系统", 4000, "n"),
    ("开源", 900, "n"), ("备份", 700, "n"), ("策略", 900, "n"), ("会议", 2000, "n"), ("讨论", 2500, "v"),
    ("了", 90000, "u"), ("的", 300000, "u"), ("是", 200000, "v"), ("迁移", 600, "v"), ("方案", 1500, "n"),
    ("评审", 400, "v"), ("重要", 3000, "a"), ("决策", 900, "n"), ("内核", 300, "n"), ("与", 20000, "c"),
    ("查询", 900, "v"), ("优化", 800, "v"), ("强大", 900, "a"), ("一个", 30000, "m"), ("中文", 900, "n"),
    ("分词", 100, "n"), ("让", 9000, "v"), ("更", 9000, "d"), ("懂", 900, "v"), ("星河", 10, "n"), ("协议", 900, "n"),
    ("内存", 500, "n"), ("管理", 3000, "v"), ("例行", 50, "v"), ("周报", 20, "n"), ("本周", 100, "t"),
]


def texts(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows, start=1)), "id int, body string")


@pytest.fixture(scope="module")
def dictionary(spark):
    return spark.createDataFrame(WORDS, A.DICTIONARY_SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return texts(
        spark,
        "PostgreSQL database kernel internals",
        "The database index and query planner",
        "Storage engine write path",
    )


@pytest.fixture(scope="module")
def en_docs(spark):
    return texts(
        spark,
        "postgres kernel memory buffer checkpoint internals",
        "postgres kernel buffer manager",
        "vacuum freeze and the transaction id wraparound",
        "kernel scheduler notes",
    )


@pytest.fixture(scope="module")
def mixed(spark):
    return texts(
        spark,
        "PostgreSQL supports full text search",
        "PostgreSQL 是一个强大的开源数据库",
        "PostgreSQL数据库内核与查询优化",
        "中文分词 让数 据库更懂中文",
        "Database kernel and query optimization",
    )


def both(df, fields="body", tmp_path=None, **kw):
    frame = build_index(df, "id", fields, **kw)
    return [frame, frame.write(str(tmp_path), buckets=4, splits=2)]


def found(index, query):
    return sorted(r["id"] for r in match(index, query).collect())


def ranked(index, query, **kw):
    rows = sorted(search(index, query, **kw).collect(), key=lambda r: r["rank"])
    return [r["id"] for r in rows]


def test_unicode_tokens(spark):
    df = texts(spark, "PostgreSQL 是开源数据库, v18!")
    rows = A.tokenize(df, "id", "body").orderBy("pos").collect()
    assert [r["term"] for r in rows] == ["postgresql", *"是开源数据库", "v18"]
    assert [r["pos"] for r in rows] == list(range(8))


def test_whitespace_tokens(spark):
    df = texts(spark, "  A-b  C\tD ", "")
    rows = A.tokenize(df, "id", "body", "whitespace").collect()
    assert [r["term"] for r in rows] == ["a-b", "c", "d"]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("PostgreSQL 是开源数据库", "postgresql/是/开源/数据库"),
        ("会议讨论了数据库的备份策略", "会议/讨论/了/数据库/的/备份/策略"),
        ("数据库迁移方案的评审", "数据库/迁移/方案/的/评审"),
        ("数据库系统的重要决策", "数据库系统/的/重要/决策"),
        ("...", ""),
    ],
)
def test_word_segmentation(spark, dictionary, text, expected):
    out = A.segment_words(texts(spark, text), "id", "body", dictionary).first()
    assert "/".join(out["tokens"]) == expected


def test_word_boundaries_and_phrases(spark, mixed, dictionary, tmp_path):
    by_char = FrameIndex(mixed, "id", "body")
    assert found(by_char, "数据库") == [2, 3, 4]
    for index in both(mixed, tmp_path=tmp_path, analyzer="words", dictionary=dictionary):
        assert found(index, "数据库") == [2, 3]
        assert found(index, "开源数据库") == [2]
        assert found(index, "PostgreSQL数据库") == [3]
        assert found(index, "postgresql") == [1, 2, 3]
        assert found(index, "search") == [1]


def test_word_index_marks_words(spark, mixed, dictionary):
    index = FrameIndex(mixed, "id", "body", "words", dictionary=dictionary)
    rows = search(index, "数据库", snippet="html").collect()
    assert {r["id"] for r in rows} == {2, 3}
    assert all("<mark>数据库</mark>" in r["snippet"] for r in rows)


def test_word_snippets_leave_longer_words_alone(spark, dictionary):
    df = texts(spark, "数据库系统与数据库")
    index = FrameIndex(df, "id", "body", "words", dictionary=dictionary)
    assert search(index, "数据库", snippet="html").first()["snippet"] == "数据库系统与<mark>数据库</mark>"


def test_dictionary_changes(spark, dictionary):
    version = lambda d: tuple(A.dictionary_version(d).first())
    extra = spark.createDataFrame([("星河数据库协议", 1000000, "n")], A.DICTIONARY_SCHEMA)
    more = A.add_words(dictionary, extra)
    assert version(more) != version(dictionary)
    assert version(dictionary.orderBy("freq")) == version(dictionary)
    df = texts(spark, "星河数据库协议")
    assert A.segment_words(df, "id", "body", more).first()["tokens"] == ["星河数据库协议"]
    assert version(A.delete_words(more, extra)) == version(dictionary)


def test_stop_words(spark):
    zh = A.stop_words(spark, "zh")
    assert 150 <= zh.count() <= 200
    auto = {r["word"] for r in A.stop_words(spark).collect()}
    assert {"的", "the"} <= auto
    with pytest.raises(ValueError):
        A.stop_words(spark, "xx")
    tokens = A.tokenize(texts(spark, "the end of the road"), "id", "body")
    kept = A.drop_stop_words(tokens).orderBy("pos").collect()
    assert [(r["pos"], r["term"]) for r in kept] == [(1, "end"), (4, "road")]


def test_dropping_stop_words_from_a_query(spark, docs, dictionary):
    index = FrameIndex(docs, "id", "body")
    assert ranked(index, "the database") == [2]
    assert set(ranked(index, "the database", drop_stop_words=True)) == {1, 2}
    zh = FrameIndex(texts(spark, "系统 的 重要", "数据库 系统"), "id", "body", "words", dictionary=dictionary)
    assert ranked(zh, "的 数据库") == []
    assert ranked(zh, "的 数据库", drop_stop_words=True) == [2]
    assert ranked(zh, "的", drop_stop_words=True) == []


def test_long_tokens(spark, tmp_path):
    df = texts(spark, "a1b2" * 600, "ordinary text with hex " + "a1b2" * 300 + " inside")
    for index in both(df, tmp_path=tmp_path, max_token_bytes=8):
        assert found(index, Term("a1b2a1b2")) == [1, 2]
    tokens = A.tokenize(df, "id", "body")
    assert A.drop_long_tokens(tokens).where("term like 'a1b2%'").count() == 1
    pieces = A.split_long_tokens(A.tokenize(texts(spark, "é" * 5 + " xy"), "id", "body"), 4).orderBy("pos")
    assert [r["term"] for r in pieces.collect()] == ["éé", "éé", "é", "xy"]
    arrays = A.token_arrays(df, "id", "body")
    again = A.split_long_in_arrays(arrays, 8).select("id", F.posexplode("tokens").alias("pos", "term"))
    assert again.exceptAll(A.split_long_tokens(tokens, 8)).count() == 0


def test_stems(spark):
    df = spark.createDataFrame(
        [(w,) for w in "runs running run relational hopping sky happy caresses ponies".split()], "term string"
    )
    stems = {r["term"]: r["stem"] for r in A.stem_vocabulary(df).collect()}
    assert stems["runs"] == stems["running"] == stems["run"] == "run"
    assert (stems["relational"], stems["hopping"], stems["sky"], stems["happy"]) == ("relat", "hop", "sky", "happi")
    assert (stems["caresses"], stems["ponies"]) == ("caress", "poni")


def test_no_stemming_by_default(spark):
    index = FrameIndex(texts(spark, "running vacuum and wrapping"), "id", "body")
    assert ranked(index, "runs") == [] and ranked(index, "running") == [1]
    stems = A.stem_tokens(A.tokenize(texts(spark, "running vacuum"), "id", "body"))
    assert stems.where("term = 'run'").count() == 1


def test_word_stats(spark):
    rows = A.word_stats(texts(spark, "a b a", "a c"), "id", "body").collect()
    assert {(r["word"], r["ndoc"], r["nentry"]) for r in rows} == {("a", 2, 3), ("b", 1, 1), ("c", 1, 1)}


def test_top_k(en_docs, tmp_path):
    for index in both(en_docs, tmp_path=tmp_path):
        assert ranked(index, "kernel buffer", limit=3)[0] == 2
        assert search_count(index, "wraparound").first()["n"] == 1
        assert ranked(index, "kernel", limit=0) == []
        assert ranked(index, "", limit=3) == []


def test_arbitrary_text_is_data(docs):
    index = FrameIndex(docs, "id", "body")
    for text in ["it's \"quoted\"; -- drop", "title:(x", "a^50 OR", "\\", "%_[]"]:
        search(index, text).collect()


def test_phrase_boolean_boost(spark, tmp_path):
    ph = texts(spark, "postgres index internals", "index postgres internals", "postgres has deep internals")
    for index in both(ph, tmp_path=tmp_path / "ph"):
        assert found(index, Phrase("postgres", "index")) == [1]
        assert found(index, And("internals", Not("index"))) == [3]
        assert found(index, Not("index")) == [3]
        assert found(index, Not("missing")) == [1, 2, 3]
        scores = {r["id"]: r["score"] for r in negative_score(index, "postgres index").collect()}
        assert scores[1] == scores[2] < 0 and negative_score(index, "nothing").agg(F.max("score")).first()[0] == 0
    bs = texts(
        spark, "postgres index internals", "index postgres internals", "postgres deep storage notes",
        "postgres " * 5, "internals " * 3, "postgres vacuum", "postgres recovery",
    )
    for index in both(bs, tmp_path=tmp_path / "bs"):
        plain = ranked(index, Or("postgres", "internals"), limit=7)
        boosted = ranked(index, Or(Boost("postgres", 50), "internals"), limit=7)
        assert plain[0] == 5 and boosted[0] == 4 and sorted(plain) == sorted(boosted)


def test_proximity(spark, tmp_path):
    df = texts(spark, "a x x b", "b a", "a b a x x x b", "a a")
    for index in both(df, tmp_path=tmp_path):
        assert found(index, Near("a", "b", 1)) == [2, 3]
        assert found(index, Near("a", "b", 3)) == [1, 2, 3]
        assert found(index, Then("a", "b", 1)) == [3]
        assert found(index, Then("b", "a", 1)) == [2, 3]
        assert found(index, Then("a", "a", 1)) == [4]
        assert found(index, Phrase("a", "a")) == [4]
    with pytest.raises(ValueError):
        Near("a", "b", 0)


def test_field_weights(spark, dictionary, tmp_path):
    df = spark.createDataFrame([(1, "needle", "filler"), (2, "filler", "needle")], "id int, title string, body string")
    for n, make in enumerate([lambda i, p: i, lambda i, p: i.write(p, buckets=2)]):
        heavy = make(FrameIndex(df, "id", [], field_weights={"title": 10, "body": 1}), f"{tmp_path}/a{n}")
        light = make(FrameIndex(df, "id", [], field_weights={"title": 1, "body": 10}), f"{tmp_path}/b{n}")
        one, two = (search(i, "needle", snippet="html").orderBy("rank").collect() for i in (heavy, light))
        assert [r["id"] for r in one] == [1, 2] and [r["id"] for r in two] == [2, 1]
        assert one[0]["score"] == two[0]["score"] > one[1]["score"]
        assert one[0]["snippet"] == "<mark>needle</mark>"
        assert ranked(heavy, Field("title", "needle")) == [1]
        assert ranked(heavy, Field("body", "needle")) == [2]
        with pytest.raises(ValueError, match="unknown field"):
            search(heavy, Field("nope", "needle"))
    with pytest.raises(ValueError, match="multi-column"):
        search(FrameIndex(df, "id", "title"), Field("title", "needle"))
    fw = spark.createDataFrame(
        [(1, "例行周报", "本周讨论了数据库的备份策略"), (2, "数据库迁移方案", "详见附录")], "id int, title string, body string"
    )
    for weights, first in (({"title": 5, "body": 1}, 2), ({"title": 1, "body": 5}, 1)):
        index = FrameIndex(fw, "id", [], "words", weights, dictionary)
        assert ranked(index, "数据库", limit=2)[0] == first


@pytest.mark.parametrize(
    "weights",
    [{"a": 1}, {}, [("a", 1)], {"a": 1, "b": 0}, {"a": 1, "b": -1}, {"a": 1, "b": float("inf")},
     {"a": 1, "b": float("nan")}, {"a": 1, "b": 1e-60}, {"a": 1, "b": 1e60}, {"a": 1, "b": "2"},
     {"a": 1, "b": True}, {"a,": 1, "b": 1}, {"a:": 1, "b": 1}, {"": 1, "b": 1},
     {f"c{i}": 1 for i in range(17)}],
)
def test_bad_field_weights(weights):
    with pytest.raises(ValueError):
        check_field_weights(weights)


def test_snippets(docs):
    index = FrameIndex(docs, "id", "body")
    html = search(index, "database", snippet="html").collect()
    assert all("<mark>database</mark>" in r["snippet"] for r in html) and len(html) == 2
    assert all(r["snippet"] is None for r in search(index, "database", snippet="none").collect())
    tags = search(index, "kernel", snippet="html", begin_tag="[", end_tag="]").first()
    assert tags["snippet"] == "PostgreSQL database [kernel] internals"
    ansi = search(index, "kernel", snippet="ansi", begin_tag="[", end_tag="]").first()["snippet"]
    assert "\x1b[" in ansi and "[kernel]" not in ansi
    with pytest.raises(ValueError):
        search(index, "kernel", snippet="xml")
    marked = headline(docs, "body", ["database"]).where("id = 1").first()["headline"]
    assert marked == "PostgreSQL <b>database</b> kernel internals"


def test_scores_with_and_without_stop_words(spark, dictionary):
    df = texts(spark, "的 数据库", "系统")
    index = FrameIndex(df, "id", "body", "words", dictionary=dictionary)
    row = score_all(index, "的", stop_words=["的"], dense_ratio=1.1).first()
    assert row["score"] == 0 and row["full_score"] > 0
    assert score_inspect(index, "的", stop_words=["的"], dense_ratio=1.1).count() == 0
    assert score_inspect(index, "的").count() == 1
    dense = score_all(FrameIndex(texts(spark, "a b", "a c"), "id", "body"), Or("a", "b"), dense_ratio=1.0)
    values = {r["id"]: (r["score"], r["full_score"]) for r in dense.collect()}
    assert values[2][0] == 0 and values[1][0] > 0 and values[2][1] > 0


def test_any_term_and_filters(spark):
    df = texts(spark, "hello vector search", "postgres bm25 search", "graph query age")
    assert bm25_query(FrameIndex(df, "id", "body"), "search", 2).count() == 2
    ph = texts(spark, "postgres index internals", "index postgres internals", "postgres has deep internals")
    kept = lexeme_filter(ph, "id", "body", Phrase("postgres", "index"))
    assert [r["id"] for r in kept.collect()] == [1] and kept.columns == ["id", "body"]


def test_many_queries_agree_with_single_ones(spark, en_docs, tmp_path):
    queries = spark.createDataFrame(
        [(1, "kernel buffer"), (2, "wraparound the"), (3, "nothing"), (4, "postgres kernel kernel notes")],
        "qid int, q string",
    )
    for index in both(en_docs, tmp_path=tmp_path):
        for kwargs in ({}, {"prune": True}):
            rows = search_many(index, queries, "qid", "q", 2, **kwargs).collect()
            for qid, text in [(r["qid"], r["q"]) for r in queries.collect()]:
                mine = sorted((r["rank"], r["id"], r["score"]) for r in rows if r["query_id"] == qid)
                single = bm25_query(index, text, 2).collect()
                assert [(m[1], m[2]) for m in mine] == sorted(
                    ((r["doc_id"], r["score"]) for r in single), key=lambda p: (-p[1], p[0])
                )
        hits = search_many(index, queries, "qid", "q", 1, snippet="html").where("query_id = 1").first()
        assert hits["snippet"] == "postgres <mark>kernel</mark> <mark>buffer</mark> manager"


def test_pruned_search_looks_up_few_candidates(spark, tmp_path, monkeypatch):
    """Of 150 documents with the rare word, the long ones cannot reach the short ones."""
    rows = [(i, "the " * (i > 9) + ("gem " * 4 if i < 12 else "gem " + "filler " * 40) * (i % 2 == 0)) for i in range(300)]
    docs = spark.createDataFrame(rows, "id long, body string")
    asked = spark.createDataFrame([(1, "the gem")], "qid long, q string")
    hits, scores_of = [], text_search._scores_of

    def counted(weights, of, terms):
        hits.append(of.count())
        return scores_of(weights, of, terms)

    monkeypatch.setattr(text_search, "_scores_of", counted)
    index = FrameIndex(docs, "id", "body").write(str(tmp_path), buckets=2)
    want = sorted(search_many(index, asked, "qid", "q", 5).collect())
    for rows in (text_search.BROADCAST_ROWS, 1):
        monkeypatch.setattr(text_search, "BROADCAST_ROWS", rows)
        hits.clear()
        assert sorted(search_many(index, asked, "qid", "q", 5, prune=True).collect()) == want
        assert hits[:2] == [5, 5] and hits[2] < 10


def test_scores_are_added_up_in_tasks_that_grow_in_number(spark, tmp_path, monkeypatch):
    """Postings are dealt by document to a task for about ``FILE_TOKENS`` tokens, not to a fixed number."""
    from rankweave.operators import text_index

    rows = [(i, " ".join(f"w{(i * j) % 97}" for j in range(20))) for i in range(60)]
    docs = spark.createDataFrame(rows, "id long, body string")
    asked = spark.createDataFrame([(n, f"w0 w{n} w{n * 7}") for n in range(1, 9)], "qid long, q string")
    frame = FrameIndex(docs, "id", "body")
    index = frame.write(str(tmp_path), buckets=1)
    plain = search_many(index, asked, "qid", "q", 5)
    want = sorted(plain.collect())
    assert len(want) == 40
    monkeypatch.setattr(text_index, "FILE_TOKENS", 60)
    for held, tasks in ((index, 20), (frame, None)):
        found = search_many(held, asked, "qid", "q", 5)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(query_id" in plan and not re.search(r"hashpartitioning\(query_id#\d+L?, id#", plan)
        dealt = re.findall(r"hashpartitioning\(id#\d+L?, (\d+)\), REPARTITION_BY_NUM", plan)
        assert dealt and (tasks is None or dealt == [str(tasks)]) and int(dealt[0]) > 2
        assert sorted(found.collect()) == want
        assert sorted(search_many(held, asked, "qid", "q", 5, prune=True).collect()) == want


def test_an_id_with_many_postings_is_not_dealt_to_one_task(spark, monkeypatch):
    """A DataFrame may hold an id, or NULL, often: its scores are added up before they move."""
    from rankweave.operators import text_index

    rows = [(None if i % 2 else i, f"gem w{i % 7} the") for i in range(60)]
    docs = spark.createDataFrame(rows, "id long, body string")
    asked = spark.createDataFrame([(1, "gem the w1"), (2, "w2 w4")], "qid long, q string")
    index = FrameIndex(docs, "id", "body")
    want = set(search_many(index, asked, "qid", "q", 8).collect())
    monkeypatch.setattr(text_index, "FILE_TOKENS", 20)
    found = search_many(index, asked, "qid", "q", 8)
    assert "REPARTITION_BY_NUM" not in found._jdf.queryExecution().executedPlan().toString()
    assert set(found.collect()) == want
    assert set(search_many(index, asked, "qid", "q", 8, prune=True).collect()) == want


def test_pruned_search_adds_up_repeated_and_null_ids(spark):
    rows = [(i, "the " * (i % 7 > 0) + "gem " * (i % 3) + "filler " * (i * 13 % 11)) for i in range(40)]
    rows += rows[::9] * 2 + [(None, "gem the the"), (None, "the")]
    docs = spark.createDataFrame(rows, "id long, body string")
    asked = spark.createDataFrame([(1, "the gem"), (2, "gem filler")], "qid long, q string")
    index = FrameIndex(docs, "id", "body")
    want = set(search_many(index, asked, "qid", "q", 8).collect())
    assert set(search_many(index, asked, "qid", "q", 8, prune=True).collect()) == want


def test_query_analysis(spark, dictionary):
    assert analyze_query(spark, "a b").parts == (Term("a"), Term("b"))
    assert analyze_query(spark, "a-b").words == ("a", "b")
    assert analyze_query(spark, "开源数据库", "words", dictionary).words == ("开源", "数据库")
    assert analyze_query(spark, " -- ") is None


def test_ids_must_be_unique(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "id int, body string")
    with pytest.raises(ValueError, match="unique"):
        check_unique_ids(df, "id")
    with pytest.raises(ValueError, match="unique"):
        build_index(df, "id", "body", path=str(tmp_path / "i"))


def test_create_is_idempotent(spark, docs, tmp_path):
    path = str(tmp_path / "index")
    build_index(docs, "id", "body", path=path)
    again = build_index(docs.limit(1), "id", "body", path=path)
    assert search_count(again, "database").first()["n"] == 2
    with pytest.raises(FileNotFoundError):
        StoredIndex.open(spark, str(tmp_path / "none"))
