"""Queries on text: tokens, matching, ranking, index maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.functions import stopwords
from rankweave.operators import analyze
from rankweave.operators.maintain import (
    append_segment, compact, delete_docs, index_health, segment_info, term_score_bounds, verify_index,
)
from rankweave.operators.query import And, Boost, Field, Near, Not, Or, Phrase, Then
from rankweave.operators.text_index import FrameIndex, StoredIndex
from rankweave.operators.text_search import (
    bm25_query, headline, lexeme_filter, match, negative_score, score_all, score_inspect, search,
    search_count, search_many,
)
from rankweave.session import work_path
from rankweave.sources import table

TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
WHITESPACE = r"list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')"
STOPS = ", ".join("'" + w + "'" for w in stopwords.words("auto"))


def positions_sql(tokens: str = TOKENS, source: str = "documents", key: str = "doc_id") -> str:
    """CTE body: one row (id, pos, term) per token."""
    return (
        f"SELECT id, unnest(toks) AS term, generate_subscripts(toks, 1) - 1 AS pos "
        f"FROM (SELECT {key} AS id, {tokens} AS toks FROM {source})"
    )


def bm25_sql(source: str = "documents", key: str = "doc_id", tokens: str = TOKENS) -> str:
    """CTEs lens, corpus, tfs, dfs, impact(id, term, s): BM25 of every posting."""
    return f"""
toks AS (SELECT {key} AS id, {tokens} AS toks FROM {source}),
lens AS (SELECT id, len(toks) AS len FROM toks),
corpus AS (SELECT count(*) AS n, avg(len) AS a FROM lens),
tfs AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(toks) AS term FROM toks) GROUP BY 1, 2),
dfs AS (SELECT term, count(*) AS df FROM tfs GROUP BY 1),
impact AS (SELECT id, term, df, n,
  ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / a)) AS s
  FROM tfs JOIN dfs USING (term) JOIN lens USING (id), corpus)"""


def any_term_sql(terms: list[str], k: int | None = None) -> str:
    """Any-term BM25 over documents, as (doc_id, score)."""
    listed = ", ".join(f"'{t}'" for t in terms)
    limit = f" ORDER BY score DESC, doc_id LIMIT {k}" if k else ""
    return (
        f"WITH {bm25_sql()} SELECT id AS doc_id, round(sum(s), 6) AS score FROM impact "
        f"WHERE term IN ({listed}) GROUP BY 1{limit}"
    )


def many_sql(k: int, tokens: str = TOKENS, source: str = "documents", key: str = "doc_id", queries: str = "benchmark",
             query_key: str = "item_id") -> str:
    """CTEs ending in hits(query_id, rank, id, score): top k of every query text."""
    return f"""{bm25_sql(source, key, tokens)},
qterms AS (SELECT DISTINCT query_id, unnest(toks) AS term FROM (SELECT {query_key} AS query_id, {tokens} AS toks FROM {queries})),
scored AS (SELECT query_id, id, round(sum(s), 6) AS score FROM qterms JOIN impact USING (term) GROUP BY 1, 2),
hits AS (SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, id, score FROM scored) WHERE rank <= {k})"""


def marked_sql(terms: list[str], begin: str, end: str, col: str = "text") -> str:
    listed = ", ".join(f"'{t}'" for t in terms)
    return (
        rf"array_to_string(list_transform(regexp_extract_all({col}, '[\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+'), "
        f"lambda x: CASE WHEN lower(x) IN ({listed}) THEN '{begin}' || x || '{end}' ELSE x END), '')"
    )


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def _index(spark: SparkSession, folder: str) -> FrameIndex:
    return FrameIndex(_docs(spark, folder).select("doc_id", "text"), "doc_id", "text")


def _as_doc(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("id", "doc_id")


def tokenize_unicode(spark, folder):
    docs = _docs(spark, folder).select("doc_id", "text")
    return _as_doc(analyze.tokenize(docs, "doc_id", "text"))


def tokenize_whitespace(spark, folder):
    docs = _docs(spark, folder).select("doc_id", "text")
    return _as_doc(analyze.tokenize(docs, "doc_id", "text", "whitespace"))


def word_stats(spark, folder):
    docs = _docs(spark, folder).select("doc_id", "text")
    return analyze.word_stats(docs, "doc_id", "text")


def strip_stop_words(spark, folder):
    return analyze.drop_stop_words(tokenize_unicode(spark, folder).withColumnRenamed("doc_id", "id")).transform(_as_doc)


def split_long_tokens(spark, folder):
    docs = _docs(spark, folder).select("doc_id", "text")
    arrays = analyze.split_long_in_arrays(analyze.token_arrays(docs, "doc_id", "text"), 8)
    pieces = arrays.select(F.posexplode("tokens").alias("pos", "term"))
    return pieces.groupBy("term").agg(F.count("*").alias("n"), F.sum("pos").cast("long").alias("pos_sum"))


def match_term(spark, folder):
    return _as_doc(match(_index(spark, folder), "the"))


BOOL = And(Or("the", "der", "que"), Not("of"), Not(And("le", "la")))


def bool_query(spark, folder):
    return _as_doc(match(_index(spark, folder), BOOL))


def phrase_query(spark, folder):
    return _as_doc(match(_index(spark, folder), Phrase("of", "the")))


def near_query(spark, folder):
    return _as_doc(match(_index(spark, folder), Near("of", "the", 3)))


def then_query(spark, folder):
    return _as_doc(match(_index(spark, folder), Then("of", "the", 3)))


def count_matches(spark, folder):
    return search_count(_index(spark, folder), Or("the", "la"))


def lexeme_filter_rows(spark, folder):
    docs = _docs(spark, folder).select("doc_id", "text", "lang", "source")
    kept = lexeme_filter(docs, "doc_id", "text", And(Phrase("of", "the"), Not("la")))
    return kept.select("doc_id", "lang", "source")


def lexeme_headline(spark, folder):
    docs = _docs(spark, folder).select("doc_id", "text")
    return headline(docs, "text", ["und", "der"]).select("doc_id", "headline")


def search_bm25_topk(spark, folder):
    hits = search(_index(spark, folder), Or("the", "of"), limit=20)
    return hits.select(F.col("id").alias("doc_id"), "score")


def search_boost(spark, folder):
    hits = search(_index(spark, folder), Or(Boost("der", 50), "the"), limit=50)
    return hits.select(F.col("id").alias("doc_id"), "rank", "score")


def bm25_query_or(spark, folder):
    return bm25_query(_index(spark, folder), "The quick la, und der", 100)


def score_vs_full_score(spark, folder):
    scored = score_all(
        _index(spark, folder), Or("the", "on", "er", "la"), stop_words=stopwords.words("en"), dense_ratio=0.5
    )
    return _as_doc(scored)


def score_terms(spark, folder):
    return score_inspect(
        _index(spark, folder), Or("the", "on", "er", "la", "und"), stop_words=stopwords.words("en"), dense_ratio=0.5
    )


def negative_scores(spark, folder):
    return _as_doc(negative_score(_index(spark, folder), "of the la"))


def _benchmark(spark, folder):
    return table(spark, folder, "benchmark")


def many(spark, folder):
    return search_many(_index(spark, folder), _benchmark(spark, folder), "item_id", "text", 10).drop("snippet")


def many_pruned(spark, folder):
    hits = search_many(_index(spark, folder), _benchmark(spark, folder), "item_id", "text", 10, prune=True)
    return hits.drop("snippet")


def _weighted(spark, folder):
    talk = table(spark, folder, "conversations").select(
        F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "role", "text"
    )
    return FrameIndex(talk, "id", [], field_weights={"role": 3.0, "text": 1.0})


def bm25f_weighted(spark, folder):
    return search(_weighted(spark, folder), Or("user", "the", "la"), limit=100).drop("snippet")


FIELD_SCOPED = And(Field("role", "assistant"), Field("text", Or("the", "la")))


def field_scoped(spark, folder):
    return search(_weighted(spark, folder), FIELD_SCOPED, limit=100).drop("snippet")


def drop_stop_search(spark, folder):
    hits = search(_index(spark, folder), "the reer of", limit=50, drop_stop_words=True)
    return hits.select(F.col("id").alias("doc_id"), "rank", "score")


def highlight_all(spark, folder):
    from rankweave.functions.text import highlight

    docs = _docs(spark, folder).select("doc_id", "text")
    return docs.select("doc_id", highlight(F.col("text"), ["the", "of", "la"]).alias("marked"))


def snippet_modes(spark, folder):
    index, query = _index(spark, folder), Or("und", "der")
    parts = [
        search(index, query, 10, snippet=mode, begin_tag=tag and f"[{tag}", end_tag=tag and "]")
        .withColumn("mode", F.lit(mode + (tag or "")))
        for mode, tag in (("none", None), ("html", None), ("html", "x"), ("ansi", "x"))
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumnRenamed("id", "doc_id")


# -- stored indexes ------------------------------------------------------------


def _stored(spark, folder, rows: DataFrame) -> StoredIndex:
    index = FrameIndex(rows.select("doc_id", "text"), "doc_id", "text")
    return index.write(work_path(spark, "index"), buckets=8, splits=2)


def _built_in_two_steps(spark, folder) -> StoredIndex:
    docs = _docs(spark, folder)
    first = _stored(spark, folder, docs.where("coalesce(lang, '') in ('en', 'fr')"))
    return append_segment(first, docs.where("coalesce(lang, '') not in ('en', 'fr')").select("doc_id", "text"))


def index_append(spark, folder):
    hits = search(_built_in_two_steps(spark, folder), Or("the", "la", "und"), limit=100)
    return hits.select(F.col("id").alias("doc_id"), "rank", "score")


def index_delete(spark, folder):
    index = _built_in_two_steps(spark, folder)
    docs = _docs(spark, folder)
    first_source = docs.select(F.min("source")).scalar()
    gone = docs.where(F.col("source") == first_source).select("doc_id")
    hits = search(delete_docs(index, gone), Or("the", "la", "und"), limit=100)
    return hits.select(F.col("id").alias("doc_id"), "rank", "score")


def stored_bool_query(spark, folder):
    return _as_doc(match(_built_in_two_steps(spark, folder), BOOL))


def stored_phrase(spark, folder):
    return _as_doc(match(_built_in_two_steps(spark, folder), Phrase("of", "the")))


def stored_near(spark, folder):
    return _as_doc(match(_built_in_two_steps(spark, folder), Near("of", "the", 3)))


def stored_negative_score(spark, folder):
    return _as_doc(negative_score(_built_in_two_steps(spark, folder), "of the la"))


OR_NOT = Or("the", Not("of"))


def stored_or_not(spark, folder):
    """A query that matches without its terms, ranked."""
    return _as_doc(search(_built_in_two_steps(spark, folder), OR_NOT, limit=50)).drop("snippet")


def stored_score_all(spark, folder):
    return _as_doc(score_all(_built_in_two_steps(spark, folder), OR_NOT))


def _with_deletes(spark, folder) -> StoredIndex:
    docs = _docs(spark, folder)
    return delete_docs(_built_in_two_steps(spark, folder), docs.where("lang = 'de' or n_chars > 5000").select("doc_id"))


def stored_term_stats(spark, folder):
    """Document frequencies after an append and a delete, out of the term levels."""
    return _with_deletes(spark, folder).term_stats()


def stored_score_bounds(spark, folder):
    return term_score_bounds(_built_in_two_steps(spark, folder))


def stored_bounds_after_delete(spark, folder):
    return term_score_bounds(_with_deletes(spark, folder))


def stored_many(spark, folder):
    index = _with_deletes(spark, folder)
    return search_many(index, _benchmark(spark, folder), "item_id", "text", 10).drop("snippet")


def stored_many_pruned(spark, folder):
    index = _with_deletes(spark, folder)
    return search_many(index, _benchmark(spark, folder), "item_id", "text", 10, prune=True).drop("snippet")


def stored_field_scoped(spark, folder):
    index = _weighted(spark, folder).write(work_path(spark, "index"), buckets=8, splits=2)
    return search(index, FIELD_SCOPED, limit=100).drop("snippet")


def index_stats(spark, folder):
    return index_health(_with_deletes(spark, folder)).drop("analysis_matches", "analysis_detail")


def index_segments(spark, folder):
    return segment_info(_with_deletes(spark, folder))


def index_compact(spark, folder):
    index = compact(_with_deletes(spark, folder))
    return segment_info(index).drop("segment")


def index_verified(spark, folder):
    """Findings of a check against the texts, next to what was checked."""
    docs = _docs(spark, folder).select("doc_id", "text")
    index = _built_in_two_steps(spark, folder)
    held = index.postings().agg(F.count("*").alias("n_postings"), F.sum("tf").cast("long").alias("n_tokens"))
    findings = verify_index(index, docs).agg(F.count("*")).scalar()
    return held.withColumn("n_findings", findings)


def score_bounds(spark, folder):
    return term_score_bounds(_index(spark, folder))


QUERIES = {
    "tokenize_unicode": tokenize_unicode,
    "tokenize_whitespace": tokenize_whitespace,
    "word_stats": word_stats,
    "strip_stop_words": strip_stop_words,
    "split_long_tokens": split_long_tokens,
    "match_term": match_term,
    "bool_query": bool_query,
    "stored_bool_query": stored_bool_query,
    "stored_phrase": stored_phrase,
    "stored_near": stored_near,
    "stored_negative_score": stored_negative_score,
    "stored_or_not": stored_or_not,
    "stored_score_all": stored_score_all,
    "stored_term_stats": stored_term_stats,
    "stored_term_bounds": stored_score_bounds,
    "stored_bounds_after_delete": stored_bounds_after_delete,
    "stored_search_many": stored_many,
    "stored_search_many_pruned": stored_many_pruned,
    "stored_field_scoped": stored_field_scoped,
    "phrase_query": phrase_query,
    "near_query": near_query,
    "then_query": then_query,
    "search_count": count_matches,
    "lexeme_filter": lexeme_filter_rows,
    "lexeme_headline": lexeme_headline,
    "search_bm25_topk": search_bm25_topk,
    "search_boost": search_boost,
    "bm25_query_or": bm25_query_or,
    "score_vs_full_score": score_vs_full_score,
    "score_inspect": score_terms,
    "negative_score": negative_scores,
    "search_many": many,
    "search_many_pruned": many_pruned,
    "bm25f_weighted": bm25f_weighted,
    "field_scoped": field_scoped,
    "drop_stop_search": drop_stop_search,
    "highlight": highlight_all,
    "snippet_modes": snippet_modes,
    "index_append_equals_rebuild": index_append,
    "index_delete": index_delete,
    "index_stats": index_stats,
    "segment_info": index_segments,
    "index_compact": index_compact,
    "verify_index": index_verified,
    "term_score_bounds": score_bounds,
}

_POS = positions_sql()
_PAIRS = (
    "JOIN p b ON a.id = b.id AND a.term = 'of' AND b.term = 'the' AND "
)
_STOP_EN = ", ".join("'" + w + "'" for w in stopwords.words("en"))


def _weighted_sql(select: str) -> str:
    return rf"""
WITH talk AS (SELECT conv_id || '/' || turn AS id, role, text FROM conversations),
toks AS (SELECT id, 'role' AS field, 3.0::DOUBLE AS w, regexp_extract_all(lower(role), '[\p{{L}}\p{{N}}]+') AS t FROM talk
  UNION ALL SELECT id, 'text', 1.0::DOUBLE, {TOKENS} FROM talk),
lens AS (SELECT id, field, w, len(t) AS len FROM toks),
means AS (SELECT field, avg(len) AS a, count(*) AS n FROM lens GROUP BY 1),
tfs AS (SELECT id, field, term, count(*) AS tf FROM (SELECT id, field, unnest(t) AS term FROM toks) GROUP BY 1, 2, 3),
dfs AS (SELECT term, count(DISTINCT id) AS df FROM tfs GROUP BY 1),
wtf AS (SELECT id, term, sum(w * tf / (0.25 + 0.75 * len / a)) AS x, any_value(n) AS n,
  bool_or(field = 'role') AS in_role, bool_or(field = 'text') AS in_text,
  coalesce(sum(CASE WHEN field = 'text' THEN w * tf / (0.25 + 0.75 * len / a) END), 0) AS x_text,
  coalesce(sum(CASE WHEN field = 'role' THEN w * tf / (0.25 + 0.75 * len / a) END), 0) AS x_role
  FROM tfs JOIN lens USING (id, field) JOIN means USING (field) GROUP BY 1, 2),
imp AS (SELECT *, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM wtf JOIN dfs USING (term)),
{select}
SELECT id, row_number() OVER (ORDER BY score DESC, id)::INT AS rank, score FROM out ORDER BY score DESC, id LIMIT 100"""


ORACLES = {
    "tokenize_unicode": f"SELECT id AS doc_id, pos::INT AS pos, term FROM ({_POS})",
    "tokenize_whitespace": f"SELECT id AS doc_id, pos::INT AS pos, term FROM ({positions_sql(WHITESPACE)})",
    "word_stats": f"SELECT term AS word, count(DISTINCT id) AS ndoc, count(*) AS nentry FROM ({_POS}) GROUP BY 1",
    "strip_stop_words": f"SELECT id AS doc_id, pos::INT AS pos, term FROM ({_POS}) WHERE term NOT IN ({STOPS})",
    "split_long_tokens": f"""
WITH p AS ({_POS}),
vocabulary AS (SELECT term, string_split(list_reduce(string_split(term, ''), lambda a, c:
    CASE WHEN strlen(regexp_extract(a, '[^ ]*$')) + strlen(c) > 8 THEN a || ' ' || c ELSE a || c END), ' ') AS pieces
  FROM (SELECT DISTINCT term FROM p)),
cut AS (SELECT id, pos, generate_subscripts(pieces, 1) AS piece, unnest(pieces) AS term FROM p JOIN vocabulary USING (term)),
placed AS (SELECT term, row_number() OVER (PARTITION BY id ORDER BY pos, piece) - 1 AS place FROM cut)
SELECT term, count(*) AS n, sum(place)::BIGINT AS pos_sum FROM placed GROUP BY 1""",
    "match_term": f"SELECT DISTINCT id AS doc_id FROM ({_POS}) WHERE term = 'the'",
    "bool_query": f"""
SELECT doc_id FROM (SELECT doc_id, {TOKENS} AS t FROM documents)
WHERE (list_contains(t, 'the') OR list_contains(t, 'der') OR list_contains(t, 'que'))
  AND NOT list_contains(t, 'of') AND NOT (list_contains(t, 'le') AND list_contains(t, 'la'))""",
    "phrase_query": f"WITH p AS ({_POS}) SELECT DISTINCT a.id AS doc_id FROM p a {_PAIRS} b.pos = a.pos + 1",
    "near_query": f"WITH p AS ({_POS}) SELECT DISTINCT a.id AS doc_id FROM p a {_PAIRS} abs(a.pos - b.pos) <= 3",
    "then_query": f"WITH p AS ({_POS}) SELECT DISTINCT a.id AS doc_id FROM p a {_PAIRS} b.pos - a.pos BETWEEN 1 AND 3",
    "search_count": f"SELECT count(DISTINCT id) AS n FROM ({_POS}) WHERE term IN ('the', 'la')",
    "lexeme_filter": f"""
WITH p AS ({_POS})
SELECT doc_id, lang, source FROM documents
WHERE doc_id IN (SELECT a.id FROM p a {_PAIRS} b.pos = a.pos + 1) AND doc_id NOT IN (SELECT id FROM p WHERE term = 'la')""",
    "lexeme_headline": f"SELECT doc_id, {marked_sql(['und', 'der'], '<b>', '</b>')} AS headline FROM documents",
    "search_bm25_topk": any_term_sql(["the", "of"], 20),
    "search_boost": f"""
WITH {bm25_sql()}, o AS (SELECT id AS doc_id, round(sum(CASE WHEN term = 'der' THEN 50 * s ELSE s END), 6) AS score
  FROM impact WHERE term IN ('the', 'der') GROUP BY 1)
SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id)::INT AS rank, score FROM o ORDER BY score DESC, doc_id LIMIT 50""",
    "bm25_query_or": any_term_sql(["the", "quick", "la", "und", "der"], 100),
    "score_vs_full_score": f"""
WITH {bm25_sql()}
SELECT id AS doc_id, round(sum(CASE WHEN term IN ({_STOP_EN}) OR df / n >= 0.5 THEN 0 ELSE s END), 6) AS score,
  round(sum(s), 6) AS full_score
FROM impact WHERE term IN ('the', 'on', 'er', 'la') GROUP BY 1""",
    "score_inspect": f"""
WITH {bm25_sql()}
SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM dfs, corpus
WHERE term IN ('the', 'on', 'er', 'la', 'und') AND term NOT IN ({_STOP_EN}) AND df / n < 0.5""",
    "negative_score": f"""
WITH {bm25_sql()}
SELECT doc_id, coalesce(0 - round(sum(s), 6), 0.0) AS score
FROM documents LEFT JOIN impact ON id = doc_id AND term IN ('of', 'the', 'la') GROUP BY 1""",
    "search_many": f"WITH {many_sql(10)} SELECT query_id, rank::INT AS rank, id, score FROM hits",
    "search_many_pruned": f"WITH {many_sql(10)} SELECT query_id, rank::INT AS rank, id, score FROM hits",
    "bm25f_weighted": _weighted_sql(
        "out AS (SELECT id, round(sum(idf * x * 2.2 / (1.2 + x)), 6) AS score FROM imp "
        "WHERE term IN ('user', 'the', 'la') GROUP BY 1)"
    ),
    "field_scoped": _weighted_sql(
        "hit AS (SELECT id, max(CASE WHEN term = 'assistant' AND in_role THEN idf * x_role * 2.2 / (1.2 + x_role) END) AS r, "
        "sum(CASE WHEN term IN ('the', 'la') AND in_text THEN idf * x_text * 2.2 / (1.2 + x_text) END) AS t FROM imp GROUP BY 1), "
        "out AS (SELECT id, round(r + t, 6) AS score FROM hit WHERE r IS NOT NULL AND t IS NOT NULL)"
    ),
    "drop_stop_search": f"""
WITH {bm25_sql()}, o AS (SELECT id AS doc_id, round(s, 6) AS score FROM impact WHERE term = 'reer')
SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id)::INT AS rank, score FROM o ORDER BY score DESC, doc_id LIMIT 50""",
    "highlight": f"SELECT doc_id, {marked_sql(['the', 'of', 'la'], '<mark>', '</mark>')} AS marked FROM documents",
    "snippet_modes": f"""
WITH {bm25_sql()}, o AS (SELECT id AS doc_id, round(sum(s), 6) AS score FROM impact WHERE term IN ('und', 'der') GROUP BY 1),
top AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id)::INT AS rank, score, text
  FROM o JOIN documents USING (doc_id) ORDER BY score DESC, doc_id LIMIT 10)
SELECT doc_id, rank, score, 'none' AS mode, NULL::VARCHAR AS snippet FROM top
UNION ALL SELECT doc_id, rank, score, 'html', {marked_sql(['und', 'der'], '<mark>', '</mark>')} FROM top
UNION ALL SELECT doc_id, rank, score, 'htmlx', {marked_sql(['und', 'der'], '[x', ']')} FROM top
UNION ALL SELECT doc_id, rank, score, 'ansix', {marked_sql(['und', 'der'], chr(27) + '[1m', chr(27) + '[0m')} FROM top""",
    "index_append_equals_rebuild": f"""
WITH {bm25_sql()}, o AS (SELECT id AS doc_id, round(sum(s), 6) AS score FROM impact WHERE term IN ('the', 'la', 'und') GROUP BY 1)
SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id)::INT AS rank, score FROM o ORDER BY score DESC, doc_id LIMIT 100""",
    "index_delete": f"""
WITH live AS (SELECT * FROM documents WHERE source <> (SELECT min(source) FROM documents)),
{bm25_sql('live')}, o AS (SELECT id AS doc_id, round(sum(s), 6) AS score FROM impact WHERE term IN ('the', 'la', 'und') GROUP BY 1)
SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id)::INT AS rank, score FROM o ORDER BY score DESC, doc_id LIMIT 100""",
    "index_stats": """
SELECT 2::BIGINT AS segments, 2::BIGINT AS immutable_segments, count(*) AS documents,
  count(*) FILTER (lang = 'de' OR n_chars > 5000) AS dead_documents,
  count(*) FILTER (lang = 'de' OR n_chars > 5000) / count(*) AS dead_ratio FROM documents""",
    "segment_info": f"""
SELECT CASE WHEN lang IN ('en', 'fr') THEN 1 ELSE 2 END AS segment, count(*) AS docs,
  count(*) FILTER (lang = 'de' OR n_chars > 5000) AS dead, sum(len({TOKENS}))::BIGINT AS total_len FROM documents GROUP BY 1""",
    "index_compact": f"""
SELECT count(*) AS docs, 0::BIGINT AS dead, sum(len({TOKENS}))::BIGINT AS total_len FROM documents
WHERE NOT (lang = 'de' OR n_chars > 5000)""",
    "verify_index": f"""
SELECT count(*) AS n_postings, sum(tf)::BIGINT AS n_tokens, 0::BIGINT AS n_findings
FROM (SELECT id, term, count(*) AS tf FROM ({_POS}) GROUP BY 1, 2)""",
    "term_score_bounds": f"WITH {bm25_sql()} SELECT term, any_value(df) AS df, round(max(s), 6) AS max_score FROM impact GROUP BY 1",
}

_OR_NOT_SQL = f"""
WITH {bm25_sql('documents')}, has_of AS (SELECT DISTINCT id FROM impact WHERE term = 'of'),
scores AS (SELECT id, round(sum(s), 6) AS s FROM impact WHERE term = 'the' GROUP BY 1),
found AS (SELECT doc_id, coalesce(s, 0) AS score FROM documents LEFT JOIN scores ON scores.id = doc_id
  LEFT JOIN has_of ON has_of.id = doc_id WHERE s IS NOT NULL OR has_of.id IS NULL)"""
# The stored form of a query has the rows of the other.
ORACLES |= {
    "stored_bool_query": ORACLES["bool_query"],
    "stored_phrase": ORACLES["phrase_query"],
    "stored_near": ORACLES["near_query"],
    "stored_negative_score": ORACLES["negative_score"],
    "stored_or_not": _OR_NOT_SQL + " SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id)::INT AS rank, score FROM found ORDER BY rank LIMIT 50",
    "stored_score_all": _OR_NOT_SQL + " SELECT doc_id, score, score AS full_score FROM found",
}

_LIVE = "live AS (SELECT * FROM documents WHERE NOT coalesce(lang = 'de' OR n_chars > 5000, false))"
_LIVE_MANY = f"WITH {_LIVE}, {many_sql(10, source='live')} SELECT query_id, rank::INT AS rank, id, score FROM hits"
ORACLES |= {
    "stored_term_stats": f"WITH {_LIVE}, {bm25_sql('live')} SELECT term, df FROM dfs",
    "stored_term_bounds": ORACLES["term_score_bounds"],
    "stored_bounds_after_delete": f"WITH {_LIVE}, " + ORACLES["term_score_bounds"].removeprefix("WITH ").replace("FROM documents", "FROM live"),
    "stored_search_many": _LIVE_MANY,
    "stored_search_many_pruned": _LIVE_MANY,
    "stored_field_scoped": ORACLES["field_scoped"],
}
