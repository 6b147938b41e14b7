"""Matching, counting and ranked search over a text index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankweave.functions.text import highlight, literal_replacement, token_pattern
from rankweave.operators.analyze import segment_runs
from rankweave.operators.query import B, K1, Or, Query, Scope, analyze_query, analyze_text, plain_terms
from rankweave.operators.text_index import FrameIndex, Leaf, StoredIndex, TextIndex, tasks_for
from rankweave.session import BROADCAST_ROWS, at_most, broadcast_if_small, durable, null_safe_join

# The modes that a caller can name.
SNIPPET_MODES = ("none", "html", "ansi")
# Terminal escapes of the ansi snippets.
ANSI_TAGS = ("\x1b[1m", "\x1b[0m")
HIT_SCHEMA = "rank int, score double, snippet string"
SCORE_PLACES = 6


def _spark(index: TextIndex):
    return index.source_spark()


def as_query(index: TextIndex, query: Query | str) -> Query | None:
    if isinstance(query, str):
        return analyze_query(_spark(index), query, index.analyzer, index.dictionary)
    return query


class _Plan:
    """Candidate rows of a query with their match and score columns."""

    def __init__(self, index: TextIndex, query: Query) -> None:
        terms = list(dict.fromkeys(t for t, _ in query.terms()))
        self.index, self.query = index, query
        self.scope = Scope(index.fields, index.weights, {t: n for n, t in enumerate(terms)})
        self.leaves = [Leaf(n, t) for n, t in enumerate(terms)]
        self.match = query.matches(self.scope)
        self.rows = index.candidates(self.leaves, query.needs_positions())
        if query.matches_empty() and not isinstance(index, FrameIndex):
            # Stored postings know nothing of documents without the terms.
            found = self.rows
            filled = [
                F.coalesce(c, F.array().cast("array<int>") if c.startswith("pos_") else F.lit(0)).alias(c)
                for c in found.columns
                if c != "id"
            ]
            self.rows = index.all_ids().join(found, "id", "left").select("id", *filled)

    def matching(self) -> DataFrame:
        return self.rows.where(self.match)

    def stats(self) -> Column:
        present = [self.scope.present(leaf.term) for leaf in self.leaves]
        one = self.index.collection_row(self.rows, self.leaves, present)
        return one.select(F.struct("n", "avg", "df")).scalar()

    def scored(self, skip: frozenset = frozenset(), extra: list[Column] | None = None) -> DataFrame:
        matching = self.matching()
        score = self.query.score(self.scope, self.stats(), skip) if self.leaves else F.lit(0.0)
        columns = [F.col("id"), F.round(score, SCORE_PLACES).alias("score")]
        return matching.select(*columns, *(extra or []))


def match(index: TextIndex, query: Query | str) -> DataFrame:
    """(id) of the documents that match."""
    query = as_query(index, query)
    if query is None:
        return index.all_ids().where(F.lit(False))
    return _Plan(index, query).matching().select("id")


def search_count(index: TextIndex, query: Query | str) -> DataFrame:
    """One row (n): the number of matching documents."""
    return match(index, query).agg(F.count("*").alias("n"))


def score_all(
    index: TextIndex, query: Query | str, stop_words: list[str] | None = None,
    dense_ratio: float | None = None,
) -> DataFrame:
    """(id, score, full_score) of every matching document.

    ``score`` leaves out stop words and terms in at least ``dense_ratio`` of all
    documents; ``full_score`` counts every term.
    """
    query = as_query(index, query)
    if query is None:
        return index.all_ids().where(F.lit(False)).select(
            "id", F.lit(0.0).alias("score"), F.lit(0.0).alias("full_score")
        )
    plan = _Plan(index, query)
    stats = plan.stats()
    skip = frozenset(stop_words or ())
    reduced = query if dense_ratio is None else _Dense(query, dense_ratio)
    return plan.matching().select(
        "id",
        F.round(reduced.score(plan.scope, stats, skip), SCORE_PLACES).alias("score"),
        F.round(query.score(plan.scope, stats, frozenset()), SCORE_PLACES).alias("full_score"),
    )


class _Dense(Query):
    """A query whose terms in too many documents add nothing to the score."""

    def __init__(self, inner: Query, ratio: float) -> None:
        object.__setattr__(self, "inner", inner)
        object.__setattr__(self, "ratio", ratio)

    def score(self, scope, stats, skip, name=None):
        sparse = _SparseScope(scope, self.ratio)
        return self.inner.score(sparse, stats, skip, name)


class _SparseScope(Scope):
    def __init__(self, scope: Scope, ratio: float) -> None:
        super().__init__(scope.fields, scope.weights, scope.numbers)
        self.ratio = ratio

    def impact(self, term, name, stats):
        dense = stats["df"][self.numbers[term]] / stats["n"] >= self.ratio
        return F.when(dense, 0.0).otherwise(super().impact(term, name, stats))


def score_inspect(
    index: TextIndex, query: Query | str, stop_words: list[str] | None = None,
    dense_ratio: float | None = None,
) -> DataFrame:
    """(term, df, idf) of the terms that take part in ``score``."""
    query = as_query(index, query)
    stops = set(stop_words or ())
    terms = [] if query is None else [t for t, counts in query.terms() if counts and t not in stops]
    terms = list(dict.fromkeys(terms))
    n = index.n_docs()
    frequency = index.term_stats(terms)
    out = frequency.select(
        "term",
        "df",
        F.round(F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)), SCORE_PLACES).alias("idf"),
        n.alias("n"),
    )
    if dense_ratio is not None:
        out = out.where(F.col("df") / F.col("n") < dense_ratio)
    return out.drop("n")


def _best_field(fields: list[str], marked: list[Column]) -> Column:
    """The first field whose text changed by marking, else the first field."""
    return F.coalesce(*[F.when(m != F.col(f), m) for m, f in zip(marked, fields)], marked[0])


def _mark_words(
    index: TextIndex, rows: DataFrame, wanted: Column, latin: Column, tags: tuple[str, str]
) -> DataFrame:
    """``rows`` with ``snippet``, Han words being marked where segmentation puts them.

    A text is taken apart into Han runs and the rest. Runs are cut into words like
    in the index and put together again, so a longer word is never marked inside.
    """
    pieces = {f: f"pieces_{f}" for f in index.fields}
    for f, name in pieces.items():
        rows = rows.withColumn(
            name, F.regexp_extract_all(F.col(f), F.lit(r"\p{IsHan}+|[^\p{IsHan}]+"), F.lit(0))
        )
    every = F.array_distinct(F.concat(*[F.col(n) for n in pieces.values()]))
    runs = rows.select("id", F.explode(every).alias("run")).where(F.col("run").rlike(r"^\p{IsHan}"))
    cut = (
        runs.distinct()
        .join(segment_runs(runs, index.dictionary), "run")
        .groupBy("id")
        .agg(F.map_from_entries(F.collect_list(F.struct("run", "words"))).alias("cut"))
    )

    def piece(p: Column) -> Column:
        words = F.element_at(F.col("cut"), p)
        marked = F.transform(
            words, lambda w: F.when(F.array_contains(wanted, w), F.concat(F.lit(tags[0]), w, F.lit(tags[1]))).otherwise(w)
        )
        return F.coalesce(F.array_join(marked, ""), F.regexp_replace(p, latin, F.lit("$1".join(map(literal_replacement, tags)))))

    marked = [F.array_join(F.transform(F.col(n), piece), "") for n in pieces.values()]
    return rows.join(cut, "id", "left").withColumn("snippet", _best_field(index.fields, marked))


def _snippets(
    index: TextIndex, rows: DataFrame, terms: list[str], mode: str, begin: str | None, end: str | None
) -> DataFrame:
    """``rows`` with ``snippet``: the text of the matching field, its terms marked."""
    tags = ANSI_TAGS if mode == "ansi" else (
        "<mark>" if begin is None else begin, "</mark>" if end is None else end
    )
    if index.analyzer == "words":
        return _mark_words(index, rows, F.array(*[F.lit(t) for t in terms]), F.lit(token_pattern(terms)), tags)
    marked = [highlight(F.col(f), terms, *tags) for f in index.fields]
    return rows.withColumn("snippet", _best_field(index.fields, marked))


def search(
    index: TextIndex,
    query: Query | str,
    limit: int = 5,
    snippet: str = "none",
    begin_tag: str | None = None,
    end_tag: str | None = None,
    drop_stop_words: bool = False,
) -> DataFrame:
    """(id, rank, score, snippet) of the best ``limit`` documents, score down, id up.

    The text is read for the surviving rows only.
    """
    if snippet not in SNIPPET_MODES:
        raise ValueError(f"snippet must be one of {SNIPPET_MODES}, got {snippet!r}")
    if isinstance(limit, bool) or not isinstance(limit, int) or limit < 0:
        raise ValueError(f"limit must be an integer >= 0, got {limit!r}")
    if drop_stop_words:
        if not isinstance(query, str):
            raise ValueError("drop_stop_words takes plain text, not a built query")
        query = plain_terms(_spark(index), query, index.analyzer, index.dictionary)
    else:
        query = as_query(index, query)
    if query is None:
        nothing = index.all_ids().where(F.lit(False))
        return nothing.select("id", *[
            F.lit(None).cast(t).alias(n) for n, t in (p.split() for p in HIT_SCHEMA.split(", "))
        ])
    top = _Plan(index, query).scored().orderBy(F.col("score").desc(), "id").limit(limit)
    # The window sees the ``limit`` rows kept above and nothing else.
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "id")))
    if snippet == "none" or index.source is None:
        return ranked.select("id", "rank", "score", F.lit(None).cast("string").alias("snippet"))
    texts = index.source.select(F.col(index.id_col).alias("id"), *index.fields)
    kept = F.broadcast(ranked) if limit <= BROADCAST_ROWS else ranked
    terms = list(dict.fromkeys(t for t, counts in query.terms() if counts))
    hits = _snippets(index, texts.join(kept, "id"), terms, snippet, begin_tag, end_tag)
    return hits.select("id", "rank", "score", "snippet")


def bm25_query(index: TextIndex, text: str, k: int) -> DataFrame:
    """(doc_id, score) of the best ``k`` documents with any term of ``text``."""
    terms = list(dict.fromkeys(analyze_text(_spark(index), text, index.analyzer, index.dictionary)))
    if not terms:
        return index.all_ids().where(F.lit(False)).select(F.col("id").alias("doc_id"), F.lit(0.0).alias("score"))
    return search(index, Or(*terms), limit=k).select(F.col("id").alias("doc_id"), "score")


def negative_score(index: TextIndex, text: str) -> DataFrame:
    """(id, score) of every document: minus its any-term BM25, 0 without a match."""
    terms = list(dict.fromkeys(analyze_text(_spark(index), text, index.analyzer, index.dictionary)))
    if not terms:
        return index.all_ids().select("id", F.lit(0.0).alias("score"))
    query = Or(*terms)
    plan = _Plan(index, query)
    if isinstance(index, FrameIndex):
        # Its candidates are all documents, so no join is needed.
        scored = plan.rows.select("id", F.round(query.score(plan.scope, plan.stats(), frozenset()), SCORE_PLACES).alias("s"))
        return scored.select("id", (0.0 - F.col("s")).alias("score"))
    scored = plan.scored().withColumnRenamed("score", "s")
    return index.all_ids().join(scored, "id", "left").select(
        "id", F.coalesce(0.0 - F.col("s"), F.lit(0.0)).alias("score")
    )


# -- many queries --------------------------------------------------------------


def query_terms(queries: DataFrame, query_id: str, text: str, analyzer: str = "unicode",
                dictionary: DataFrame | None = None) -> DataFrame:
    """(query_id, term): the distinct terms of each query text."""
    from rankweave.operators.analyze import token_arrays

    arrays = token_arrays(queries, query_id, text, analyzer, dictionary)
    return arrays.select(F.col("id").alias("query_id"), F.explode(F.array_distinct("tokens")).alias("term"))


def field_weight(index: TextIndex, name: str, tf: Column, length: Column) -> Column:
    """The length-normalised weight of ``tf`` hits in a field of ``length`` tokens."""
    mean = index.mean_len(name)
    return index.weights[name] * tf / ((1 - B) + B * F.when(mean > 0, length / mean).otherwise(1.0))


def _weights(index: TextIndex, rows: DataFrame, length: str) -> Column:
    """``field_weight`` of rows that name their field."""
    weighted = None
    for f in index.fields:
        part = field_weight(index, f, F.col("tf"), F.col(length))
        weighted = part if weighted is None else F.when(F.col("field") == f, part).otherwise(weighted)
    return weighted


def _saturated(weight: Column) -> Column:
    return weight * (K1 + 1) / (K1 + weight)


def term_impacts(index: TextIndex, terms: DataFrame | None = None) -> DataFrame:
    """(id, term, tfn): the length-normalised weight of each posting, before idf.

    ``terms`` (term) restricts it. Lengths sit in the postings, so no join with
    the document table is needed.
    """
    postings = index.postings_among(terms).select("id", "field", "term", "tf", "len")
    rows = postings.select("id", "term", _weights(index, postings, "len").alias("w"))
    if index.multi_field:
        rows = rows.groupBy("id", "term").agg(F.sum("w").alias("w"))
    return rows.select("id", "term", _saturated(F.col("w")).alias("tfn"))


def term_tops(index: StoredIndex, terms: DataFrame | None = None) -> DataFrame:
    """(term, df, top): no posting of the term has a higher weight than ``top``.

    Read from the stored levels: a weight grows with the hits and falls with the length,
    so the shortest document of each number of hits is enough, whatever the mean length
    has become since. ``top`` is the highest weight itself, but for an index over several
    fields, where it is reached only if one document is the best in all, and after a
    delete, until the index is compacted.
    """
    levels = index.live_levels(terms)
    held = levels.where(F.col("field").isNotNull())
    best = held.withColumn("w", _weights(index, held, "shortest")).groupBy("term", "field").agg(
        F.max("w").alias("w"), F.sum("n").alias("n")
    )
    if not index.multi_field:
        return best.select("term", F.col("n").alias("df"), _saturated(F.col("w")).alias("top"))
    tops = best.groupBy("term").agg(F.sum("w").alias("w"))
    df = levels.where(F.col("field").isNull()).select("term", F.col("n").alias("df"))
    return tops.join(df, "term").select("term", "df", _saturated(F.col("w")).alias("top"))


def _idf(index: TextIndex, frequency: DataFrame) -> DataFrame:
    n = index.n_docs()
    return frequency.withColumn("idf", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)))


def _top_per_query(scored: DataFrame, k: int) -> DataFrame:
    """Best ``k`` rows per query; Spark keeps ``k`` per task before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _join_terms(weights: DataFrame, qterms: DataFrame, salts: int) -> DataFrame:
    """Postings with the queries that ask for their term.

    With ``salts`` 0 the query terms have been counted to be few and are broadcast.
    Else both sides are shuffled by term, the postings of a hot term being spread
    over ``salts`` parts.
    """
    if not salts:
        return weights.join(F.broadcast(qterms), "term")
    salted = qterms.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    spread_out = weights.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
    return spread_out.join(salted, ["term", "salt"]).drop("salt")


def _tasks_of(index: TextIndex, weights: DataFrame) -> int | None:
    """Tasks that the documents of ``weights`` are dealt to, None if they are not dealt by id.

    The ids of a stored index are unique and its manifest holds its tokens. Those of a
    DataFrame may repeat or be NULL: an id with more postings than a task should
    read is not for one task, and is left to partial sums.
    """
    if isinstance(index, StoredIndex):
        return tasks_for(index.live_tokens())
    each = weights.groupBy("id").count().agg(F.sum("count").alias("n"), F.max("count").alias("most")).first()
    return tasks_for(each["n"] or 0) if tasks_for(each["most"] or 0) == 1 else None


def _add_up(weights: DataFrame, asked: DataFrame, salts: int, tasks: int | None) -> DataFrame:
    """(query_id, id, score): what the terms of ``asked`` (query_id, term, idf) add up to.

    Few query terms go to the postings, which are dealt by document: a posting moves once
    however many queries ask for it, a document's scores are added up where its postings
    are, and the tasks grow in number with the postings.
    """
    if not salts and tasks is not None:
        partitions = int(weights.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        # Without a number the session's holds, and small partitions may be put together.
        weights = weights.repartition(tasks, "id") if tasks > partitions else weights.repartition("id")
    return (
        _join_terms(weights, asked, salts)
        .groupBy("query_id", "id")
        .agg(F.sum(F.col("idf") * F.col("tfn")).alias("score"))
    )


def search_many(
    index: TextIndex,
    queries: DataFrame,
    query_id: str,
    text: str,
    k: int,
    snippet: str = "none",
    prune: bool = False,
    salts: int = 16,
) -> DataFrame:
    """(query_id, rank, id, score, snippet): any-term top ``k`` for a table of queries.

    With ``prune`` common terms are scored only for documents that can still reach
    a query's top ``k``; the result is the same.
    """
    if snippet not in SNIPPET_MODES:
        raise ValueError(f"snippet must be one of {SNIPPET_MODES}, got {snippet!r}")
    qterms = query_terms(queries, query_id, text, index.analyzer, index.dictionary)
    if at_most(qterms, BROADCAST_ROWS):
        salts = 0
    distinct = qterms.select("term").distinct()
    weights = term_impacts(index, distinct if salts else F.broadcast(distinct))
    if isinstance(index, FrameIndex):
        # Used for the frequencies and the scores: the texts are analysed once, and
        # only the postings of the asked terms are kept.
        weights = durable(weights)
    tasks = None if salts else _tasks_of(index, weights)
    if prune:
        ranked = _search_pruned(index, weights, qterms, k, salts, tasks)
    else:
        if isinstance(index, StoredIndex):
            frequency = index.term_stats_among(distinct)
        else:
            frequency = weights.groupBy("term").agg(F.count("*").alias("df"))
        idf = _idf(index, frequency).select("term", "idf")
        scored = _add_up(weights, qterms.join(idf, "term"), salts, tasks)
        ranked = _top_per_query(scored.withColumn("score", F.round("score", SCORE_PLACES)), k)
    out = ranked.select("query_id", "rank", "id", "score")
    if snippet == "none" or index.source is None:
        return out.withColumn("snippet", F.lit(None).cast("string"))
    return _many_snippets(index, out, qterms, snippet)


def _many_snippets(index: TextIndex, hits: DataFrame, qterms: DataFrame, mode: str) -> DataFrame:
    """Mark each hit's text with the terms of its own query."""
    tags = ANSI_TAGS if mode == "ansi" else ("<mark>", "</mark>")
    per_query = qterms.groupBy("query_id").agg(F.collect_list("term").alias("terms"))
    texts = index.source.select(F.col(index.id_col).alias("id"), *index.fields)
    edge = r"[\p{L}\p{N}&&[^\p{IsHan}]]"

    def whole(term: Column) -> Column:
        # A term may hold any character, so it is quoted: \\Q ... \\E.
        quoted = F.concat(F.lit(r"\Q"), F.replace(term, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
        bounded = F.concat(F.lit(f"(?<!{edge})"), quoted, F.lit(f"(?!{edge})"))
        return F.when(term.rlike(r"^\p{IsHan}+$"), term).otherwise(bounded)

    # The longest term first, so that a term is not cut short by another.
    longest_first = F.array_sort(
        F.transform("terms", lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t")))
    )
    alternatives = F.array_join(F.transform(longest_first, lambda e: whole(e["t"])), "|")
    pattern = F.concat(F.lit("(?iu)("), alternatives, F.lit(")"))
    joined = hits.join(per_query, "query_id").join(texts, "id")
    if index.analyzer == "words":
        # One row per hit: marking is by the hit's own key, as a text may be hit twice.
        keyed = joined.withColumn("doc", F.col("id")).withColumn("id", F.struct("query_id", "doc"))
        out = _mark_words(index, keyed, F.col("terms"), pattern, tags).withColumn("id", F.col("doc"))
    else:
        marked = [F.regexp_replace(F.col(f), pattern, F.lit("$1".join(map(literal_replacement, tags)))) for f in index.fields]
        out = joined.withColumn("snippet", _best_field(index.fields, marked))
    return out.select("query_id", "rank", "id", "score", "snippet")


def _scores_of(weights: DataFrame, hits: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, id, score): what ``terms`` (query_id, term, idf) add to each of ``hits`` (query_id, id).

    Postings are looked up by term and document, so their number is that of ``hits`` times
    the terms of a query, whatever the number of documents with the terms. ``hits`` is a
    table that is at hand, as its size is asked for first.
    """
    lookups = broadcast_if_small(hits.select("query_id", "id").join(terms.select("query_id", "term", "idf"), "query_id"))
    return (
        null_safe_join(weights, lookups, ["term", "id"])
        .groupBy("query_id", "id")
        .agg(F.sum(F.col("idf") * F.col("tfn")).alias("score"))
    )


def _floor_of(weights: DataFrame, partial: DataFrame, plan: DataFrame, k: int) -> DataFrame:
    """(query_id, floor): a score that the ``k``-th hit of a query has at least.

    It is the least whole score of the ``k`` documents that are best in ``partial``.
    """
    probes = durable(_top_per_query(partial, k).select("query_id", "id"))
    return (
        _scores_of(weights, probes, plan)
        .groupBy("query_id")
        .agg(F.when(F.count("*") == k, F.min("score")).otherwise(0.0).alias("floor"))
    )


def _search_pruned(
    index: TextIndex, weights: DataFrame, qterms: DataFrame, k: int, salts: int, tasks: int | None
) -> DataFrame:
    """Top ``k`` per query with common terms looked up for few candidates only.

    1. Each term's highest possible contribution is idf times its largest weight, which a
       stored index knows from its levels.
    2. The rarest terms of a query that together fill ``k`` places name ``k`` documents.
       The least of their whole scores is one that the ``k``-th hit has at least.
    3. Terms whose highest contributions together stay below that score cannot
       bring in a document by themselves: they are optional. Every document that
       counts has another term, so the others name the candidates.
    4. The whole scores of the ``k`` candidates that are best without optional terms give a
       higher least score. A candidate that does not reach it with the highest
       contributions of all optional terms is out.
    5. Optional terms are joined by (term, id) for the candidates that are left.
    """
    if isinstance(index, StoredIndex):
        tops = term_tops(index, qterms.select("term").distinct())
    else:
        # Rows that repeat an id add up to one hit.
        held = weights.groupBy("term", "id").agg(F.count("*").alias("n"), F.sum("tfn").alias("tfn"))
        tops = held.groupBy("term").agg(F.sum("n").alias("df"), F.max("tfn").alias("top"))
    bounds = _idf(index, tops).select("term", "df", "idf", (F.col("idf") * F.col("top")).alias("bound"))
    # One row per query and term, used by all the steps below.
    plan = durable(qterms.join(bounds, "term"))

    def beside(of_queries: DataFrame) -> DataFrame:
        # At most a row per query term: counted to be few if there are no salts.
        return of_queries if salts else F.broadcast(of_queries)

    def added_up(of_queries: DataFrame) -> DataFrame:
        asked = of_queries.select("query_id", "term", "idf")
        # Only the postings of these terms move.
        held = weights if salts else weights.join(F.broadcast(asked.select("term").distinct()), "term", "left_semi")
        return _add_up(held, asked, salts, tasks)

    rare = Window.partitionBy("query_id").orderBy("df", "term")
    before = F.coalesce(
        F.sum("df").over(rare.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    seeds = plan.withColumn("before", before).where(F.col("before") < k)
    partial = added_up(seeds)
    weak = Window.partitionBy("query_id").orderBy("bound", "term").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    # The slack covers rounding of the published score and its tie on the id.
    slack = 10.0 ** (1 - SCORE_PLACES)
    sorted_plan = durable(
        plan.join(_floor_of(weights, partial, plan, k), "query_id", "left").withColumn(
            "optional", F.sum("bound").over(weak) < F.coalesce("floor", F.lit(0.0)) - slack
        )
    )
    required = sorted_plan.where(~F.col("optional"))
    optional = sorted_plan.where(F.col("optional"))
    main = durable(added_up(required).withColumnRenamed("score", "part"))
    floor = _floor_of(weights, main.withColumnRenamed("part", "score"), plan, k)
    open_still = optional.groupBy("query_id").agg(F.sum("bound").alias("rest")).join(floor, "query_id")
    # A query without optional terms is done and has no row there.
    reach = F.col("part") + F.col("rest") >= F.col("floor") - slack
    left = durable(
        main.join(beside(open_still), "query_id", "left")
        .where(F.coalesce(reach, F.lit(True)))
        .select("query_id", "id", "part")
    )
    extra = _scores_of(weights, left, beside(optional)).withColumnRenamed("score", "more")
    scored = null_safe_join(left, extra, ["query_id", "id"], "left").select(
        "query_id",
        "id",
        F.round(F.col("part") + F.coalesce("more", F.lit(0.0)), SCORE_PLACES).alias("score"),
    )
    return _top_per_query(scored, k)


# -- filters on a text column --------------------------------------------------


def lexeme_filter(df: DataFrame, id_col: str, text_col: str, query: Query, analyzer: str = "unicode") -> DataFrame:
    """Rows of ``df`` whose text matches, with all their columns."""
    index = FrameIndex(df, id_col, text_col, analyzer)
    return df.join(match(index, query).withColumnRenamed("id", id_col), id_col, "left_semi")


def headline(df: DataFrame, text_col: str, terms: list[str], begin: str = "<b>", end: str = "</b>") -> DataFrame:
    """``df`` with ``headline``: the text with its matching tokens marked."""
    return df.withColumn("headline", highlight(F.col(text_col), terms, begin, end))
