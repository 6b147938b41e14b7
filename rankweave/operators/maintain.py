"""Keeping a stored text index up to date, and looking into it."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.operators.analyze import dictionary_version
from rankweave.operators.text_index import (
    Manifest, StoredIndex, TextIndex, bucket_of, check_unique_ids, levels_of, splits_for, table_schema,
    write_levels, write_manifest, write_segment,
)
from rankweave.operators.text_search import _idf, term_impacts, term_tops
from rankweave.session import broadcast_if_small


def _stored(index: TextIndex) -> StoredIndex:
    if not isinstance(index, StoredIndex):
        raise TypeError("not a stored text index")
    return index


def _writable(index: TextIndex) -> StoredIndex:
    """The index if it is the current version: a change on an old one would be lost.

    An index has one writer at a time; of two that meet, the second manifest fails.
    """
    index = _stored(index)
    current = StoredIndex.open(index.spark, index.path).manifest.version
    if current != index.manifest.version:
        raise RuntimeError(f"index version {index.manifest.version} is not the current one ({current}): open it again")
    return index


def _next_segment(manifest: Manifest) -> int:
    """A number above all live ones; segments of a failed attempt are written over."""
    return max([0, *manifest.segments]) + 1


def append_segment(
    index: StoredIndex, rows: DataFrame, batch: tuple[str, int] | None = None
) -> StoredIndex:
    """Add new documents as a segment of their own.

    ``batch`` is the name of a stream and the number of its batch; numbers only grow,
    so a batch not above the last one added is a repetition and is passed over.
    The segment has term levels of its own, so nothing else has to be adjusted. An id
    that is NULL, comes twice, or is live already is refused.
    """
    index = _writable(index)
    manifest = index.manifest
    if batch is not None and batch[1] <= manifest.batches.get(batch[0], -1):
        return index
    check_unique_ids(rows, index.id_col)
    given = rows.select(F.col(index.id_col).alias("id"))
    held = index.doc_stats().join(given, "id", "left_semi").limit(1).collect()
    if held:
        raise ValueError(f"id {held[0]['id']!r} is in the index already: delete it first")
    segment = _next_segment(manifest)
    totals = write_segment(index.frame_index(rows), index.path, manifest, segment)
    batches = manifest.batches if batch is None else {**manifest.batches, batch[0]: batch[1]}
    following = manifest.next(
        segments=[*manifest.segments, segment], batches=batches, totals={**manifest.totals, str(segment): totals}
    )
    write_manifest(index.spark, index.path, following)
    source = index.source.unionByName(rows.select(*index.source.columns)) if index.source is not None else None
    return StoredIndex(index.spark, index.path, following, source, index.dictionary)


def delete_docs(index: StoredIndex, ids: DataFrame) -> StoredIndex:
    """Mark documents dead in the segments that hold them.

    Their postings are looked up once, without positions, for the frequencies of their
    terms; a table of many ids at once costs no more than one id.
    """
    index = _writable(index)
    following = index.manifest.next(tombstones=[*index.manifest.tombstones, index.manifest.version + 1])
    wanted = ids.select(F.col(ids.columns[0]).alias("id")).distinct()
    # Only live documents are marked, so the totals of the dead can simply be added up.
    live = index._live(index.stored_doc_stats())
    dead = live.join(wanted, "id", "left_semi").select("id", "segment", "field", "len")
    target = f"{index.path}/tombstones/version={following.version}"
    dead.write.mode("overwrite").parquet(target)
    marked = index.spark.read.schema(table_schema("tombstones", following.id_type)).parquet(target)
    lost = index.stored_postings().select("segment", "id", "term", "field", "tf", "len").join(
        broadcast_if_small(marked.select("id", "segment").distinct()), ["id", "segment"], "left_semi"
    )
    gone_levels = levels_of(lost, ["segment"], index.multi_field).drop("shortest")
    write_levels(
        gone_levels.withColumn("bucket", bucket_of(F.col("term"), following.buckets)),
        f"{index.path}/gone_levels/version={following.version}",
        following.buckets,
        splits_for(following, *following.totals.values()),
    )
    # A row per live segment and field.
    counted = marked.groupBy("segment", "field").agg(F.count("*").alias("n"), F.sum("len").alias("len"))
    gone = {s: dict(fields) for s, fields in following.dead.items()}
    for row in counted.collect():
        fields = gone.setdefault(str(row["segment"]), {})
        n, length = fields.get(row["field"], (0, 0))
        fields[row["field"]] = [n + row["n"], length + row["len"]]
    following = replace(following, dead=gone)
    write_manifest(index.spark, index.path, following)
    source = index.source
    if source is not None:
        source = source.join(wanted.withColumnRenamed("id", index.id_col), index.id_col, "left_anti")
    return StoredIndex(index.spark, index.path, following, source, index.dictionary)


def compact(index: StoredIndex) -> StoredIndex:
    """Bring the segments into one and drop dead documents; no text is read."""
    index = _writable(index)
    manifest = index.manifest
    segment = _next_segment(manifest)
    totals = {str(segment): write_segment(index, index.path, manifest, segment)}
    following = manifest.next(segments=[segment], tombstones=[], totals=totals, dead={})
    write_manifest(index.spark, index.path, following)
    return StoredIndex(index.spark, index.path, following, index.source, index.dictionary)


def reindex(index: StoredIndex, df: DataFrame, dictionary: DataFrame | None = None) -> StoredIndex:
    """Analyse the texts of ``df`` again, with the dictionary as it is now."""
    index = _writable(index)
    manifest = index.manifest
    words = dictionary if dictionary is not None else index.dictionary
    check_unique_ids(df, index.id_col)
    segment = _next_segment(manifest)
    totals = {str(segment): write_segment(index.frame_index(df, words), index.path, manifest, segment)}
    stamp = {}
    if index.analyzer == "words":
        now = dictionary_version(words).first()
        stamp = {"dictionary_version": now["version"], "dictionary_fingerprint": now["fingerprint"]}
    following = manifest.next(segments=[segment], tombstones=[], totals=totals, dead={}, **stamp)
    write_manifest(index.spark, index.path, following)
    return StoredIndex(index.spark, index.path, following, df, words)


def segment_info(index: TextIndex) -> DataFrame:
    """(segment, docs, dead, total_len) of each live segment."""
    index = _stored(index)
    docs = index.stored_doc_stats().groupBy("segment", "id").agg(F.sum("len").alias("len"))
    dead = index.tombstones()
    if dead is None:
        marked = docs.withColumn("dead", F.lit(0))
    else:
        marked = docs.join(dead.select("id", "segment").distinct().withColumn("dead", F.lit(1)), ["id", "segment"], "left")
    return marked.groupBy("segment").agg(
        F.count("*").alias("docs"),
        F.coalesce(F.sum("dead"), F.lit(0)).cast("long").alias("dead"),
        F.sum("len").cast("long").alias("total_len"),
    )


def index_stats(index: TextIndex, dictionary: DataFrame | None = None) -> DataFrame:
    """One row: segments, immutable_segments, documents, dead_documents and the analysis state.

    Every segment is immutable. The analysis columns are NULL for an analyzer that
    needs no dictionary.
    """
    index = _stored(index)
    info = segment_info(index).agg(
        F.count("*").alias("segments"),
        F.count("*").alias("immutable_segments"),
        F.coalesce(F.sum("docs"), F.lit(0)).alias("documents"),
        F.coalesce(F.sum("dead"), F.lit(0)).alias("dead_documents"),
    )
    if index.analyzer != "words":
        return info.select(
            "*",
            F.lit(None).cast("boolean").alias("analysis_matches"),
            F.lit(None).cast("string").alias("analysis_detail"),
        )
    state = index_analysis(index, dictionary).select(
        F.struct(F.col("matches"), F.col("status")).alias("s")
    ).scalar()
    return info.select("*", state["matches"].alias("analysis_matches"), state["status"].alias("analysis_detail"))


def index_health(index: TextIndex) -> DataFrame:
    """One row: index_stats with the share of dead documents."""
    return index_stats(index).withColumn(
        "dead_ratio",
        F.when(F.col("documents") > 0, F.col("dead_documents") / F.col("documents")).otherwise(0.0),
    )


def index_analysis(index: StoredIndex, dictionary: DataFrame | None = None) -> DataFrame:
    """One row comparing the dictionary the index was built with to the one in use."""
    index = _stored(index)
    columns = ("recorded_version", "recorded_fingerprint", "runtime_version", "runtime_fingerprint")
    if index.analyzer != "words":
        one = index.spark.range(1)
        return one.select(
            F.lit(index.path).alias("index_name"),
            *[F.lit(None).cast("long").alias(c) for c in columns],
            F.lit(None).cast("boolean").alias("matches"),
            F.lit("not applicable").alias("status"),
        )
    words = dictionary if dictionary is not None else index.dictionary
    recorded = (index.manifest.dictionary_version, index.manifest.dictionary_fingerprint)
    now = dictionary_version(words).select(
        F.lit(index.path).alias("index_name"),
        F.lit(recorded[0]).cast("long").alias(columns[0]),
        F.lit(recorded[1]).cast("long").alias(columns[1]),
        F.col("version").alias(columns[2]),
        F.col("fingerprint").alias(columns[3]),
    )
    same = (F.col(columns[0]) == F.col(columns[2])) & (F.col(columns[1]) == F.col(columns[3]))
    return now.withColumn("matches", same).withColumn(
        "status", F.when(same, "matches").otherwise("dictionary drift; REINDEX required")
    )


def verify_index(index: StoredIndex, df: DataFrame | None = None) -> DataFrame:
    """(severity, location, message) of everything wrong; empty when all is well.

    Looks at the stored tables alone: counts against positions, lengths against
    counts, postings without a document, a document twice, term levels against the
    postings. With ``df`` the texts are
    analysed again and compared posting by posting.
    """
    index = _stored(index)
    postings, docs = index.stored_postings(), index.stored_doc_stats()
    at_doc = F.concat_ws("/", F.lit("doc"), F.col("id").cast("string"), F.col("field"))
    at_term = F.concat_ws("/", at_doc, F.col("term"))

    def findings(rows: DataFrame, where: Column, message: Column) -> DataFrame:
        """A row for each row that has a message; one pass whatever the number of messages."""
        named = rows.select(F.lit("error").alias("severity"), where.alias("location"), message.alias("message"))
        return named.where(F.col("message").isNotNull())

    badly_counted = (F.col("tf") != F.size("positions")) | (F.col("tf") < 1)
    found = findings(postings, at_term, F.when(badly_counted, "frequency differs from the number of positions"))
    totals = postings.groupBy("segment", "id", "field").agg(
        F.sum("tf").alias("held"), F.min("len").alias("low"), F.max("len").alias("high")
    )
    sizes = docs.join(totals, ["segment", "id", "field"], "full")
    wrong = (
        (F.coalesce("held", F.lit(0)) != F.col("len"))
        | (F.coalesce("low", "len") != F.col("len"))
        | (F.coalesce("high", "len") != F.col("len"))
    )
    about_size = F.when(F.col("len").isNull(), "postings without a document").when(
        wrong, "length differs from the sum of frequencies"
    )
    found = found.union(findings(sizes, at_doc, about_size))
    twice = index.doc_stats().groupBy("id", "field").count()
    found = found.union(findings(twice, at_doc, F.when(F.col("count") > 1, "document is live more than once")))
    keys = ["segment", "term", "field", "tf"]
    live = index._live(postings.select("segment", "id", "term", "field", "tf", "len"))
    counted = levels_of(live, ["segment"], index.multi_field)
    none = F.lit(None).cast("int")
    levels = index.term_levels().select(*keys, "n", "shortest", none.alias("least")).unionByName(
        counted.select(*keys, (-F.col("n")).alias("n"), none.alias("shortest"), F.col("shortest").alias("least"))
    )
    compared = levels.groupBy(*keys).agg(
        F.sum("n").alias("off"), F.min("shortest").alias("shortest"), F.min("least").alias("least")
    )
    # A dead document may be the shortest until the index is compacted.
    badly_kept = (F.col("off") != 0) | (F.col("shortest") > F.col("least"))
    at_level = F.concat_ws("/", F.lit("term"), "field", "term")
    found = found.union(findings(compared, at_level, F.when(badly_kept, "term levels differ from the postings")))
    if df is not None:
        # Field and term are one key of one type: a constant field would be taken out of the keys
        # that rows are dealt by, and they would be dealt again for the join.
        key = ["id", F.struct("field", "term").cast("struct<field: string, term: string>").alias("at")]
        again = index.frame_index(df).postings().select(*key, F.col("positions").alias("p"))
        held = index.postings().select(*key, "positions")
        # All positions move, of the index and of the texts, so the tasks grow in number with the tokens.
        tasks = index.manifest.buckets * splits_for(index.manifest, *index.manifest.totals.values())
        if tasks > int(index.spark.conf.get("spark.sql.shuffle.partitions")):
            held, again = held.repartition(tasks, "id", "at"), again.repartition(tasks, "id", "at")
        both = held.join(again, ["id", "at"], "full").select("id", "at.*", "positions", "p")
        about_text = (
            F.when(F.col("p").isNull(), "posting is not in the text")
            .when(F.col("positions").isNull(), "text is not in the index")
            .when(F.col("p") != F.col("positions"), "positions differ from the text")
        )
        found = found.union(findings(both, at_term, about_text))
    return found


def term_score_bounds(index: TextIndex, terms: DataFrame | None = None) -> DataFrame:
    """(term, df, max_score): the most any document can get from a term.

    A stored index over one field without dead documents has it in its levels; else the
    postings are looked through.
    """
    if isinstance(index, StoredIndex) and not index.multi_field and not index.manifest.tombstones:
        bounds = term_tops(index, terms)
    else:
        weights = term_impacts(index, terms)
        bounds = weights.groupBy("term").agg(F.count("*").alias("df"), F.max("tfn").alias("top"))
    return _idf(index, bounds).select("term", "df", F.round(F.col("idf") * F.col("top"), 6).alias("max_score"))
