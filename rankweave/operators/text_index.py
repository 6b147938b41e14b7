"""Text indexes: one over a DataFrame, one stored as Parquet tables.

Both give the search code the same three things: the postings of some terms, one
row per candidate document with the hits of each term, and the collection numbers.
Over a DataFrame everything about a document is in its row, so a search is a scan
without a shuffle. Stored postings are laid out by a hash of the term, so a search
opens the folders of its terms only.

Tables of a stored index, below one path:

* ``postings/segment=n/bucket=b`` - id, field, term, tf, len, positions
* ``doc_stats/segment=n`` - id, field, len
* ``term_levels/segment=n/bucket=b`` - term, field, tf, n, shortest: how many documents hold
  the term so often, and the least length among them. A row without field and tf counts
  the documents with the term in any of several fields
* ``tombstones/version=v`` - id, segment, field, len
* ``gone_levels/version=v/bucket=b`` - segment, term, field, tf, n of the documents that
  became dead with that version
* ``manifest/version=v`` - one JSON row; the highest version is the current one. It
  also holds the document counts and total lengths, so a search needs no job for them.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from rankweave.operators.analyze import check_analyzer, dictionary_version, split_long_in_arrays, token_arrays
from rankweave.functions.text import group_tokens, tokens_of

POSTING_COLUMNS = ["id", "field", "term", "tf", "len", "positions"]
# Tokens behind one file of postings, about: the files of a bucket grow in number, not in size.
FILE_TOKENS = 4_000_000


# Fixed values of the field syntax: how many fields, and characters their names exclude.
FIELD_COUNT = range(2, 17)
NAME_EXCLUDES = frozenset(",:")


def check_field_weights(weights: dict[str, float]) -> dict[str, float]:
    """The weights as floats, if they can be an index's.

    Stored scores are single floats, so a weight has to be positive and finite there.
    """
    if not isinstance(weights, dict) or len(weights) not in FIELD_COUNT:
        raise ValueError(f"field_weights is a dict of {FIELD_COUNT.start} to {FIELD_COUNT.stop - 1} columns, not {weights!r}")
    unnamed = [n for n in weights if not (isinstance(n, str) and n and NAME_EXCLUDES.isdisjoint(n))]
    if unnamed:
        raise ValueError(f"not usable as field names: {unnamed}")
    plain = {n: w for n, w in weights.items() if type(w) in (int, float)}
    with np.errstate(over="ignore"):
        held = {n: np.float32(min(w, 1e300)) for n, w in plain.items()}
    wrong = [n for n in weights if n not in held or not 0 < held[n] < np.inf]
    if wrong:
        raise ValueError(f"weights have to be positive 32-bit numbers: {({n: weights[n] for n in wrong})!r}")
    return {n: float(w) for n, w in plain.items()}


def check_unique_ids(df: DataFrame, id_col: str) -> None:
    """Raise when an id is NULL or occurs twice."""
    counts = df.groupBy(id_col).count()
    bad = counts.where((F.col("count") > 1) | F.col(id_col).isNull()).limit(1).collect()
    if bad:
        raise ValueError(f"ids in {id_col!r} must be unique and not NULL: {bad[0][id_col]!r}")


def term_groups(arrays: DataFrame, terms: list[str] | None = None) -> DataFrame:
    """Postings out of (id, ..., tokens) rows, with no shuffle.

    A row's tokens are sorted with their positions; the places where the term
    changes cut that list into one posting per term.
    """
    keep = [c for c in arrays.columns if c != "tokens"]
    tokens = F.col("tokens")
    pairs = group_tokens(tokens)
    if terms is not None:
        marked = F.transform(tokens, lambda t, i: F.struct(t.alias("term"), i.alias("pos")))
        pairs = F.sort_array(F.filter(marked, lambda e: e["term"].isin(*terms)))
    listed = arrays.select(*keep, F.size("tokens").alias("len"), pairs.alias("__pairs"))
    starts = F.filter(
        F.transform(
            "__pairs",
            lambda e, i: F.when(
                (i == 0) | (F.get(F.col("__pairs"), i - 1)["term"] != e["term"]), i
            ),
        ),
        lambda i: i.isNotNull(),
    )
    cut = listed.withColumn("__starts", starts)

    def posting(start: Column, n: Column) -> Column:
        stop = F.coalesce(F.get(F.col("__starts"), n + 1), F.size("__pairs"))
        return F.struct(
            F.get(F.col("__pairs"), start)["term"].alias("term"),
            (stop - start).alias("tf"),
            F.transform(
                F.slice(F.col("__pairs"), start + 1, stop - start), lambda e: e["pos"]
            ).alias("positions"),
        )

    exploded = cut.select(
        *keep, "len", F.explode(F.transform("__starts", posting)).alias("__posting")
    )
    return exploded.select(*keep, "len", "__posting.*")


@dataclass(frozen=True)
class Leaf:
    """A query term as the index sees it: its number and its text."""

    number: int
    term: str


class TextIndex:
    """What search needs from an index. ``source`` is the text table, for snippets."""

    fields: list[str]
    weights: dict[str, float]
    analyzer: str
    dictionary: DataFrame | None
    source: DataFrame | None
    id_col: str

    @property
    def multi_field(self) -> bool:
        return len(self.fields) > 1

    def postings(self, terms: list[str] | None = None) -> DataFrame:
        """Live postings, of the given terms or of all."""
        raise NotImplementedError

    def postings_among(self, terms: DataFrame | None) -> DataFrame:
        """Live postings of the terms of a table (term), or all."""
        found = self.postings()
        return found if terms is None else found.join(terms, "term", "left_semi")

    def doc_stats(self) -> DataFrame:
        """(id, field, len) of live documents."""
        raise NotImplementedError

    @staticmethod
    def totals(doc_stats: DataFrame) -> DataFrame:
        return doc_stats.groupBy("field").agg(
            F.count("*").alias("n_docs"), F.sum("len").cast("long").alias("total_len")
        )

    def corpus(self) -> DataFrame:
        """(field, n_docs, total_len) over live documents."""
        return self.totals(self.doc_stats())

    def n_docs(self) -> Column:
        """Number of live documents, as a scalar."""
        return self.corpus().select(F.coalesce(F.max("n_docs"), F.lit(0))).scalar()

    def mean_len(self, name: str) -> Column:
        """Mean length of a field over live documents, as a scalar."""
        mine = self.corpus().where(F.col("field") == name)
        return mine.select(F.max(F.col("total_len") / F.col("n_docs"))).scalar()

    def source_spark(self) -> SparkSession:
        raise NotImplementedError

    def term_stats(self, terms: list[str] | None = None) -> DataFrame:
        """(term, df): documents with the term in any field."""
        found = self.postings(terms).select("id", "term")
        if self.multi_field:
            found = found.distinct()
        return found.groupBy("term").agg(F.count("*").alias("df"))

    def candidates(self, leaves: list[Leaf], positions: bool) -> DataFrame:
        """One row per document: id, len_<f>, tf_<n>_<f> and, if asked, pos_<n>_<f>."""
        raise NotImplementedError

    def all_ids(self) -> DataFrame:
        return self.doc_stats().select("id").distinct() if self.multi_field else self.doc_stats().select("id")

    def term_stats_among(self, terms: DataFrame) -> DataFrame:
        """``term_stats`` of the terms of a table (term)."""
        return self.term_stats().join(terms, "term", "left_semi")

    def collection_row(self, candidates: DataFrame, leaves: list[Leaf], present: list[Column]) -> DataFrame:
        """One row: n, avg (array by field) and df (array by leaf)."""
        raise NotImplementedError


def levels_of(postings: DataFrame, keys: list[str], multi_field: bool) -> DataFrame:
    """(keys, term, field, tf, n, shortest) of postings (keys, id, term, field, tf, len).

    Levels of several tables can be added up: n by sum, shortest by minimum.
    """
    levels = postings.groupBy(*keys, "term", "field", "tf").agg(
        F.count("*").alias("n"), F.min("len").alias("shortest")
    )
    if not multi_field:
        return levels
    anywhere = postings.select(*keys, "term", "id").distinct().groupBy(*keys, "term").agg(F.count("*").alias("n"))
    return levels.unionByName(
        anywhere.select(
            *keys, "term", F.lit(None).cast("string").alias("field"), F.lit(None).cast("int").alias("tf"), "n",
            F.lit(None).cast("int").alias("shortest"),
        )
    )


def bucket_of(term: Column, buckets: int) -> Column:
    """The bucket that the postings of a term are in."""
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _hits_of(hits: Column, term: str) -> Column:
    return F.filter(hits, lambda e: e["term"] == term)


class FrameIndex(TextIndex):
    """An index over a DataFrame, worked out by each query that uses it."""

    def __init__(
        self,
        df: DataFrame,
        id_col: str,
        fields: list[str] | str,
        analyzer: str = "unicode",
        field_weights: dict[str, float] | None = None,
        dictionary: DataFrame | None = None,
        max_token_bytes: int | None = None,
    ) -> None:
        fields = [fields] if isinstance(fields, str) else list(fields)
        if field_weights is not None:
            weights = check_field_weights(field_weights)
            fields = list(weights)
        elif len(fields) != 1:
            raise ValueError("an index over several fields needs field_weights")
        else:
            weights = {fields[0]: 1.0}
        missing = [c for c in [id_col, *fields] if c not in df.columns]
        if missing:
            raise ValueError(f"no such column: {missing}")
        check_analyzer(analyzer, dictionary)
        self.source, self.id_col = df, id_col
        self.fields, self.weights = fields, weights
        self.analyzer, self.dictionary = analyzer, dictionary
        self.max_token_bytes = max_token_bytes

    def source_spark(self) -> SparkSession:
        return self.source.sparkSession

    def _arrays(self, name: str) -> DataFrame:
        arrays = token_arrays(self.source.select(self.id_col, name), self.id_col, name, self.analyzer, self.dictionary)
        if self.max_token_bytes:
            arrays = split_long_in_arrays(arrays, self.max_token_bytes)
        return arrays

    def _long(self) -> DataFrame:
        parts = [self._arrays(f).select("id", F.lit(f).alias("field"), "tokens") for f in self.fields]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def postings(self, terms: list[str] | None = None) -> DataFrame:
        return term_groups(self._long(), terms).select(*POSTING_COLUMNS)

    def doc_stats(self) -> DataFrame:
        return self._long().select("id", "field", F.size("tokens").alias("len"))

    def term_stats(self, terms: list[str] | None = None) -> DataFrame:
        """(term, df) out of each document's distinct terms, positions not being needed."""
        parts = None
        for f in self.fields:
            arrays = self._arrays(f)
            parts = arrays if parts is None else parts.unionByName(arrays)
        if self.multi_field:
            parts = parts.groupBy("id").agg(F.flatten(F.collect_list("tokens")).alias("tokens"))
        held = F.array_distinct("tokens")
        if terms is not None:
            held = F.filter(held, lambda t: t.isin(*terms))
        return parts.select(F.explode(held).alias("term")).groupBy("term").agg(F.count("*").alias("df"))

    def all_ids(self) -> DataFrame:
        return self.source.select(F.col(self.id_col).alias("id"))

    def n_docs(self) -> Column:
        # A count without columns reads no text.
        return self.source.select(F.count("*")).scalar()

    def candidates(self, leaves: list[Leaf], positions: bool) -> DataFrame:
        terms = [leaf.term for leaf in leaves]

        def counted(tokens: str, f: str) -> list[Column]:
            marked = F.transform(tokens, lambda t, i: F.struct(t.alias("term"), i.alias("pos")))
            hits = F.filter(marked, lambda e: e["term"].isin(*terms)) if terms else F.slice(marked, 1, 0)
            return [F.size(tokens).alias(f"len_{f}"), hits.alias(f"hits_{f}")]

        if self.analyzer == "words":
            # Segmentation works on a table of runs, so each field is a table of its own.
            out = None
            for f in self.fields:
                one = self._arrays(f).select("id", F.inline(F.array(F.struct(*counted("tokens", f)))))
                out = one if out is None else out.join(one, "id")
        else:
            wide = self.source.select(F.col(self.id_col).alias("id"), *[F.col(f).alias(f"text_{f}") for f in self.fields])
            columns = []
            for f in self.fields:
                tokens = F.coalesce(tokens_of(F.col(f"text_{f}"), self.analyzer), F.array().cast("array<string>"))
                wide = wide.withColumn("tokens", tokens)
                if self.max_token_bytes:
                    wide = split_long_in_arrays(wide, self.max_token_bytes)
                wide = wide.withColumnRenamed("tokens", f"tokens_{f}")
                columns += counted(f"tokens_{f}", f)
            # inline keeps later filters from repeating the tokenisation inside them
            out = wide.select("id", F.inline(F.array(F.struct(*columns))))
        columns = ["id"] + [F.col(f"len_{f}") for f in self.fields]
        for leaf in leaves:
            for f in self.fields:
                mine = _hits_of(F.col(f"hits_{f}"), leaf.term)
                columns.append(F.size(mine).alias(f"tf_{leaf.number}_{f}"))
                if positions:
                    columns.append(
                        F.transform(mine, lambda e: e["pos"]).alias(f"pos_{leaf.number}_{f}")
                    )
        return out.select(*columns)

    def collection_row(self, candidates: DataFrame, leaves: list[Leaf], present: list[Column]) -> DataFrame:
        return candidates.agg(
            F.count("*").alias("n"),
            F.array(*[F.avg(f"len_{f}") for f in self.fields]).alias("avg"),
            F.array(*[F.count(F.when(p, 1)) for p in present]).alias("df"),
        )

    def write(self, path: str, *, buckets: int = 16, splits: int = 1, check_ids: bool = True) -> "StoredIndex":
        """Store the index; an index already at ``path`` is opened as it is."""
        spark = self.source.sparkSession
        try:
            return StoredIndex.open(spark, path, source=self.source, dictionary=self.dictionary)
        except FileNotFoundError:
            pass
        if check_ids:
            check_unique_ids(self.source, self.id_col)
        version = {"version": None, "fingerprint": None}
        if self.dictionary is not None and self.analyzer == "words":
            version = dictionary_version(self.dictionary).first().asDict()
        manifest = Manifest(
            version=1,
            analyzer=self.analyzer,
            id_col=self.id_col,
            id_type=self.source.schema[self.id_col].dataType.simpleString(),
            weights=self.weights,
            buckets=buckets,
            splits=splits,
            segments=[1],
            max_token_bytes=self.max_token_bytes,
            dictionary_version=version["version"],
            dictionary_fingerprint=version["fingerprint"],
        )
        manifest = replace(manifest, totals={"1": write_segment(self, path, manifest, 1)})
        write_manifest(spark, path, manifest)
        return StoredIndex(spark, path, manifest, self.source, self.dictionary)


def table_schema(name: str, id_type: str, segment: bool = False) -> str:
    """Columns of a stored table, so that no file has to be opened to learn them."""
    columns = {
        "postings": f"id {id_type}, field string, term string, tf int, len int, positions array<int>, bucket int",
        "doc_stats": f"id {id_type}, field string, len int",
        "term_levels": "term string, field string, tf int, n bigint, shortest int, bucket int",
        "gone_levels": "segment int, term string, field string, tf int, n bigint, bucket int",
        "tombstones": f"id {id_type}, segment int, field string, len int",
    }[name]
    return columns + (", segment int" if segment else "")


@dataclass(frozen=True)
class Manifest:
    """What a reader must know; written last, so a reader sees whole versions only."""

    version: int
    analyzer: str
    id_col: str
    id_type: str
    weights: dict[str, float]
    buckets: int
    splits: int
    segments: list[int]
    max_token_bytes: int | None = None
    dictionary_version: int | None = None
    dictionary_fingerprint: int | None = None
    tombstones: list[int] = field(default_factory=list)
    totals: dict[str, dict[str, list[int]]] = field(default_factory=dict)
    dead: dict[str, dict[str, list[int]]] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)

    def next(self, **changes) -> "Manifest":
        return replace(self, version=self.version + 1, **changes)


def write_manifest(spark: SparkSession, path: str, manifest: Manifest) -> None:
    body = json.dumps(asdict(manifest))
    spark.createDataFrame([(body,)], "body string").coalesce(1).write.mode("errorifexists").parquet(
        f"{path}/manifest/version={manifest.version}"
    )


def write_segment(index: TextIndex, path: str, manifest: Manifest, segment: int) -> dict[str, list[int]]:
    """Write the rows of ``index`` as one segment; returns its totals by field.

    Postings move once, by bucket and document hash: a term in a third of all
    documents is spread over ``splits`` files of its bucket, or more where the segment has
    many tokens. Every part is a task's own: dealt by a hash of its numbers, several would
    meet in one task. The levels of the terms are counted from the written postings, without
    their positions.
    """
    spark = index.source_spark()
    stats = f"{path}/doc_stats/segment={segment}"
    index.doc_stats().write.mode("overwrite").parquet(stats)
    written = spark.read.schema(table_schema("doc_stats", manifest.id_type)).parquet(stats)
    # At most one row per field; an empty segment has none.
    totals = {r["field"]: [r["n_docs"], r["total_len"]] for r in TextIndex.totals(written).collect()}
    splits = splits_for(manifest, totals)
    bucket = bucket_of(F.col("term"), manifest.buckets)
    split = F.pmod(F.xxhash64("id"), F.lit(splits)).cast("int")
    laid_out = (
        index.postings()
        .withColumn("bucket", bucket)
        .repartitionById(manifest.buckets * splits, F.col("bucket") * splits + split)
        .sortWithinPartitions("bucket", "term", "id")
    )
    laid_out.write.mode("overwrite").partitionBy("bucket").parquet(
        f"{path}/postings/segment={segment}"
    )
    postings = spark.read.schema(table_schema("postings", manifest.id_type)).parquet(f"{path}/postings/segment={segment}")
    levels = levels_of(postings, ["bucket"], len(manifest.weights) > 1)
    write_levels(levels, f"{path}/term_levels/segment={segment}", manifest.buckets, splits)
    return totals


def splits_for(manifest: Manifest, *totals: dict[str, list[int]]) -> int:
    """Parts of a bucket, so that about ``FILE_TOKENS`` tokens of ``totals`` come to one."""
    tokens = sum(length or 0 for held in totals for _, length in held.values())
    return max(manifest.splits, -(-tokens // (manifest.buckets * FILE_TOKENS)))


def tasks_for(tokens: int) -> int:
    """Tasks, so that about ``FILE_TOKENS`` tokens or postings come to one."""
    return max(1, -(-tokens // FILE_TOKENS))


def write_levels(levels: DataFrame, target: str, buckets: int, splits: int) -> None:
    """Store a table of levels by its ``bucket``: as many rows as terms have frequencies.

    A bucket is written by up to ``splits`` tasks, a term by one.
    """
    split = F.pmod(F.xxhash64("term", F.lit("levels")), F.lit(splits)).cast("int")
    dealt = levels.repartitionById(buckets * splits, F.col("bucket") * splits + split)
    laid_out = dealt.sortWithinPartitions("bucket", "term")
    laid_out.write.mode("overwrite").partitionBy("bucket").parquet(target)


class StoredIndex(TextIndex):
    """An index read from Parquet tables."""

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        manifest: Manifest,
        source: DataFrame | None = None,
        dictionary: DataFrame | None = None,
    ) -> None:
        self.spark, self.path, self.manifest = spark, path, manifest
        self.source, self.dictionary = source, dictionary
        self.id_col, self.analyzer = manifest.id_col, manifest.analyzer
        self.weights, self.fields = manifest.weights, list(manifest.weights)

    @classmethod
    def open(
        cls,
        spark: SparkSession,
        path: str,
        source: DataFrame | None = None,
        dictionary: DataFrame | None = None,
    ) -> "StoredIndex":
        """The current version of the index at ``path``."""
        try:
            versions = spark.read.parquet(f"{path}/manifest")
        except AnalysisException:
            raise FileNotFoundError(f"no text index at {path!r}") from None
        body = versions.orderBy(F.col("version").desc()).select("body").first()
        return cls(spark, path, Manifest(**json.loads(body["body"])), source, dictionary)

    def _segments(self, table: str, segments: list[int] | None = None) -> DataFrame:
        """Rows of a table in the live segments, each with its segment number."""
        wanted = self.manifest.segments if segments is None else segments
        reader = self.spark.read.schema(table_schema(table, self.manifest.id_type, segment=True))
        return reader.option("basePath", f"{self.path}/{table}").parquet(
            *[f"{self.path}/{table}/segment={s}" for s in wanted]
        )

    def tombstones(self) -> DataFrame | None:
        """(id, segment, field, len) of deleted documents; None when nothing was deleted.

        A deletion covers the segments that existed then, so an id may return later.
        """
        if not self.manifest.tombstones:
            return None
        rows = self.spark.read.schema(table_schema("tombstones", self.manifest.id_type)).parquet(
            *[f"{self.path}/tombstones/version={v}" for v in self.manifest.tombstones]
        )
        return rows.where(F.col("segment").isin(*self.manifest.segments))

    def source_spark(self) -> SparkSession:
        return self.spark

    def _live_totals(self, name: str) -> tuple[int, int]:
        """(documents, tokens) of a field, out of the manifest."""
        n = length = 0
        for sign, kept in ((1, self.manifest.totals), (-1, self.manifest.dead)):
            for segment in self.manifest.segments:
                held = kept.get(str(segment), {}).get(name, (0, 0))
                n, length = n + sign * held[0], length + sign * held[1]
        return n, length

    def live_tokens(self) -> int:
        """Tokens of the live documents, all fields together."""
        return sum(self._live_totals(f)[1] for f in self.fields)

    def n_docs(self) -> Column:
        return F.lit(max(self._live_totals(f)[0] for f in self.fields)).cast("long")

    def mean_len(self, name: str) -> Column:
        n, length = self._live_totals(name)
        return F.lit(length / n if n else 0.0)

    def _live(self, rows: DataFrame) -> DataFrame:
        dead = self.tombstones()
        return rows if dead is None else rows.join(dead.select("id", "segment"), ["id", "segment"], "left_anti")

    def stored_postings(self, terms: list[str] | None = None) -> DataFrame:
        """Postings with dead documents, with the segment column."""
        return self._of_terms(self._segments("postings"), terms)

    def _of_terms(self, rows: DataFrame, terms: list[str] | None) -> DataFrame:
        if terms is None:
            return rows
        # Folded to numbers before planning, so only these folders are listed.
        buckets = [bucket_of(F.lit(t), self.manifest.buckets) for t in terms]
        return rows.where(F.col("term").isin(*terms)).where(F.col("bucket").isin(*buckets))

    def _among(self, rows: DataFrame, terms: DataFrame) -> DataFrame:
        """The rows of the buckets that the terms of a table are in.

        The bucket numbers come to the driver first, at most one for each bucket.
        """
        number = bucket_of(F.col("term"), self.manifest.buckets)
        asked = [r["b"] for r in terms.select(number.alias("b")).distinct().collect()]
        return rows.where(F.col("bucket").isin(*asked)) if asked else rows.limit(0)

    def term_levels(self) -> DataFrame:
        """(segment, bucket, term, field, tf, n, shortest); rows of dead documents have a negative n."""
        held = self._segments("term_levels")
        if not self.manifest.tombstones:
            return held
        reader = self.spark.read.schema(table_schema("gone_levels", self.manifest.id_type))
        gone = reader.option("basePath", f"{self.path}/gone_levels").parquet(
            *[f"{self.path}/gone_levels/version={v}" for v in self.manifest.tombstones]
        )
        gone = gone.where(F.col("segment").isin(*self.manifest.segments)).withColumn("n", -F.col("n"))
        return held.unionByName(gone.withColumn("shortest", F.lit(None).cast("int")).select(*held.columns))

    def _df(self, levels: DataFrame) -> DataFrame:
        if self.multi_field:
            levels = levels.where(F.col("field").isNull())
        return levels.groupBy("term").agg(F.sum("n").alias("df")).where(F.col("df") > 0)

    def term_stats(self, terms: list[str] | None = None) -> DataFrame:
        """(term, df) out of the stored levels; no postings are read."""
        return self._df(self._of_terms(self.term_levels(), terms))

    def term_stats_among(self, terms: DataFrame) -> DataFrame:
        return self._df(self._among(self.term_levels(), terms)).join(terms, "term", "left_semi")

    def live_levels(self, terms: DataFrame | None = None) -> DataFrame:
        """(term, field, tf, n, shortest) over the live documents of all segments.

        ``shortest`` may be that of a dead document until the index is compacted, so it
        is a lower bound then.
        """
        levels = self.term_levels() if terms is None else self._among(self.term_levels(), terms)
        live = (
            levels.groupBy("term", "field", "tf")
            .agg(F.sum("n").alias("n"), F.min("shortest").alias("shortest"))
            .where(F.col("n") > 0)
        )
        return live if terms is None else live.join(terms, "term", "left_semi")

    def postings(self, terms: list[str] | None = None) -> DataFrame:
        return self._live(self.stored_postings(terms)).select(*POSTING_COLUMNS)

    def postings_among(self, terms: DataFrame | None) -> DataFrame:
        """Postings of the terms of a table; only the folders that they are in are opened."""
        if terms is None:
            return self.postings()
        return self._live(self._among(self.stored_postings(), terms)).select(*POSTING_COLUMNS).join(
            terms, "term", "left_semi"
        )

    def stored_doc_stats(self) -> DataFrame:
        return self._segments("doc_stats")

    def doc_stats(self) -> DataFrame:
        return self._live(self.stored_doc_stats()).select("id", "field", "len")

    def candidates(self, leaves: list[Leaf], positions: bool) -> DataFrame:
        terms = [leaf.term for leaf in leaves]
        columns: list[Column] = [
            F.max(F.when(F.col("field") == f, F.col("len"))).alias(f"len_{f}") for f in self.fields
        ]
        for leaf in leaves:
            for f in self.fields:
                mine = (F.col("term") == leaf.term) & (F.col("field") == f)
                columns.append(
                    F.coalesce(F.max(F.when(mine, F.col("tf"))), F.lit(0)).alias(
                        f"tf_{leaf.number}_{f}"
                    )
                )
                if positions:
                    columns.append(
                        F.coalesce(
                            F.max(F.when(mine, F.col("positions"))), F.array().cast("array<int>")
                        ).alias(f"pos_{leaf.number}_{f}")
                    )
        return self.postings(terms).groupBy("id").agg(*columns)

    def collection_row(self, candidates: DataFrame, leaves: list[Leaf], present: list[Column]) -> DataFrame:
        means = [self.mean_len(f) for f in self.fields]
        found = [F.max(F.when(F.col("term") == leaf.term, F.col("df"))) for leaf in leaves]
        counted = self.term_stats([leaf.term for leaf in leaves]).agg(
            F.array(*[F.coalesce(f, F.lit(0)) for f in found]).alias("df")
        )
        return counted.select(self.n_docs().alias("n"), F.array(*means).alias("avg"), "df")

    def frame_index(self, rows: DataFrame, dictionary: DataFrame | None = None) -> FrameIndex:
        """A frame index over ``rows`` with this index's settings."""
        return FrameIndex(
            rows,
            self.id_col,
            self.fields,
            self.analyzer,
            self.weights if self.multi_field else None,
            dictionary if dictionary is not None else self.dictionary,
            self.manifest.max_token_bytes,
        )


def build_index(
    df: DataFrame,
    id_col: str,
    fields: list[str] | str | None = None,
    analyzer: str = "unicode",
    field_weights: dict[str, float] | None = None,
    dictionary: DataFrame | None = None,
    path: str | None = None,
    **layout,
) -> TextIndex:
    """An index over ``df``; with ``path`` it is stored there (or opened, if present)."""
    index = FrameIndex(df, id_col, fields or [], analyzer, field_weights, dictionary,
                       layout.pop("max_token_bytes", None))
    return index if path is None else index.write(path, **layout)
