"""Tokens, word segmentation, dictionaries, stop words and vocabulary work."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from rankweave.functions import stopwords
from rankweave.functions.stemming import stem_english
from rankweave.functions.text import ANALYZERS, split_bytes, tokens_of, word_chunks
from rankweave.session import broadcast_if_small

DICTIONARY_SCHEMA = "word string, freq long, tag string"


def check_analyzer(analyzer: str, dictionary: DataFrame | None) -> None:
    if analyzer not in ANALYZERS:
        raise ValueError(f"analyzer must be one of {ANALYZERS}, got {analyzer!r}")
    if analyzer == "words" and dictionary is None:
        raise ValueError("the words analyzer needs a dictionary of (word, freq, tag)")


def token_arrays(
    df: DataFrame,
    id_col: str,
    text_col: str,
    analyzer: str = "unicode",
    dictionary: DataFrame | None = None,
) -> DataFrame:
    """One row per input row: (id, tokens), tokens in text order."""
    check_analyzer(analyzer, dictionary)
    if analyzer == "words":
        return segment_words(df, id_col, text_col, dictionary)
    tokens = F.coalesce(tokens_of(F.col(text_col), analyzer), F.array().cast("array<string>"))
    return df.select(F.col(id_col).alias("id"), tokens.alias("tokens"))


def tokenize(
    df: DataFrame,
    id_col: str,
    text_col: str,
    analyzer: str = "unicode",
    dictionary: DataFrame | None = None,
) -> DataFrame:
    """(id, pos, term) for every token; positions count from 0."""
    arrays = token_arrays(df, id_col, text_col, analyzer, dictionary)
    return arrays.select("id", F.posexplode("tokens").alias("pos", "term"))


def word_stats(
    df: DataFrame, id_col: str, text_col: str, analyzer: str = "unicode",
    dictionary: DataFrame | None = None,
) -> DataFrame:
    """(word, ndoc, nentry): rows holding the word, and its occurrences.

    Each row first counts its own distinct words, so one partial sum per word and
    task is shuffled and no distinct count over ids is needed.
    """
    from rankweave.operators.text_index import term_groups

    arrays = token_arrays(df, id_col, text_col, analyzer, dictionary)
    return (
        term_groups(arrays.select("id", "tokens"))
        .groupBy(F.col("term").alias("word"))
        .agg(F.count("*").alias("ndoc"), F.sum("tf").cast("long").alias("nentry"))
    )


# -- word segmentation ---------------------------------------------------------


def _cut_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Most probable word path of each Han run, from right to left."""
    for batch in batches:
        cuts = []
        for run, found, total in zip(batch["run"], batch["found"], batch["total"]):
            n = len(run)
            unknown = -math.log(total) if total and total > 0 else 0.0
            options: list[list[tuple[int, float]]] = [[] for _ in range(n)]
            for hit in found if found is not None else ():
                options[hit["start"]].append(
                    (hit["start"] + hit["size"], math.log(hit["freq"]) + unknown)
                )
            best = [0.0] * (n + 1)
            step = [0] * n
            for i in range(n - 1, -1, -1):
                moves = options[i]
                if all(end != i + 1 for end, _ in moves):
                    moves = moves + [(i + 1, unknown)]
                best[i], step[i] = max((weight + best[end], end) for end, weight in moves)
            words, at = [], 0
            while at < n:
                words.append(run[at : step[at]])
                at = step[at]
            cuts.append(words)
        yield pd.DataFrame({"run": batch["run"], "words": cuts})


def segment_runs(runs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(run, words) for the distinct values of ``runs.run``.

    Every substring up to the longest dictionary word is looked up by an equi-join,
    so the dictionary may be of any size; the path itself is a small per-run step.
    """
    known = dictionary.where("freq > 0").select("word", F.col("freq").cast("double").alias("freq"))
    longest = known.select(F.max(F.length("word"))).scalar()
    total = known.select(F.sum("freq")).scalar()
    distinct = runs.select("run").distinct()
    size = F.length("run")
    pieces = distinct.select(
        "run",
        F.explode(F.sequence(F.lit(1), size)).alias("at"),
        size.alias("n"),
        F.lit(longest).alias("longest"),
    ).select(
        "run",
        (F.col("at") - 1).alias("start"),
        F.explode(
            F.sequence(F.lit(1), F.least(F.col("longest"), F.col("n") - F.col("at") + 1))
        ).alias("size"),
        "at",
    )
    looked_up = pieces.withColumn("word", F.substring("run", F.col("at"), F.col("size"))).join(
        broadcast_if_small(known), "word"
    )
    found = looked_up.groupBy("run").agg(
        F.collect_list(F.struct("start", "size", "freq")).alias("found")
    )
    joined = distinct.join(found, "run", "left").select(
        "run", "found", F.lit(total).alias("total")
    )
    return joined.mapInPandas(_cut_runs, "run string, words array<string>")


def segment_words(
    df: DataFrame, id_col: str, text_col: str, dictionary: DataFrame
) -> DataFrame:
    """(id, tokens): Han runs cut into dictionary words, the rest case folded."""
    chunks = df.select(
        F.col(id_col).alias("id"),
        F.coalesce(word_chunks(F.col(text_col)), F.array().cast("array<string>")).alias("chunks"),
    )
    runs = chunks.select(
        "id", F.explode(F.array_distinct("chunks")).alias("run")
    ).where(F.col("run").rlike(r"^\p{IsHan}"))
    cuts = segment_runs(runs, dictionary)
    # A run's cut is one row, so only the side of the texts can be skewed.
    per_row = (
        runs.join(cuts, "run")
        .groupBy("id")
        .agg(F.map_from_entries(F.collect_list(F.struct("run", "words"))).alias("cut"))
    )
    return chunks.join(per_row, "id", "left").select(
        "id",
        F.flatten(
            F.transform(
                "chunks", lambda c: F.coalesce(F.element_at(F.col("cut"), c), F.array(c))
            )
        ).alias("tokens"),
    )


def add_words(dictionary: DataFrame, rows: DataFrame) -> DataFrame:
    """The dictionary with ``rows`` added; an existing word takes the new entry."""
    rows = rows.select("word", F.col("freq").cast("long").alias("freq"), "tag")
    return dictionary.join(rows.select("word"), "word", "left_anti").select(
        "word", "freq", "tag"
    ).unionByName(rows)


def delete_words(dictionary: DataFrame, rows: DataFrame) -> DataFrame:
    """The dictionary without the words of ``rows``."""
    return dictionary.join(rows.select("word"), "word", "left_anti").select("word", "freq", "tag")


def dictionary_version(dictionary: DataFrame) -> DataFrame:
    """One row (version, fingerprint) that depends on the entries, not their order."""
    entry = F.xxhash64("word", F.col("freq").cast("long"), F.coalesce("tag", F.lit("")))
    return dictionary.agg(
        F.count("*").alias("version"),
        F.coalesce(F.bit_xor(entry), F.lit(0).cast("long")).alias("fingerprint"),
    )


# -- stop words ----------------------------------------------------------------


def stop_words(spark: SparkSession, preset: str = "auto") -> DataFrame:
    """(word) rows of a preset."""
    return spark.createDataFrame([(w,) for w in stopwords.words(preset)], "word string")


def drop_stop_words(tokens: DataFrame, preset: str = "auto", words: list[str] | None = None) -> DataFrame:
    """Token rows whose ``term`` is not a stop word; positions stay as they were."""
    listed = stopwords.words(preset) if words is None else words
    return tokens.where(~F.col("term").isin(*listed)) if listed else tokens


# -- long tokens and stems -----------------------------------------------------


def split_long_tokens(tokens: DataFrame, max_bytes: int) -> DataFrame:
    """Tokens longer than ``max_bytes`` cut into pieces; positions are renumbered.

    Each piece takes a position of its own: every token moves on by the number of
    extra pieces before it in its row.
    """
    if max_bytes < 4:
        raise ValueError("max_bytes must be at least 4, the longest UTF-8 character")
    pieces = tokens.select("id", "pos", F.posexplode(split_bytes(F.col("term"), max_bytes)).alias("piece", "term"))
    return (
        pieces.groupBy("id")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "piece", "term"))).alias("__all"))
        .select("id", F.posexplode("__all").alias("pos", "__one"))
        .select("id", "pos", F.col("__one.term").alias("term"))
    )


def split_long_in_arrays(arrays: DataFrame, max_bytes: int) -> DataFrame:
    """The same on (id, tokens) rows, without moving any data."""
    if max_bytes < 4:
        raise ValueError("max_bytes must be at least 4, the longest UTF-8 character")
    return arrays.withColumn(
        "tokens", F.flatten(F.transform("tokens", lambda t: split_bytes(t, max_bytes)))
    )


def drop_long_tokens(tokens: DataFrame, max_bytes: int = 2047) -> DataFrame:
    """Token rows of at most ``max_bytes`` bytes."""
    return tokens.where(F.octet_length("term") <= max_bytes)


@F.pandas_udf(StringType())
def _stem(words: pd.Series) -> pd.Series:
    return words.map(stem_english)


def stem_vocabulary(terms: DataFrame, lang: str = "english") -> DataFrame:
    """(term, stem) for the distinct values of ``terms.term``."""
    if lang != "english":
        raise ValueError(f"no stemmer for {lang!r}")
    return terms.select("term").distinct().select("term", _stem("term").alias("stem"))


def stem_tokens(tokens: DataFrame, lang: str = "english") -> DataFrame:
    """Token rows with every term replaced by its stem."""
    stems = stem_vocabulary(tokens, lang)
    return (
        tokens.join(stems, "term")
        .select(*[F.col("stem").alias("term") if c == "term" else F.col(c) for c in tokens.columns])
    )
