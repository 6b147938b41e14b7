"""Language identification of mixed text: scripts, word scores, and a path with switches.

Letters name a script by their code point range, and a language is a candidate for a
word only if it was seen in that script. A word's score for a language is the log
likelihood of its letter n-grams (naive Bayes over hashed n-grams). The best path over
the words of a text, where a change of language costs a fixed penalty, labels spans;
the language with most letters is the text's.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankweave.llm.common import map_texts
from rankweave.session import broadcast_if_small, stored

# Bound of the sample that the model is fitted on: whole texts per language.
TRAIN_DOCS = 3_000
# Parts of a language in which the sample is drawn first.
PARTS = 64
# Slots of the n-gram table; the model has this many numbers per language.
SLOTS = 1 << 16
GRAMS = (1, 2, 3)
# Cost of a change of language, in units of log likelihood.
SWITCH = 14.0
# Share of a language's letters that a script needs to count as one of its scripts.
SCRIPT_SHARE = 0.02
# Words whose scores a task keeps; beyond it the store is emptied, at no loss.
CACHE_WORDS = 150_000
UNKNOWN = "und"

WORD = re.compile(r"[^\W\d_]+")
# First code points of script ranges, in order.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"),
    (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "other"), (0x0900, "devanagari"),
    (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "other"), (0x3040, "kana"), (0x3100, "han"), (0xA000, "other"),
    (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"),
    (0x20000, "han"),
)
STARTS = np.array([s for s, _ in SCRIPTS])
NAMES = sorted({n for _, n in SCRIPTS})
SCRIPT_OF = np.array([NAMES.index(n) for _, n in SCRIPTS])


def scripts_of(words: list[str]) -> np.ndarray:
    """The script of each word's first letter, as a number in ``NAMES``."""
    return SCRIPT_OF[np.searchsorted(STARTS, [ord(w[0]) for w in words], "right") - 1]


def grams_of(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n: the slots of all words' n-grams, their ends marked, and where each word's begin.

    The n-grams of all words are hashed at once. Marked words have three characters at
    least, so no word is without an n-gram of any length.
    """
    text = "".join([f"<{w}>" for w in words])
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words])
    ends = np.repeat(np.cumsum(sizes), sizes)
    value = np.zeros(len(codes), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        rows = len(codes) - n + 1
        value = value[:rows] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :] + np.uint64(n)
        if n not in GRAMS:
            continue
        mixed = (value ^ value >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        inside = np.arange(n, rows + n) <= ends[:rows]
        slots = (mixed >> np.uint64(40))[inside] % np.uint64(SLOTS)
        yield slots.astype(np.int64), np.concatenate([[0], np.cumsum(sizes - n + 1)[:-1]])


@dataclass
class Model:
    """Languages, log likelihood of each slot for each, and the scripts of each."""

    languages: list[str]
    weights: np.ndarray
    scripts: np.ndarray

    def score(self, words: list[str]) -> np.ndarray:
        """Log likelihoods, a row for each word, less the best of the row.

        Languages not written in a word's script have minus infinity; where that leaves
        none, all are candidates.
        """
        fits = self.scripts[scripts_of(words)]
        fits[~fits.any(axis=1)] = True
        total = sum(np.add.reduceat(self.weights[slots], starts) for slots, starts in grams_of(words))
        total = np.where(fits, total, -np.inf)
        return (total - total.max(axis=1, keepdims=True)).astype(np.float32)


def _sample(docs: DataFrame, text: str, lang: str, per_language: int) -> tuple[DataFrame, list[str]]:
    """(text, lang) of at most ``per_language`` distinct texts of each language, and the languages."""
    labelled = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(text).alias("hash")).where(
        F.col("lang").isNotNull() & F.col("text").isNotNull()
    )
    # A language may have a third of all texts: the first of each part, then the first of those.
    names = labelled.select("lang", "hash").distinct().withColumn("part", F.pmod("hash", F.lit(PARTS)))
    for group in (["lang", "part"], ["lang"]):
        order = Window.partitionBy(*group).orderBy("hash")
        names = names.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_language).drop("n")
    kept = stored(names.select("lang", "hash"), "language-sample")
    languages = sorted(r["lang"] for r in kept.select("lang").distinct().collect())
    drawn = labelled.join(broadcast_if_small(kept), ["lang", "hash"])
    return drawn.groupBy("lang", "hash").agg(F.first("text").alias("text")).select("text", "lang"), languages


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", per_language: int = TRAIN_DOCS) -> Model:
    """Fit the model on at most ``per_language`` whole texts of each non-null language.

    The sample is the distinct texts with the smallest hashes of their content, up to the
    bound exactly; copies of a text count once. Counts are made by Spark, which moves
    hashes, and copies of the drawn texts once for each task; the driver gets sums for each
    language, slot and script, whose number does not grow with the rows.
    """
    drawn, languages = _sample(docs, text, lang, per_language)
    if not languages:
        return Model([], np.zeros((SLOTS, 0), np.float32), np.zeros((len(NAMES), 0), bool))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for said, label in zip(batch["text"], batch["lang"]):
                row = sums.setdefault(label, np.zeros(SLOTS + len(NAMES)))
                times = Counter(WORD.findall(said.lower()))
                if not times:
                    continue
                words, often = list(times), np.array(list(times.values()))
                for slots, starts in grams_of(words):
                    each = np.repeat(often, np.diff(np.append(starts, len(slots))))
                    row[:SLOTS] += np.bincount(slots, each, SLOTS)
                row[SLOTS:] += np.bincount(scripts_of(words), often * [len(w) for w in words], len(NAMES))
        for label, row in sums.items():
            at = np.flatnonzero(row)
            yield pd.DataFrame({"lang": label, "slot": at, "n": row[at]})

    counted = drawn.mapInPandas(count, "lang string, slot int, n double").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    table = counted.toPandas()
    both = np.zeros((SLOTS + len(NAMES), len(languages)))
    both[table["slot"], [languages.index(x) for x in table["lang"]]] = table["n"]
    grams, letters = both[:SLOTS], both[SLOTS:]
    smooth = 0.5
    # Overlapping n-grams repeat evidence: a word counts as one of its n-gram orders.
    weights = np.log((grams + smooth) / (grams.sum(axis=0) + smooth * SLOTS)) / len(GRAMS)
    scripts = letters >= SCRIPT_SHARE * np.maximum(letters.sum(axis=0), 1)
    return Model(languages, weights.astype(np.float32), scripts)


def best_path(scores: np.ndarray, penalty: float = SWITCH) -> np.ndarray:
    """The states of the path with the largest sum of scores less penalties (Viterbi).

    If no stretch of words gains more than one change costs by leaving the language
    that is best overall, the path never leaves it; this test is exact and spares the
    walk for unmixed texts.
    """
    n, states = scores.shape
    sums = scores.sum(axis=0, dtype=np.float64)
    home = int(sums.argmax())
    if states == 1:
        return np.zeros(n, np.int16)
    if np.isfinite(sums[home]):
        gain = np.delete(scores, home, 1).max(axis=1).astype(np.float64) - scores[:, home]
        run = np.concatenate([[0.0], np.cumsum(gain)])
        if (run - np.minimum.accumulate(run)).max() <= penalty and run[-1] <= 0:
            return np.full(n, home, np.int16)
    # Plain numbers: a step's few states are too short for array operations.
    rows = scores.tolist()
    value, back = rows[0], []
    for row in rows[1:]:
        best = max(value)
        moved = best - penalty
        back.append((value.index(best), [v >= moved for v in value]))
        value = [(v if v >= moved else moved) + s for v, s in zip(value, row)]
    path = np.empty(n, np.int16)
    state = value.index(max(value))
    path[n - 1] = state
    for t in range(n - 2, -1, -1):
        top, stay = back[t]
        if not stay[state]:
            state = top
        path[t] = state
    return path


class Labeller:
    """Spans of texts under a model, with the scores of known words at hand."""

    def __init__(self, model: Model):
        self.model = model
        self.rows: dict[str, int] = {}
        self.table = np.empty((1024, len(model.languages)), np.float32)

    def scores(self, words: list[str]) -> np.ndarray:
        if len(self.rows) > CACHE_WORDS:
            self.rows.clear()
        known = self.rows
        fresh = list(set(words).difference(known))
        if fresh:
            begin, end = len(known), len(known) + len(fresh)
            while end > len(self.table):
                self.table = np.concatenate([self.table, np.empty_like(self.table)])
            self.table[begin:end] = self.model.score(fresh)
            known.update(zip(fresh, range(begin, end)))
        return self.table[[known[w] for w in words]]

    def spans(self, text: str | None) -> list[tuple[str, int, int, int]]:
        """(language, start, end, letters) of each span, positions in code points."""
        found = list(WORD.finditer(text or ""))
        if not found or not self.model.languages:
            return []
        path = best_path(self.scores([m.group().lower() for m in found]))
        cuts = [0, *(np.flatnonzero(np.diff(path)) + 1), len(path)]
        return [
            (
                self.model.languages[path[a]],
                found[a].start(),
                found[b - 1].end(),
                sum(len(m.group()) for m in found[a:b]),
            )
            for a, b in zip(cuts, cuts[1:])
        ]

    def main(self, text: str | None) -> tuple[str, float]:
        """The language with most letters (ties to the first by name) and its share of them."""
        words = WORD.findall((text or "").lower())
        if not words or not self.model.languages or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        path = best_path(self.scores(words))
        letters = np.bincount(path, [len(w) for w in words], len(self.model.languages))
        top = int(letters.argmax())
        return self.model.languages[top], float(letters[top] / letters.sum())


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) of each row: main language and its share of the letters.

    A text that is null or has no letter is ``und`` with score 0. Every row gives one
    row, repeated rows and null keys included; other columns are not carried. Memory
    per task is the model, a bounded word store and one Arrow batch.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        labeller = Labeller(shared.value)
        return lambda texts: (None, list(zip(*map(labeller.main, texts))) or [[], []])

    return map_texts(docs, [key], text, {"lang_pred": "string", "score": "double"}, start)


def keep_identified(docs: DataFrame, model: Model, text: str = "text", least: float = 0.35) -> DataFrame:
    """The rows of ``docs``, all columns, whose text has a main language.

    Rejected are texts that are ``und`` (null, or without a letter), and those of which no
    language has the share ``least`` of the letters.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        labeller = Labeller(shared.value)

        def choose(texts):
            found = map(labeller.main, texts)
            return [i for i, (name, share) in enumerate(found) if name != UNKNOWN and share >= least], []

        return choose

    return map_texts(docs, docs.columns, text, {}, start)


def spans(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang, start, end, letters): one row for each span of one language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        labeller = Labeller(shared.value)

        def label(texts):
            rows = [(i, *s) for i, t in enumerate(texts) for s in labeller.spans(t)]
            at, *columns = zip(*rows) if rows else ([],) * 5
            return at, columns

        return label

    return map_texts(docs, [key], text, {"lang": "string", "start": "long", "end": "long", "letters": "long"}, start)
