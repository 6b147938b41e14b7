"""Toxicity by multiple-instance learning: sentence scores joined by noisy-or.

A document is toxic if one of its sentences is: p(document) = 1 - prod(1 - p(sentence)),
where p(sentence) is the logistic of its hashed words' weights. Only documents are
labelled; the weights are fitted to the documents' likelihood, and the sentences that
cause a score can then be named.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.llm.common import map_texts
from rankweave.session import stored

# Bound of the labelled sample that the model is fitted on: whole texts of each class.
TRAIN_DOCS = 5_000
SLOTS = 1 << 18
EPOCHS = 60
# Pull of the weights towards zero.
SHRINK = 1e-6
# Least chi-square of a word's presence and the label; the rest would be learnt by heart.
TELLING = 20.0
CACHE_WORDS = 150_000
# Log odds of a sentence without any telling word, to begin with.
START_BIAS = -6.0

PIECE = re.compile(r"[^\W\d_]+|[.!?\n]")
ENDS = frozenset(".!?\n")


def word_slot(word: str) -> int:
    return zlib.crc32(word.encode()) % SLOTS


@dataclass
class Model:
    """One weight for each slot, and the log odds of a sentence without words."""

    weights: np.ndarray
    bias: float


def _sentences(pieces: list[str], slot_of) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all words, and the sentence number of each."""
    slots, owner, number = [], [], 0
    for piece in pieces:
        if piece in ENDS:
            number += 1
        else:
            slots.append(slot_of(piece))
            owner.append(number)
    return np.array(slots, np.int64), np.array(owner, np.int64)


def _noisy_or(logits: np.ndarray) -> float:
    """1 - prod(1 - sigmoid(logit)), from sums of logarithms."""
    return float(-np.expm1(-np.logaddexp(0.0, logits).sum()))


def learn(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    per_class: int = TRAIN_DOCS,
    epochs: int = EPOCHS,
) -> Model:
    """Fit on ``per_class`` labelled whole texts of each class at most.

    Keys are drawn from ``labels`` by their hash, and are then few enough to be broadcast to
    the texts. Of the texts that they have, repeated rows count once, and at most
    ``per_class`` of a class by a hash of key and text are moved. A key with both labels
    takes part with both. Labels other than 0 and 1, null keys and null texts take no part. Classes are weighted back to their counted shares. The sample
    is turned into slots on the executors; the driver fits full-batch (Adam).
    """
    known = labels.select(F.col(key).alias("id"), F.col(label).cast("int").alias("label")).where(
        F.col("id").isNotNull() & F.col("label").isin(0, 1)
    )
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return Model(np.zeros(SLOTS, np.float32), START_BIAS)
    draw = F.when(F.col("label") == 1, min(1.0, per_class / sizes[1])).otherwise(min(1.0, per_class / sizes[0]))
    # A third of all labels on one key would still be drawn whole, so repeats go first.
    some = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < draw * (1 << 20)).distinct()
    texts = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("hash"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    named = texts.select("id", "hash").join(F.broadcast(some), "id").distinct()
    order = F.xxhash64("id", "hash")
    bounded = [named.where(F.col("label") == y).orderBy(order, "id", "hash").limit(per_class) for y in (0, 1)]
    kept = stored(bounded[0].unionByName(bounded[1]), "toxicity-sample")
    met = texts.join(F.broadcast(kept), ["id", "hash"])
    drawn = met.groupBy("id", "hash", "label").agg(F.first("text").alias("text")).select("text", "label")

    def featurise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for said, y in zip(batch["text"], batch["label"]):
                slots, owner = _sentences(PIECE.findall(said.lower()), word_slot)
                # A word counts once in a sentence.
                pairs = np.unique(owner * SLOTS + slots)
                out.append((y, (pairs // SLOTS).astype(np.int32).tobytes(), (pairs % SLOTS).astype(np.int32).tobytes()))
            yield pd.DataFrame(out, columns=["label", "owner", "slots"])

    sample = drawn.mapInPandas(featurise, "label int, owner binary, slots binary").toPandas()
    return _fit(sample, {y: n / sum(sizes.values()) for y, n in sizes.items()}, epochs)


def _telling(document: np.ndarray, slots: np.ndarray, labels: np.ndarray, least: float) -> np.ndarray:
    """Which slots occur in toxic and other documents at rates that differ beyond chance."""
    pairs = np.unique(document * SLOTS + slots)
    toxic = labels[pairs // SLOTS] == 1
    with_toxic, with_clean = (np.bincount(pairs[t] % SLOTS, minlength=SLOTS) for t in (toxic, ~toxic))
    n_toxic, n_clean = (labels == 1).sum(), (labels == 0).sum()
    seen = with_toxic + with_clean
    cross = with_toxic * (n_clean - with_clean) - with_clean * (n_toxic - with_toxic)
    below = np.maximum(seen * (len(labels) - seen) * float(n_toxic) * n_clean, 1)
    return len(labels) * cross.astype(float) ** 2 / below >= least


def _fit(
    sample: pd.DataFrame, share: dict[int, float], epochs: int = EPOCHS, shrink: float = SHRINK, telling: float = TELLING
) -> Model:
    """Full-batch ascent of the weighted log likelihood of the document labels."""
    labels = sample["label"].to_numpy(float)
    weight = np.where(labels == 1, share[1] / max(labels.sum(), 1), share[0] / max((1 - labels).sum(), 1))
    slots, sentence, document, at = [], [], [], 0
    for number, (owner, words) in enumerate(zip(sample["owner"], sample["slots"])):
        own = np.frombuffer(owner, np.int32)
        kinds, inverse = np.unique(own, return_inverse=True)
        slots.append(np.frombuffer(words, np.int32))
        sentence.append(inverse + at)
        document.append(np.full(len(kinds), number))
        at += len(kinds)
    slots, sentence, document = (np.concatenate(x) if x else np.zeros(0, int) for x in (slots, sentence, document))
    kept = _telling(document[sentence], slots, labels, telling)[slots]
    slots, sentence = slots[kept], sentence[kept]
    used, column = np.unique(slots, return_inverse=True)
    w, bias = np.zeros(len(used)), START_BIAS
    m, v, mb, vb = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    for step in range(1, epochs + 1):
        z = np.bincount(sentence, w[column], at) + bias
        clean = np.bincount(document, np.logaddexp(0, z), len(labels))  # -log(1 - p) of each document
        # d log L / dz: -sigmoid(z) if clean, sigmoid(z) * (1 - p) / p if toxic
        odds = np.where(labels == 1, 1 / np.expm1(np.clip(clean, 1e-9, 700)), -1.0) * weight
        slope = odds[document] / (1 + np.exp(-z))
        g = np.bincount(column, slope[sentence], len(used)) - shrink * w
        gb = slope.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**step, 1 - 0.999**step
        w += 0.3 * (m / c1) / (np.sqrt(v / c2) + 1e-6)
        bias += 0.1 * (mb / c1) / (np.sqrt(vb / c2) + 1e-6)
    weights = np.zeros(SLOTS, np.float32)
    weights[used] = w
    return Model(weights, float(bias))


class Scorer:
    """Scores of texts under a model, with the weights of known words at hand."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def _weight(self, word: str) -> float:
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        value = self.known[word] = float(self.model.weights[word_slot(word)])
        return value

    def sentences(self, text: str | None) -> np.ndarray:
        """The log odds of each sentence that has a word. A word counts once in it."""
        known, odds = self.known, []
        for said in re.split(r"[.!?\n]", (text or "").lower()):
            words = set(PIECE.findall(said))
            if words:
                odds.append(self.model.bias + sum([known[w] if w in known else self._weight(w) for w in words]))
        return np.array(odds)

    def document(self, text: str | None) -> float:
        """Noisy-or of the sentences; a text without words counts as one empty sentence."""
        odds = self.sentences(text)
        return _noisy_or(odds if len(odds) else np.array([self.model.bias]))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of each row, null keys, repeated rows and empty texts included.

    Other columns are not carried. Memory per task is the model, a bounded word store
    and one Arrow batch.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        scorer = Scorer(shared.value)
        return lambda texts: (None, [list(map(scorer.document, texts))])

    return map_texts(docs, [key], text, {"score": "double"}, start)


def locate(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", least: float = 0.3) -> DataFrame:
    """(key, start, end, score): the sentences whose own score is ``least`` or more.

    Positions are code points of the text as it stands.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        scorer = Scorer(shared.value)

        def find(texts):
            rows = []
            for i, said in enumerate(texts):
                for m in re.finditer(r"[^.!?\n]+", said or ""):
                    odds = scorer.sentences(m.group())
                    if len(odds) and (p := float(1 / (1 + np.exp(-odds[0])))) >= least:
                        rows.append((i, m.start(), m.end(), p))
            at, *columns = zip(*rows) if rows else ([],) * 4
            return at, columns

        return find

    return map_texts(docs, [key], text, {"start": "long", "end": "long", "score": "double"}, start)
