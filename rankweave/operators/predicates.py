"""Model predicates: questions about texts and rows, answered by a model.

The model is either a fitted :class:`NaiveBayes`, which is scored with joins and sums, or
a callable: it takes a list of requests (dicts) and returns as many answers (dicts), and
is called in tasks, in batches, once per distinct input. No network is used here.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankweave.functions.text import tokens_of
from rankweave.session import BROADCAST_ROWS, at_most, durable, stored

Scorer = Callable[[list[dict]], list[dict]]
ANSWER = (
    "choice string, confidence double, probabilities map<string,double>, number double, "
    "model string, input_tokens long, output_tokens long"
)


@dataclass(frozen=True)
class NaiveBayes:
    """A multinomial model of labelled texts, as tables.

    ``priors`` is (label, log_prior); ``weights`` is (term, label, log_weight) for every
    known term with every label. ``yes`` is the label that yes-or-no questions ask for.
    """

    priors: DataFrame
    weights: DataFrame
    yes: str
    analyzer: str = "unicode"
    name: str = "naive-bayes"

    @classmethod
    def fit(cls, df: DataFrame, text: str, label: str, yes: str, analyzer: str = "unicode") -> "NaiveBayes":
        """Counts of terms by label, each count one more than seen. NULL labels take no part."""
        known = df.where(F.col(label).isNotNull()).select(F.col(label).cast("string").alias("label"), F.col(text).alias("t"))
        tokens = F.coalesce(tokens_of(F.col("t"), analyzer), F.array().cast("array<string>"))
        counted = stored(known.select("label", F.explode(tokens).alias("term")).groupBy("label", "term").agg(F.count("*").alias("n")), "counts")
        rows = known.groupBy("label").agg(F.count("*").alias("rows"))
        total = Window.partitionBy()
        # One row for each label.
        priors = durable(rows.select("label", F.log(F.col("rows") / F.sum("rows").over(total)).alias("log_prior")))
        terms = counted.select("term").distinct()
        size = terms.agg(F.count("*").alias("size"))
        sums = priors.select("label").join(counted.groupBy("label").agg(F.sum("n").alias("sum")), "label", "left")
        each = sums.join(F.broadcast(size)).select("label", (F.coalesce("sum", F.lit(0)) + F.col("size")).alias("below"))
        every = terms.join(F.broadcast(each))
        # Spark would take packed files for small tables.
        weights = every.join(counted.hint("merge"), ["term", "label"], "left").select(
            "term", "label", F.log((F.coalesce("n", F.lit(0)) + 1) / F.col("below")).alias("log_weight")
        )
        return cls(priors, stored(weights, "weights"), yes, analyzer)

    def answers(self, texts: DataFrame) -> DataFrame:
        """(__key, *ANSWER) of (__key, __text), one row a key; terms never seen say nothing.

        A text is read where it lies, and rows may repeat it: each is added up on its own, and
        any of equal ones answers. Its tokens meet the model's most frequent terms there, which
        are broadcast; only the others are dealt by their terms.
        """
        labels = sorted((r["label"], r["log_prior"]) for r in self.priors.collect())
        tokens = F.coalesce(tokens_of(F.col("__text"), self.analyzer), F.array().cast("array<string>"))
        read = texts.select("__key", F.monotonically_increasing_id().alias("row"), tokens.alias("tokens"))
        read = read.withColumn("size", F.size("tokens"))
        known = self.weights.groupBy("term").agg(
            *[F.max(F.when(F.col("label") == label, F.col("log_weight"))).alias(f"w{i}") for i, (label, _) in enumerate(labels)],
            F.sum(F.exp("log_weight")).alias("often"),
        )
        known = stored(known, "terms")
        head, tail = known, None
        if not at_most(known, BROADCAST_ROWS):
            least = known.approxQuantile("often", [1.0 - BROADCAST_ROWS / known.count()], 1e-4)[0]
            head, tail = known.where(F.col("often") > least), known.where(F.col("often") <= least)
        head = F.broadcast(head.drop("often"))
        added = lambda prefix: [F.sum(f"w{i}").alias(f"{prefix}{i}") for i in range(len(labels))]
        one = lambda *names: [F.first(n).alias(n) for n in names]
        met = read.select("__key", "row", "size", F.explode_outer("tokens").alias("term")).join(head, "term", "left")
        scored = met.groupBy("__key", "row").agg(F.first("size").alias("size"), *added("a"))
        scored = scored.groupBy("__key").agg(*one("size", *[f"a{i}" for i in range(len(labels))]))
        if tail is not None:
            rest = read.select("__key", "row", F.explode("tokens").alias("term")).join(head.select("term"), "term", "left_anti")
            sums = rest.join(tail.drop("often").hint("merge"), "term").groupBy("__key", "row").agg(*added("b"))
            scored = scored.join(sums.groupBy("__key").agg(*one(*[f"b{i}" for i in range(len(labels))])), "__key", "left")
        else:
            scored = scored.select("*", *[F.lit(0.0).alias(f"b{i}") for i in range(len(labels))])
        logits = F.array(
            *[
                F.struct((F.lit(prior) + F.coalesce(f"a{i}", F.lit(0.0)) + F.coalesce(f"b{i}", F.lit(0.0))).alias("logit"), F.lit(label).alias("label"))
                for i, (label, prior) in enumerate(labels)
            ]
        )
        scored = scored.withColumn("logits", logits)
        chance = F.transform(
            "logits",
            lambda e: F.struct(
                e["label"].alias("label"),
                (1.0 / F.aggregate("logits", F.lit(0.0), lambda s, o: s + F.exp(o["logit"] - e["logit"]))).alias("p"),
            ),
        )
        scored = scored.withColumn("chances", chance)
        # Ties go to the label that sorts first.
        best = F.element_at(F.array_sort(F.transform("chances", lambda e: F.struct((-e["p"]).alias("low"), e["label"].alias("label")))), 1)
        odds = F.map_from_entries("chances")
        return scored.select(
            "__key",
            best["label"].alias("choice"),
            (-best["low"]).alias("confidence"),
            odds.alias("probabilities"),
            F.element_at(odds, self.yes).alias("number"),
            F.lit(self.name).alias("model"),
            F.col("size").cast("long").alias("input_tokens"),
            F.lit(1).cast("long").alias("output_tokens"),
        )


def _answers(df: DataFrame, text: Column, request: dict, scorer: Scorer | NaiveBayes, batch_size: int) -> DataFrame:
    """``df`` with ``__answer`` for every row; equal inputs are asked once.

    For a callable, inputs are grouped by their digest, so long texts cross the network once
    for asking and not at all for joining back; a fitted model reads them where they lie.
    Rows without an input are not asked, and so do not meet in the join.
    """
    names = [c.split()[0] for c in ANSWER.split(", ")]
    keyed = df.withColumn("__text", text).withColumn("__key", F.unhex(F.sha2(F.col("__text"), 256)))
    inputs = keyed.where("__key is not null").select("__key", "__text")
    body = json.dumps(request)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fixed = json.loads(body)
        for batch in batches:
            for at in range(0, len(batch), batch_size):
                part = batch.iloc[at : at + batch_size]
                answers = scorer([{**fixed, "text": t} for t in part["__text"]])
                if len(answers) != len(part):
                    raise ValueError(f"the scorer gave {len(answers)} answers to {len(part)} requests")
                rows = [
                    {
                        "__key": key,
                        "choice": a.get("choice"),
                        "confidence": a.get("confidence"),
                        "probabilities": a.get("probabilities"),
                        "number": a.get("number"),
                        "model": a.get("model"),
                        "input_tokens": a.get("input_tokens"),
                        "output_tokens": a.get("output_tokens"),
                    }
                    for key, a in zip(part["__key"], answers)
                ]
                yield pd.DataFrame(rows).astype({"input_tokens": "Int64", "output_tokens": "Int64"})

    if isinstance(scorer, NaiveBayes):
        asked = scorer.answers(inputs)
    else:
        # Slow scorers must not end in one task because the texts are short.
        cores = df.sparkSession.sparkContext.defaultParallelism
        distinct = inputs.groupBy("__key").agg(F.first("__text").alias("__text"))
        asked = distinct.repartition(cores * 2, "__key").mapInPandas(ask, "__key binary, " + ANSWER)
    packed = asked.select("__key", F.struct(*names).alias("__answer"))
    answered = keyed.where("__key is not null").join(packed, "__key", "left")
    void = keyed.where("__key is null").withColumn("__answer", F.lit(None).cast(packed.schema["__answer"].dataType))
    return answered.select(*keyed.columns, "__answer").unionByName(void).drop("__text", "__key")


def _check_labels(labels: dict[str, str]) -> None:
    if not labels or not all(isinstance(k, str) and k for k in labels):
        raise ValueError("labels must map names to descriptions")


def _check_model(scorer: Scorer | NaiveBayes, labels: list[str] | None) -> None:
    """A fitted model answers the one question that it was fitted for, with its own labels.

    ``labels`` are those asked for; None for a question of yes or no, which takes a model of
    two labels, one of them its ``yes``.
    """
    if not isinstance(scorer, NaiveBayes):
        return
    known = {r["label"] for r in scorer.priors.select("label").collect()}
    if labels is None and not (len(known) == 2 and scorer.yes in known):
        raise ValueError(f"a question of yes or no needs a model of two labels, one of them {scorer.yes!r}; it has {sorted(known)}")
    if labels is not None and set(labels) != known:
        raise ValueError(f"the model's labels are {sorted(known)}, not {sorted(labels)}")


def classify(
    df: DataFrame, text: str, question: str, labels: dict[str, str], scorer: Scorer | NaiveBayes, batch_size: int = 64
) -> DataFrame:
    """``df`` with choice, confidence, probabilities, model, input_tokens, output_tokens."""
    _check_labels(labels)
    _check_model(scorer, list(labels))
    out = _answers(df, F.col(text), {"kind": "choice", "question": question, "labels": labels}, scorer, batch_size)
    a = F.col("__answer")
    return out.select(
        *df.columns,
        *[a[n].alias(n) for n in ("choice", "confidence", "probabilities", "model", "input_tokens", "output_tokens")],
    )


def yes_no(
    df: DataFrame, text: str, question: str, yes: str, no: str, scorer: Scorer | NaiveBayes, batch_size: int = 64
) -> DataFrame:
    """``df`` with ``number``: how far the answer is yes, from 0 to 1."""
    _check_model(scorer, None)
    out = _answers(df, F.col(text), {"kind": "yes_no", "question": question, "yes": yes, "no": no}, scorer, batch_size)
    return out.select(*df.columns, F.col("__answer")["number"].alias("number"))


def _row_text() -> Column:
    return F.to_json(F.struct("*"))


def row_prob(df: DataFrame, statement: str, scorer: Scorer | NaiveBayes, batch_size: int = 64) -> DataFrame:
    """``df`` with ``probability`` that the statement holds for the row."""
    _check_model(scorer, None)
    out = _answers(df, _row_text(), {"kind": "row", "statement": statement}, scorer, batch_size)
    return out.select(*df.columns, F.col("__answer")["number"].alias("probability"))


def row_filter(df: DataFrame, statement: str, scorer: Scorer | NaiveBayes, threshold: float = 0.5, batch_size: int = 64) -> DataFrame:
    """Rows for which the statement holds with at least ``threshold``."""
    return row_prob(df, statement, scorer, batch_size).where(F.col("probability") >= threshold).select(*df.columns)


def row_choice(df: DataFrame, question: str, options: list[str], scorer: Scorer | NaiveBayes, batch_size: int = 64) -> DataFrame:
    """``df`` with ``choice``: one of the options."""
    _check_labels({o: o for o in options})
    _check_model(scorer, options)
    out = _answers(df, _row_text(), {"kind": "row_choice", "question": question, "labels": options}, scorer, batch_size)
    return out.select(*df.columns, F.col("__answer")["choice"].alias("choice"))


def row_score(df: DataFrame, question: str, scorer: Scorer | NaiveBayes, batch_size: int = 64) -> DataFrame:
    """``df`` with ``score``: the number given to the row."""
    _check_model(scorer, None)
    out = _answers(df, _row_text(), {"kind": "row_score", "question": question}, scorer, batch_size)
    return out.select(*df.columns, F.col("__answer")["number"].alias("score"))


def eval_stats(classified: DataFrame) -> DataFrame:
    """(model, n_rows, n_answered, input_tokens, output_tokens) over classified rows."""
    return classified.groupBy("model").agg(
        F.count("*").alias("n_rows"),
        F.count("choice").alias("n_answered"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
    )
