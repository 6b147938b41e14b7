"""Edited passages with as many edits as allowed."""

import random

import numpy as np
import pytest

from rankweave.llm import decontaminate as d

KINDS = ("replaced", "left out", "put in", "mixed")


def edited(words, kind, n, rng, new, first=1):
    """``words`` with n edits; with ``first`` 1 the first word stays, so that the passage begins there."""
    words = list(words)
    if kind == "mixed":
        for i in range(n):
            words = edited(words, KINDS[i % 3], 1, rng, new, first)
        return words
    for i in sorted(rng.sample(range(first, len(words)), n), reverse=True):
        words[i : i + (kind != "put in")] = [] if kind == "left out" else [new()]
    return words


@pytest.mark.parametrize("size", [5, 20, 40, 80, 120, 200])
@pytest.mark.parametrize("kind", KINDS)
def test_recall_of_keys(size, kind):
    """The share of fully edited items that have a key in common with their passage."""
    rng, trials, base = random.Random(size), 300, d.class_of(size)

    def new():
        return rng.getrandbits(63) | 1

    streams, starts = ([], []), ([], [])
    for _ in range(trials):
        item = [new() for _ in range(size)]
        for stream, at, own in zip(streams, starts, (item, edited(item, kind, d.edits(size), rng, new))):
            at.append(len(stream))
            stream += own + [new() for _ in range(int(base * d.STEPS) + d.SAMPLED)]
    ours, theirs = (d.walk_keys(np.array(s, np.uint64), np.array(at), base) for s, at in zip(streams, starts))
    assert (ours == theirs).any(axis=1).mean() >= d.RECALL


@pytest.mark.parametrize("most", [d.BROADCAST_KEYS, 0])
def test_fully_edited_passages_are_found(spark, monkeypatch, most):
    """With the items' keys in the tasks and without: the same rows."""
    monkeypatch.setattr(d, "BROADCAST_KEYS", most)
    rng = random.Random(4)

    def new():
        return f"w{rng.randrange(10**9)}"

    items = [[new() for _ in range(size)] for size in (40, 120, 200) for _ in range(4)]
    texts = [
        [new() for _ in range(30)] + edited(item, kind, d.edits(len(item)), rng, new) + [new() for _ in range(30)]
        for item in items
        for kind in KINDS
    ]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"], r["start_word"]) for r in d.leaks(docs, bench).collect()}
    assert found == {(i, i // len(KINDS), 30) for i in range(len(texts))}


@pytest.mark.parametrize("most", [d.BROADCAST_KEYS, 0])
@pytest.mark.parametrize("vocabulary", [d.VOCABULARY, 0])
def test_short_items_are_found_exactly(spark, monkeypatch, most, vocabulary):
    """Items of one to four words: every exact run, no edited one, in every mode."""
    monkeypatch.setattr(d, "BROADCAST_KEYS", most)
    monkeypatch.setattr(d, "VOCABULARY", vocabulary)
    rng = random.Random(9)
    items = [(0, "alpha"), (1, "Beta gamma"), (2, "alpha beta gamma"), (3, "delta, delta delta delta"), (4, None), (5, " ?! ")]
    texts = [" ".join(rng.choice("alpha beta gamma delta other".split()) for _ in range(n)) for n in (0, 1, 2, 3, 8, 20, 60, 400)]
    texts += ["alpha", "beta gamma", "gamma beta", "alpha other beta gamma", None, "other delta delta delta delta", "x delta delta delta"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = set()
    for doc, text in enumerate(texts):
        words = d.words_of(text)
        for item, said in items:
            said = d.words_of(said)
            runs = [i for i in range(len(words) - len(said) + 1) if said and words[i : i + len(said)] == said]
            if runs:
                expected.add((doc, item, runs[0], runs[0] + len(said), 0))
    found = d.leaks(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"], r["start_word"], r["end_word"], r["distance"]) for r in found} == expected
    assert len(found) == len(expected)


@pytest.mark.parametrize("kind", KINDS)
def test_edits_of_the_first_words_are_found(spark, kind):
    """With edits anywhere, the first word included, the share of passages found is the target or more."""
    rng = random.Random(12)

    def new():
        return f"w{rng.randrange(10**9)}"

    items = [[new() for _ in range(size)] for size in (10, 20, 40, 80, 160) for _ in range(40)]
    texts = [
        [new() for _ in range(15)] + edited(item, kind, d.edits(len(item)), rng, new, 0) + [new() for _ in range(15)]
        for item in items
    ]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in d.leaks(docs, bench).collect()}
    assert found <= {(i, i) for i in range(len(items))}
    assert len(found) >= d.RECALL * len(items)
