"""Language identification and toxicity: paths against brute force, held-out accuracy."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankweave.llm import language, queries, toxicity

FOLDER = "/root/testdata/sf0.01"


def worth(scores, path, penalty):
    return sum(scores[t, s] for t, s in enumerate(path)) - penalty * sum(a != b for a, b in zip(path, path[1:]))


@pytest.mark.parametrize("seed", range(40))
def test_best_path_is_the_best(seed):
    random = np.random.default_rng(seed)
    n, states = int(random.integers(1, 8)), int(random.integers(1, 4))
    scores = random.normal(0, 3, (n, states)).astype(np.float32)
    scores[:, 0] += 3 * (seed % 2)
    best = max(worth(scores, p, 2.0) for p in itertools.product(range(states), repeat=n))
    assert worth(scores, language.best_path(scores, 2.0).tolist(), 2.0) == pytest.approx(best, abs=1e-4)


def test_scripts():
    words = ["abc", "éa", "привет", "λόγος", "漢字", "かな", "한글", "עברית"]
    named = [language.NAMES[i] for i in language.scripts_of(words)]
    assert named == ["latin", "latin", "cyrillic", "greek", "han", "kana", "hangul", "hebrew"]


def test_grams_of_many_words_are_those_of_each():
    words = ["a", "été", "x" * 50, "漢字", "ab"]
    for n, (slots, starts) in zip(language.GRAMS, language.grams_of(words)):
        parts = np.split(slots, starts[1:])
        for word, part in zip(words, parts):
            alone = dict(zip(language.GRAMS, language.grams_of([word])))[n][0]
            assert len(part) == len(word) + 3 - n and (part == alone).all()


@pytest.fixture(scope="module")
def model(spark):
    rows = [("the cat and the dog walk to the river", "en"), ("le chat et le chien vont à la rivière", "fr"), ("кот и собака идут к реке", "ru"), (None, "en"), ("x", None)]
    return language.learn(spark.createDataFrame(rows * 5, "text string, lang string"))


def test_mixed_text_and_odd_rows(spark, model):
    assert model.languages == ["en", "fr", "ru"]
    text = "the dog and the cat walk to the river. " * 3 + "le chien et le chat vont à la rivière. " * 2 + "кот"
    spans = language.Labeller(model).spans(text)
    assert [s[0] for s in spans] == ["en", "fr", "ru"]
    assert text[spans[2][1] : spans[2][2]] == "кот"
    rows = [(None, None), (1, ""), (2, "12 .. 34"), (3, "собака"), (3, "собака"), (2**60, "the cat " * 30_000), (7, "²½")]
    docs = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id long, text string, lang_pred string, score double")
    got = sorted((str(r["doc_id"]), r["lang_pred"]) for r in language.identify(docs, model).collect())
    assert got == sorted([("None", "und"), ("1", "und"), ("2", "und"), ("3", "ru"), ("3", "ru"), (str(2**60), "en"), ("7", "und")])
    kept = language.keep_identified(docs, model)
    assert kept.columns == docs.columns and kept.count() == 3
    assert language.identify(docs.limit(0), model).count() == 0
    assert language.spans(docs, model).where("lang = 'ru'").count() == 2


def test_nothing_to_learn_from(spark):
    none = language.learn(spark.createDataFrame([], "text string, lang string"))
    docs = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    assert language.identify(docs, none).first()["lang_pred"] == "und"
    calm = toxicity.learn(docs, spark.createDataFrame([(1, 0)], "doc_id long, toxic int"))
    assert toxicity.score(docs, calm).first()["score"] < 0.05


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang")
    out = queries.op2_language(spark, FOLDER).where("held_out").join(docs, "doc_id").where("lang is not null").toPandas()
    assert (out["lang"] == out["lang_pred"]).mean() > 0.97
    assert out["score"].between(0, 1).all()


def test_toxicity_of_held_out_documents(spark):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    out = queries.op9_toxicity(spark, FOLDER).where("held_out").join(labels, "doc_id").toPandas()
    toxic, clean = out[out["toxic"] == 1]["score"], out[out["toxic"] == 0]["score"]
    above = np.mean([(t > clean).mean() for t in toxic])
    assert above > 0.75 and (out["predicted"] == (out["score"] >= 0.3)).all()


def test_sentences_are_found_from_document_labels(spark):
    random = np.random.default_rng(1)
    words = [f"w{i}".translate(str.maketrans("0123456789", "abcdefghij")) for i in range(300)]
    rows = []
    for i in range(300):
        said = [" ".join(random.choice(words, 8)) for _ in range(6)]
        if i % 3 == 0:
            said[i % 6] += " you vile fool"
        rows.append((i, ". ".join(said) + ".", int(i % 3 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.learn(docs.drop("toxic"), docs)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert all((got[i] > 0.5) == bool(y) for i, _, y in rows)
    spans = toxicity.locate(docs, model).collect()
    assert {s["doc_id"] for s in spans} == {i for i, _, y in rows if y}
    assert all("vile fool" in rows[s["doc_id"]][1][s["start"] : s["end"]] for s in spans)
    odd = spark.createDataFrame([(None, None), (1, ""), (1, "vile fool " * 50_000)], "doc_id long, text string")
    assert [r["score"] > 0.5 for r in toxicity.score(odd, model).collect()] == [False, False, True]


def test_no_row_of_the_fourth_part_is_learnt_from(spark):
    import zlib

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id").limit(300)
    for r in docs.select("doc_id", queries._held_out().alias("h"), F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("c")).collect():
        assert r["c"] == zlib.crc32(str(r["doc_id"]).encode()) and r["h"] == (r["c"] % 4 == 2)
