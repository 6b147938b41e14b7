"""The pipeline's stages, each on its own input."""

import corpus_pipeline as pipeline
from rankweave.llm import decontaminate, secrets

FOLDER = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    assert [n for n, _ in pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "secrets", "pieces"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, before = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    items = [decontaminate.words_of(r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    for name, stage in pipeline.STAGES:
        docs = pipeline.stored(stage(spark, docs, FOLDER))
        if name == "pieces":
            break
        assert docs.columns == columns
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert set(after) <= set(before)
        if name == "language":
            assert all(any(map(str.isalpha, before[i] or "")) for i in after)
            assert len(after) >= 0.98 * len(before)
        if name == "near_duplicates":
            assert len(set(after.values())) == len(after) < len(before)
        if name == "decontamination":
            said = {i: f" {' '.join(decontaminate.words_of(t))} " for i, t in before.items()}
            leaky = {i for i, t in said.items() if any(f" {' '.join(w)} " in t for w in items)}
            assert leaky and not leaky & set(after)
            assert len(after) == len(before) - docs.sparkSession.createDataFrame([(i,) for i in leaky], "i long").count()
        if name == "secrets":
            assert set(after) == set(before)
            left = secrets.scan(docs).collect()
            assert not any(s["strong"] for r in left for s in r["spans"])
            assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
        before = after
    assert {r["doc_id"] for r in docs.collect()} == set(before)


def test_run(spark):
    assert pipeline.run(spark, FOLDER).count() > 0
