"""Bounds of what reaches one task or the driver, and null keys."""

from pyspark.sql import functions as F

from rankweave.llm import sharding, toxicity


def test_null_keys_of_any_type_have_a_shard(spark):
    for kind in ("long", "double", "string", "date"):
        keys = spark.range(3).select(F.lit(None).cast(kind).alias("k"))
        assert sharding.place(keys, "k", ["a", "b"]).select("slot").distinct().count() == 1


def test_repeated_rows_of_a_drawn_key_do_not_pass_the_bound(spark, monkeypatch):
    met = []
    monkeypatch.setattr(toxicity, "_fit", lambda sample, share, epochs: met.append(sample))
    hot = spark.range(20_000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 5000).alias("text"), F.lit(9).alias("label"))
    rest = spark.createDataFrame([(2, "clean words", 9), (3, None, 9), (None, "lost", 9)], "doc_id long, text string, label int")
    labels = spark.createDataFrame([(1, 1, 7), (1, 1, 7), (2, 0, 7), (2, 1, 7), (3, 0, 7), (None, 0, 7), (4, 5, 7)], "doc_id long, toxic int, text int")
    toxicity.learn(hot.unionByName(rest), labels, per_class=3)
    assert sorted(met[0]["label"]) == [0, 1, 1, 1]
