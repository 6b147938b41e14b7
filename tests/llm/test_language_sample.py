"""The texts that the language model is learnt from."""

from rankweave.llm import language


def test_copies_are_drawn_once_and_the_bound_holds(spark):
    copies = [(f"one text said again {i}", "aa") for i in range(50) for _ in range(40)]
    rows = copies + [(f"other words {i}", "aa") for i in range(100)] + [("few", "bb")] * 30 + [(None, "bb"), ("x", None)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    drawn, languages = language._sample(docs, "text", "lang", 20)
    found = [tuple(r) for r in drawn.collect()]
    assert languages == ["aa", "bb"]
    assert len(found) == len(set(found)) == 21 and ("few", "bb") in found
