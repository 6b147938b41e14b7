"""Exact lineage by elimination, nested JSON rules, merge bases, model labels, vectors that are no numbers."""

import itertools
import math
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rankweave.operators import components, lineage_worlds, predicates, provenance, queue, vector, versioned
from rankweave.operators.semistructured import json_schema_check


def brute(terms, p):
    total = 0.0
    names = sorted(p)
    for bits in itertools.product([0, 1], repeat=len(names)):
        world = {n for n, b in zip(names, bits) if b}
        weight = 1.0
        for n, b in zip(names, bits):
            weight *= p[n] if b else 1 - p[n]
        total += weight * any(set(t) <= world for t in terms)
    return total


def test_elimination_is_the_sum_over_worlds():
    random.seed(5)
    for _ in range(150):
        names = [f"t{i}" for i in range(random.randint(1, 8))]
        terms = [random.sample(names, random.randint(1, min(6, len(names)))) for _ in range(random.randint(1, 7))]
        p = {t: random.choice([0.0, 1.0, random.random()]) for t in sorted({t for x in terms for t in x})}
        tokens = [{"token": t, "p": v} for t, v in p.items()]
        assert lineage_worlds.chance(tokens, terms) == pytest.approx(brute(terms, p), abs=1e-12)
    assert lineage_worlds.chance([{"token": "a", "p": 0.1}], [["a"], []]) == 1.0


def test_a_chain_of_thousands_of_tokens_is_quick():
    n, p = 5000, 0.03
    tokens = [{"token": f"t{i:05}", "p": p} for i in range(n)]
    terms = [[f"t{i:05}", f"t{i + 1:05}"] for i in range(n - 1)]
    began = time.time()
    found = lineage_worlds.chance(tokens, terms)
    assert time.time() - began < 10
    out, held = 1.0, 0.0
    for _ in range(n):
        out, held = (out + held) * (1 - p), out * p
    assert found == pytest.approx(1 - out - held, abs=1e-9)
    shares = lineage_worlds.worth(tokens[:400], terms[:399], "shapley")
    assert sum(shares.values()) == pytest.approx(1.0, abs=1e-9)


def test_entangled_lineage_asks_for_samples():
    names = [f"t{i}" for i in range(40)]
    terms = [list(x) for x in itertools.combinations(names, 2)]
    with pytest.raises(ValueError, match="samples"):
        lineage_worlds.chance([{"token": t, "p": 0.5} for t in names], terms)


def test_large_rows_are_split_into_parts(spark, monkeypatch):
    random.seed(3)
    rows, p = [], {}
    for row in ("a", None):
        for i in range(6):
            rows.append((row, [f"s{row}{i}"]))
        rows += [(row, sorted([f"x{row}{i}", f"x{row}{i + 1}"])) for i in range(4)] + [(row, ["y", "z"]), (row, [f"x{row}0"])]
    rows.append(("b", ["y", "z"]))
    p = {t: random.random() / 2 for _, term in rows for t in term}
    relation = spark.createDataFrame([(r, t, 1) for r, t in rows], "r string, mono array<string>, coef long")
    probs = spark.createDataFrame(list(p.items()), "token string, p double")
    want = {r: brute([t for x, t in rows if x == r], {n: p[n] for x, t in rows if x == r for n in t}) for r in ("a", "b", None)}
    for packed in (provenance.PACKED, 3):
        monkeypatch.setattr(provenance, "PACKED", packed)
        got = {r["r"]: r["probability"] for r in provenance.probability(relation, probs).collect()}
        assert got == pytest.approx({k: round(v, 6) for k, v in want.items()}, abs=2e-6)
    sums = provenance.expected(relation.withColumn("v", F.lit(10)), probs, ["r"], "v").collect()
    assert {r["r"]: r["expected_sum"] for r in sums} == pytest.approx({k: 10 * v for k, v in want.items()}, abs=0.01)


def test_rows_with_and_without_a_closed_form(spark, monkeypatch):
    random.seed(5)
    rows = [("one", ["a"]), ("one", ["a", "b"]), ("star", ["a", "b"]), ("star", ["a", "c"]), ("star", ["a", "d", "e"])]
    rows += [("many", ["c", f"m{i}"]) for i in range(6)] + [("chain", ["a", "b"]), ("chain", ["b", "c"]), ("chain", ["c", "d"]), (None, ["b", "e"])]
    p = {t: random.random() for _, term in rows for t in term}
    relation = spark.createDataFrame([(r, t, 1) for r, t in rows], "r string, mono array<string>, coef long")
    # A token may be listed twice.
    probs = spark.createDataFrame(list(p.items()) + [("a", p["a"])], "token string, p double")
    want = {r: brute([t for x, t in rows if x == r], {n: p[n] for x, t in rows if x == r for n in t}) for r in {x for x, _ in rows}}
    for placed in (provenance.PLACED, 3):
        monkeypatch.setattr(provenance, "PLACED", placed)
        got = {r["r"]: r["probability"] for r in provenance.probability(relation, probs).collect()}
        assert got == pytest.approx({k: round(v, 6) for k, v in want.items()}, abs=2e-6)
        kinds = {r["r"]: r["kind"] for r in provenance._weighed(relation.drop("coef"), probs).collect()}
        assert kinds["chain"] == provenance.OPEN and kinds["star"] == (provenance.CLOSED if placed > 3 else provenance.OPEN)


def test_lineages_stay_where_they_are(spark):
    """A small side is broadcast by its count; tokens are not dealt again by their row."""
    a = provenance.add_provenance(spark.range(50).selectExpr("id AS k", "id % 5 AS s"), "a", ["k"])
    b = provenance.add_provenance(spark.range(5).withColumnRenamed("id", "s"), "b", ["s"])
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = provenance.join(a.repartition("k"), b, ["s"])
        relation = provenance.project(joined, "k")
        plan = relation._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and plan.count("Exchange hashpartitioning") == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_frequent_terms_are_met_where_the_texts_lie(spark, monkeypatch):
    """Terms that are broadcast, dealt or unknown; texts that come twice, are empty or NULL."""
    random.seed(4)
    words = [f"w{i}" for i in range(12)]
    said = [(" ".join(random.choice(words[: 3 + i % 10]) for _ in range(i % 9)), str(random.randrange(2))) for i in range(40)]
    model = predicates.NaiveBayes.fit(spark.createDataFrame(said, "t string, y string"), "t", "y", yes="1")
    asked = spark.createDataFrame([(t + " new",) for t, _ in said[:12]] * 2 + [("",), (None,)], "t string")
    out = []
    for most in (100, 4):
        monkeypatch.setattr(predicates, "BROADCAST_ROWS", most, raising=False)
        found = predicates.classify(asked, "t", "?", {"0": "", "1": ""}, model)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "sha2" in plan and not [x for x in plan.splitlines() if "Exchange hashpartitioning(__key" in x and "__text" in x]
        assert "partial_first(__text" not in plan
        out.append(sorted((str(r["t"]), str(r["choice"]), round(r["confidence"] or 0, 6), r["input_tokens"] or -1) for r in found.collect()))
    counts = {y: Counter(w for t, z in said if z == y for w in t.split()) for y in "01"}
    size = len(set(counts["0"]) | set(counts["1"]))
    want = []
    for (t,) in [tuple(r) for r in asked.collect()]:
        if t is None:
            want.append(("None", "None", 0, -1))
            continue
        logit = {y: math.log(sum(z == y for _, z in said) / len(said)) for y in "01"}
        for y in "01":
            known = [w for w in t.split() if counts["0"][w] + counts["1"][w]]
            logit[y] += sum(math.log((counts[y][w] + 1) / (sum(counts[y].values()) + size)) for w in known)
        best = max("01", key=lambda y: (logit[y], y == "0"))
        want.append((t, best, round(1 / sum(math.exp(v - logit[best]) for v in logit.values()), 6), len(t.split()) or -1))
    assert out[0] == out[1] == sorted(want)


def test_components_of_a_chain_and_a_star(spark):
    pairs = [(f"n{i:03}", f"n{i + 1:03}") for i in range(60)] + [("hub", f"s{i}") for i in range(30)] + [("x", "x"), (None, "y")]
    found = components.components(spark.createDataFrame(pairs, "a string, b string"), "a", "b").collect()
    parts = {}
    for r in found:
        parts.setdefault(r["root"], set()).add(r["node"])
    assert sorted(map(len, parts.values())) == [31, 61]
    assert components.components(spark.createDataFrame([], "a string, b string"), "a", "b").count() == 0


def test_nested_items_are_planned_once(spark):
    schema = {"type": "integer", "maximum": 3}
    for _ in range(6):
        schema = {"type": "array", "items": {"type": "object", "required": ["a"], "properties": {"a": schema}}}
    deep = "9"
    for _ in range(6):
        deep = '[{"a":%s},{"b":1}]' % deep
    rows = spark.createDataFrame([(deep,), ("[]",), ("{",), (None,), ("7",)], "j string")
    began = time.time()
    checked = json_schema_check(rows, "j", schema)
    checked._jdf.queryExecution().executedPlan()
    assert time.time() - began < 15
    got = [[tuple(v) for v in r["violations"]] for r in checked.collect()]
    paths = ["$" + "[].a" * i for i in range(6)]
    assert got[0] == [("required", f"{x}[].a") for x in paths] + [("maximum", "$" + "[].a" * 6)]
    assert got[1] == got[3] == [] and got[2] == [("json", "$")] and got[4] == [("type", "$")]


def test_undo_goes_back_to_the_base_of_the_merge_before(spark, tmp_path):
    rows = spark.createDataFrame([(i, "base") for i in range(4)], "id long, v string")
    tracked = versioned.VersionedTable.track(rows, ["id"], str(tmp_path / "t"))
    tracked.create_branch("b")
    change = lambda i, v: spark.createDataFrame([(i, v)], "id long, v string")
    tracked.commit("b", change(0, "first"))
    assert tracked.merge("b")[0]
    tracked.commit("main", change(0, "after"))
    tracked.commit("b", change(1, "second"))
    second, _ = tracked.merge("b")
    tracked.undo_merge(second)
    version, conflicts = tracked.merge("b")
    assert version and conflicts.count() == 0
    assert {r["id"]: r["v"] for r in tracked.read().collect()} == {0: "after", 1: "second", 2: "base", 3: "base"}


def test_a_model_must_know_the_labels_asked_for(spark):
    texts = spark.createDataFrame([("a b", "1"), ("c d", "0")], "t string, y string")
    model = predicates.NaiveBayes.fit(texts, "t", "y", yes="1")
    with pytest.raises(ValueError, match="labels"):
        predicates.classify(texts, "t", "?", {"animal": "", "plant": ""}, model)
    with pytest.raises(ValueError, match="labels"):
        predicates.row_choice(texts, "?", ["red", "blue"], model)
    three = predicates.NaiveBayes.fit(texts.union(spark.createDataFrame([("e", "2")], texts.schema)), "t", "y", yes="1")
    with pytest.raises(ValueError, match="yes or no"):
        predicates.yes_no(texts, "t", "?", "y", "n", three)
    assert predicates.classify(texts, "t", "?", {"0": "", "1": ""}, model).select("choice").distinct().count() == 2


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_vectors_that_are_no_numbers_are_nobodys_neighbours(spark, metric):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [float("nan"), 1.0]), (3, [float("inf"), 1.0]), (4, [0.5, 1.0])], "id long, v array<double>")
    one = [r["id"] for r in vector.knn(rows, "id", "v", [1.0, 0.1], 5, metric).collect()]
    asked = spark.createDataFrame([(9, [1.0, 0.1])], "q long, v array<double>")
    joined = [r["id"] for r in vector.knn_join(asked, "q", "v", rows, "id", "v", 5, metric).orderBy("rank").collect()]
    assert one == joined == [1, 4]


def test_a_range_of_a_log_opens_its_folders_only(spark, tmp_path):
    names = [c.split() for c in queue.LOG_SCHEMA.split(", ")]
    log = spark.range(100).select(*[(F.col("id") if n == "msg_id" else F.lit(None)).cast(t).alias(n) for n, t in names])
    path = str(tmp_path / "log")
    queue.append(log, path, width=10)
    found = queue.open_log(spark, path, width=10, first=25, last=38)
    assert sorted(r["msg_id"] for r in found.collect()) == list(range(25, 39))
    assert len(found.inputFiles()) <= 100 and "part" not in found.columns
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan


def test_a_folder_of_a_log_has_one_file_and_others_are_not_listed(spark, tmp_path):
    names = [c.split() for c in queue.LOG_SCHEMA.split(", ")]
    log = spark.range(0, 100, 1, 7).select(*[(F.col("id") if n == "msg_id" else F.lit(None)).cast(t).alias(n) for n, t in names])
    log = log.unionByName(log).unionByName(log.withColumn("msg_id", F.lit(None).cast("long")))
    path = str(tmp_path / "log")
    queue.append(log, path, width=10)
    assert len(list((tmp_path / "log").glob("part=[0-9]*/*.parquet"))) == 10
    # A folder that no reader may open is passed over.
    (tmp_path / "log" / "part=9" / "broken.parquet").write_text("no table")
    found = queue.open_log(spark, path, width=10, first=25, last=38)
    assert sorted(r["msg_id"] for r in found.collect()) == sorted([*range(25, 39)] * 2)
    assert len(found._jdf.queryExecution().analyzed().collectLeaves().head().relation().location().rootPaths().mkString(" ").split()) == 2
    (tmp_path / "log" / "part=9" / "broken.parquet").unlink()
    assert queue.open_log(spark, path, width=10, first=500, last=620).count() == 0
    plain = str(tmp_path / "plain")
    queue.append(log.withColumn("event_ts", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")), plain, width=10)
    for last in (None, 99, 5):
        kept = queue.open_log(spark, plain, width=10, first=0, last=last)
        assert kept.schema["event_ts"].dataType.simpleString() == "timestamp_ntz" and "part" not in kept.columns


def test_shares_of_one_form_are_worked_out_once():
    """Rows that differ in their tokens' names only share one elimination."""
    from rankweave.operators import lineage_worlds as W

    W._shares_of_form.cache_clear()
    for center in ("a", "m", "z"):
        terms = [[center, f"{leaf}{center}"] for leaf in "bnq"]
        tokens = [{"token": t, "p": 0.5} for t in sorted({t for term in terms for t in term})]
        shares = W.worth(tokens, terms, "shapley")
        assert shares[center] == pytest.approx(0.75) and sum(shares.values()) == pytest.approx(1.0)
    assert W._shares_of_form.cache_info().misses == 1


def test_schema_of_an_array_is_not_taken_to_find_its_type(spark):
    """An object or array is known without describing all it holds."""
    from rankweave.operators.semistructured import json_schema_check

    df = spark.createDataFrame([('[{"q": 1.0}, {"q": "x"}, 3, null, [true]]',)], "doc string")
    schema = {"type": "array", "items": {"type": "object", "properties": {"q": {"type": "integer"}}}}
    checked = json_schema_check(df, "doc", schema)
    plan = checked._jdf.queryExecution().analyzed().toString().lower()
    assert plan.count("schema_of_variant(") <= 3
    assert [(v["rule"], v["path"]) for v in checked.first()["violations"]] == [("type", "$[]"), ("type", "$[].q")]
