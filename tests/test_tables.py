import json
import re

import pytest
from pyspark.sql import functions as F

from rankweave.functions import scalars as S
from rankweave.operators import assertions, predicates, provenance as P, queue as Q
from rankweave.operators.graph import Graph, Hop, create_graph, match_path, path_query, traverse
from rankweave.operators.hierarchy import ancestors, descendants, hierarchy_rollup
from rankweave.operators.semistructured import json_schema_check, violation_summary, xml_table, xpath
from rankweave.operators.similar import trigram_join
from rankweave.operators.timeseries import chunks, partition_plan, read_chunked, time_bucket, write_chunked
from rankweave.operators.versioned import VersionedTable


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


# -- time ------------------------------------------------------------------------


def test_buckets_and_chunks(spark, tmp_path):
    df = spark.sql("SELECT * FROM VALUES (timestamp'2026-08-07 00:00:00', 1.0D), (timestamp'2026-08-07 00:01:00', 2.0D) AS t(at, v)")
    rows = time_bucket(df, "at", "1 minute", [F.count("*").alias("n"), F.sum("v").alias("s")]).collect()
    assert len(rows) == 2 and sum(r["n"] for r in rows) == 2 and sum(r["s"] for r in rows) == 3.0
    path = str(tmp_path / "h")
    write_chunked(df, "at", "1 minute", path)
    write_chunked(df.withColumn("at", F.expr("at + interval 1 hour")), "at", "1 minute", path)
    assert chunks(spark, path, "at").agg(F.count("*"), F.sum("n_rows")).first()[:] == (4, 4)
    part = read_chunked(spark, path, "at", "1 minute", "2026-08-07 00:00:30", "2026-08-07 01:00:30")
    assert sorted(r["v"] for r in part.collect()) == [1.0, 2.0] and part.columns == ["at", "v"]
    empty = df.limit(0)
    assert time_bucket(empty, "at", "1 minute", [F.count("*").alias("n")]).count() == 0


def test_partition_plan_reports_gaps(spark):
    df = spark.createDataFrame([(1,), (5,), (31,), (None,)], "k int")
    rows = partition_plan(df, "k", 10).orderBy("part").collect()
    assert [(r["range_start"], r["range_end"], r["n_rows"]) for r in rows] == [(0, 10, 2), (10, 20, 0), (20, 30, 0), (30, 40, 1)]
    with pytest.raises(ValueError):
        partition_plan(df, "k", 0)


# -- versions --------------------------------------------------------------------


@pytest.fixture()
def orders(spark, tmp_path):
    df = spark.createDataFrame([(1, "open", 10), (2, "paid", 20), (3, "open", 30)], "id long, status string, amount long")
    return VersionedTable.track(df, "id", str(tmp_path / "orders"))


def rows(spark, *values):
    return spark.createDataFrame(list(values), "id long, status string, amount long")


def state(table, branch="main", as_of=None):
    return {r["id"]: (r["status"], r["amount"]) for r in table.read(branch, as_of).collect()}


def test_branch_diff_merge_undo(spark, orders):
    orders.create_branch("agent/refunds")
    orders.commit("agent/refunds", rows(spark, (1, "refunded", 10)))
    assert state(orders)[1] == ("open", 10) and state(orders, "agent/refunds")[1] == ("refunded", 10)
    assert [(r["col"], r["old"], r["new"]) for r in orders.diff("agent/refunds").collect()] == [("status", "open", "refunded")]
    version, conflicts = orders.merge("agent/refunds")
    assert conflicts.count() == 0 and state(orders)[1] == ("refunded", 10)
    assert state(orders, as_of=version - 1)[1] == ("open", 10)
    orders.undo_merge(version)
    assert state(orders)[1] == ("open", 10)
    reopened = VersionedTable(spark, orders.path)
    assert state(reopened) == state(orders) and reopened.version == orders.version


def test_fields_merge_and_conflicts_are_rows(spark, orders):
    orders.create_branch("b")
    orders.commit("b", rows(spark, (1, "held", 10), (4, "new", 1)), spark.createDataFrame([(3,)], "id long"))
    orders.commit("main", rows(spark, (1, "open", 11)))
    version, _ = orders.merge("b")
    assert version is not None
    assert state(orders) == {1: ("held", 11), 2: ("paid", 20), 4: ("new", 1)}
    orders.create_branch("c")
    orders.commit("c", rows(spark, (1, "x", 11)), spark.createDataFrame([(2,)], "id long"))
    orders.commit("main", rows(spark, (1, "y", 11), (2, "late", 20)))
    before = state(orders)
    version, conflicts = orders.merge("c")
    assert version is None and state(orders) == before
    assert {(r["id"], r["col"], r["ours"], r["theirs"]) for r in conflicts.collect()} == {
        (1, "status", "y", "x"), (2, "<row>", "present", "deleted"),
    }


def test_branch_of_a_branch_and_time_travel(spark, orders):
    orders.create_branch("a")
    first = orders.commit("a", rows(spark, (1, "a1", 1)))
    orders.create_branch("b", "a")
    orders.commit("a", rows(spark, (1, "a2", 2)))
    orders.commit("b", rows(spark, (2, "b", 3)))
    assert state(orders, "b") == {1: ("a1", 1), 2: ("b", 3), 3: ("open", 30)}
    assert state(orders, "a", first)[1] == ("a1", 1) and state(orders)[1] == ("open", 10)
    with pytest.raises(ValueError):
        orders.read("nope")
    with pytest.raises(ValueError):
        orders.commit("main", rows(spark, (1, "x", 1), (1, "y", 1)))


def test_savepoints(spark, tmp_path):
    doc = spark.createDataFrame([("a.md", "# original")], "name string, body string")
    table = VersionedTable.track(doc, "name", str(tmp_path / "files"))
    ident = table.savepoint("before")
    assert ident[14] == "7"
    change = spark.createDataFrame([("a.md", "# provisional change"), ("b.md", "new")], "name string, body string")
    table.commit("main", change)
    summary = {r["op"]: r["n"] for r in table.undo_summary("before").collect()}
    assert summary == {"upsert": 1, "delete": 1}
    table.undo_to("before")
    assert [tuple(r) for r in table.read().collect()] == [("a.md", "# original")]


# -- provenance ------------------------------------------------------------------


@pytest.fixture(scope="module")
def sightings(spark):
    df = spark.createDataFrame([("Alice", "w1", 1), ("Alice", "w2", 1), ("Bob", "w3", 1)], "person string, witness string, n int")
    return P.add_provenance(df, "sightings", ["person", "witness"])


def written(relation, names):
    """The formulas as texts, put together from their terms."""
    terms = {}
    for r in sorted(P.sr_formula(relation, names).collect(), key=lambda r: r["place"]):
        terms.setdefault(r["person"], []).append(r["term"])
    return {k: " ⊕ ".join(v) for k, v in terms.items()}


def test_distinct_formula_and_count(sightings):
    names, counts = P.provenance_mapping(sightings, "witness"), P.provenance_mapping(sightings, "n")
    suspects = P.project(sightings, "person")
    assert written(suspects, names) == {"Alice": "w1 ⊕ w2", "Bob": "w3"}
    assert {r["person"]: r["count"] for r in P.sr_counting(suspects, counts).collect()} == {"Alice": 2, "Bob": 1}
    assert P.where(suspects, "sightings").where("person = 'Bob'").count() == 1
    again = P.union_all(suspects, suspects)
    assert written(again, names)["Bob"] == "2·w3"


def test_long_formulas_have_a_line_per_term(spark):
    df = P.add_provenance(spark.range(1001).selectExpr("id", "id % 1 AS g"), "t", ["id"])
    lines = P.sr_formula(P.project(df, "g"), P.provenance_mapping(df, "id")).collect()
    assert [r["term"] for r in sorted(lines, key=lambda r: r["place"])] == sorted(map(str, range(1001)))
    assert sorted(r["place"] for r in lines) == list(range(1, 1002))


def test_joins_multiply(spark, sightings):
    names = P.provenance_mapping(sightings, "witness")
    pairs = P.join(sightings.withColumnRenamed("witness", "w1"), sightings.withColumnRenamed("witness", "w2").drop("n"), ["person"])
    both = P.project(pairs, "person")
    assert written(both, names)["Alice"] == "2·w1 ⊗ w2 ⊕ w1 ⊗ w1 ⊕ w2 ⊗ w2"
    assert {r["person"]: r["count"] for r in P.sr_counting(both).collect()} == {"Alice": 4, "Bob": 1}
    assert P.why(both).where("person = 'Alice'").count() == 3 and P.how(both).count() == 4


def lines(spark, *monos):
    data = [("r", list(m), 1) for m in monos]
    return spark.createDataFrame(data, "k string, mono array<string>, coef long")


def test_probability_and_shares(spark):
    probs = spark.createDataFrame([(t, 0.5) for t in "abcd"], "token string, p double")
    chance = lambda rel, **kw: P.probability(rel, probs, **kw).first()["probability"]
    assert chance(lines(spark, "a", "b")) == pytest.approx(0.75)
    assert chance(lines(spark, "ab", "bc")) == pytest.approx(0.375)
    assert chance(lines(spark, "ab", "a")) == pytest.approx(0.5)
    assert chance(lines(spark, "ab", "bc"), samples=4000) == pytest.approx(0.375, abs=0.03)
    share = lambda rel, f, name: {r["token"]: r[name] for r in f(rel).collect()}
    assert share(lines(spark, "a", "b"), P.shapley, "shapley") == {"a": 0.5, "b": 0.5}
    assert share(lines(spark, "a", "b", "c"), P.banzhaf, "banzhaf") == {"a": 0.25, "b": 0.25, "c": 0.25}
    mixed = share(lines(spark, "ab", "ac"), P.shapley, "shapley")
    assert mixed["a"] == pytest.approx(2 / 3, abs=1e-6) and mixed["b"] == mixed["c"] == pytest.approx(1 / 6, abs=1e-6)
    assert share(lines(spark, "ab", "ac"), P.banzhaf, "banzhaf") == {"a": 0.75, "b": 0.25, "c": 0.25}


def brute_force(terms):
    """Number of worlds by size that hold a whole term."""
    names = sorted({t for term in terms for t in term})
    counts = [0] * (len(names) + 1)
    for world in range(1 << len(names)):
        held = {n for i, n in enumerate(names) if world >> i & 1}
        counts[len(held)] += any(set(t) <= held for t in terms)
    return counts


def test_dependent_lineage_against_all_worlds():
    import random

    random.seed(8)
    for _ in range(60):
        terms = [random.sample("abcdefg", random.randint(1, 3)) for _ in range(random.randint(1, 6))]
        names = sorted({t for term in terms for t in term})
        tokens = [{"token": t, "p": 0.5} for t in names]
        held = sum(brute_force(terms)) / 2 ** len(names)
        assert P.chance(tokens, terms) == pytest.approx(held)
        assert sum(P.worth(tokens, terms, "shapley").values()) == pytest.approx(1.0)
        for t in names:
            with_t = [[x for x in term if x != t] for term in terms] + [[n] * 0 for n in ()]
            others = [n for n in names if n != t]
            gain = 0
            for world in range(1 << len(others)):
                held = {n for i, n in enumerate(others) if world >> i & 1}
                gain += any(set(x) <= held for x in with_t) and not any(set(x) <= held for x in terms)
            assert P.worth(tokens, terms, "banzhaf")[t] == pytest.approx(gain / 2 ** len(others))


def test_many_dependent_tokens(spark):
    many = lines(spark, *[(f"t{i:02}", f"t{i + 1:02}") for i in range(29)])
    probs = spark.createDataFrame([(f"t{i:02}", 0.5) for i in range(30)], "token string, p double")
    # Worlds of 30 tokens without two neighbours are counted by a Fibonacci number.
    assert P.probability(many, probs).first()["probability"] == pytest.approx(1 - 2178309 / 2**30, abs=1e-6)
    shares = [r["shapley"] for r in P.shapley(many).collect()]
    assert len(shares) == 30 and sum(shares) == pytest.approx(1.0, abs=1e-4)
    assert 0 < P.probability(many, probs, samples=50).first()["probability"] <= 1


def test_where_on_a_join_names_both_tables(spark):
    a = P.add_provenance(spark.createDataFrame([(1, "x")], "k int, v string"), "A", ["k"])
    b = P.add_provenance(spark.createDataFrame([(1, "y")], "k int, w string"), "B", ["k"])
    joined = P.join(a, b, ["k"])
    got = {(r["out_column"], r["table"], r["token"]) for r in P.where(joined, {"k": ("A", a), "v": ("A", a), "w": ("B", b)}).collect()}
    ta, tb = a.first()["mono"][0], b.first()["mono"][0]
    assert got == {("k", "A", ta), ("v", "A", ta), ("w", "B", tb)}
    with pytest.raises(Exception, match="several source rows"):
        P.where(joined, "A").collect()


# -- queues ----------------------------------------------------------------------


def test_queue_life(spark, tmp_path):
    path = str(tmp_path / "log")
    Q.append(Q.create_queue(spark, "demo", "2026-01-01 00:00:00"), path, width=10)
    log = lambda: Q.open_log(spark, path)
    assert [r["queue"] for r in Q.list_queues(log()).collect()] == ["demo"]
    messages = spark.createDataFrame([('{"hello":"world"}',), ('{"n":2}',)], "m string")
    Q.append(Q.send(log(), "demo", messages, "m", "2026-01-01 00:00:01"), path, width=10)
    got, event = Q.read(log(), "demo", 30, 1, "2026-01-01 00:00:02")
    assert [(r["msg_id"], json.loads(r["message"]), r["read_ct"]) for r in got.collect()] == [(1, {"hello": "world"}, 1)]
    Q.append(event, path, width=10)
    ids = lambda now: [r["msg_id"] for r in Q.visible(log(), now).orderBy("msg_id").collect()]
    assert ids("2026-01-01 00:00:03") == [2] and ids("2026-01-01 00:00:32") == [1, 2]
    wanted = spark.createDataFrame([(1,), (77,)], "msg_id long")
    Q.append(Q.archive(log(), "demo", wanted, "2026-01-01 00:01:00"), path, width=10)
    assert ids("2026-01-01 00:02:00") == [2]
    assert [r["msg_id"] for r in Q.archived(log()).collect()] == [1]
    Q.append(Q.delete(log(), "demo", spark.createDataFrame([(2,)], "i long"), "2026-01-01 00:03:00"), path, width=10)
    assert ids("2026-01-01 00:04:00") == []
    Q.append(Q.send(log(), "demo", messages, "m", "2026-01-01 00:05:00"), path, width=10)
    assert ids("2026-01-01 00:06:00") == [3, 4]
    with pytest.raises(ValueError):
        Q.read(log(), "demo", -1, 1, "2026-01-01 00:00:02")


# -- JSON, XML, scalars ------------------------------------------------------------


def check(spark, schema, *texts):
    df = spark.createDataFrame([(t,) for t in texts], "j string")
    return [(r["valid"], [tuple(v) for v in r["violations"]]) for r in json_schema_check(df, "j", schema).collect()]


def test_json_schema(spark):
    assert check(spark, {"type": "object"}, "{}", "[]", "{", None) == [
        (True, []), (False, [("type", "$")]), (False, [("json", "$")]), (None, []),
    ]
    schema = {
        "type": "object", "required": ["a", "b"], "additionalProperties": False,
        "properties": {
            "a": {"type": "integer", "minimum": 1, "maximum": 5}, "b": {"type": "string", "minLength": 2, "maxLength": 3, "pattern": "^x"},
            "c": {"type": "array", "items": {"type": "number", "minimum": 0}}, "d": {"enum": ["u", 1, None]}, "e": {"const": {"k": [1]}},
        },
    }
    good = '{"a": 2.0, "b": "xy", "c": [1, 2.5], "d": null, "e": {"k":[1]}}'
    out = check(spark, schema, good, '{"a": 9, "b": "y", "c": [-1], "d": "v", "e": 1}', '{"z": 1}')
    assert out[0] == (True, [])
    assert set(out[1][1]) == {
        ("maximum", "$.a"), ("minLength", "$.b"), ("pattern", "$.b"), ("minimum", "$.c[]"), ("enum", "$.d"), ("const", "$.e"),
    }
    assert set(out[2][1]) == {("required", "$.a"), ("required", "$.b"), ("additionalProperties", "$")}
    with pytest.raises(ValueError, match="not supported"):
        check(spark, {"oneOf": []}, "{}")
    df = json_schema_check(spark.createDataFrame([("[]",), ("1",)], "j string"), "j", {"type": "object"})
    assert violation_summary(df).first()["n_rows"] == 2


def test_xml(spark):
    df = spark.createDataFrame([(1, "<d><r k='a'><n>1</n></r><r k='b'><n>2</n></r></d>"), (2, "<d><r><n>3</n></r></d>")], "id int, x string")
    out = xml_table(df, "x", "/d/r", {"@k": "string", "n": "int"}).orderBy("id", "n").collect()
    assert [tuple(r) for r in out] == [(1, "a", 1), (1, "b", 2), (2, None, 3)]
    assert df.where("id = 1").select(xpath(F.col("x"), "d/r/n/text()").alias("v")).first()["v"] == ["1", "2"]


def test_scalars(spark):
    assert one(spark, S.trigram_similarity(F.lit("word"), F.lit("word"))) == 1
    assert one(spark, S.trigram_similarity(F.lit("word"), F.lit("two words"))) == pytest.approx(4 / 11)
    assert one(spark, S.trigram_similarity(F.lit(""), F.lit(""))) == 0
    assert one(spark, S.unaccent(F.lit("Hôtel Ærøskøbing façade Łódź"))) == "Hotel AEroskobing facade Lodz"
    assert one(spark, S.parse_hstore(F.lit('a=>1, "b c"=>"x, \\"y\\"", n=>NULL'))) == {"a": "1", "b c": 'x, "y"', "n": None}
    ids = [one(spark, S.uuidv7(F.lit(t).cast("timestamp"), F.lit(t))) for t in ("2026-01-01 00:00:00", "2026-01-01 00:00:01")]
    assert all(len(i) == 36 and i[14] == "7" and i[19] in "89ab" for i in ids) and ids == sorted(ids)


def test_trigram_join_agrees_with_all_pairs(spark):
    words = ["postgres", "postgre", "postgress", "mongo", "mongodb", "progress", "postgres", "ab", "abc"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    for threshold in (0.3, 0.5, 0.75, 1.0):
        got = {(r["left_value"], r["right_value"], r["similarity"]) for r in trigram_join(df, "w", df, "w", threshold, same_table=True).collect()}
        d = df.distinct()
        pairs = d.alias("a").join(d.alias("b"), F.col("a.w") < F.col("b.w")).select(
            F.col("a.w").alias("x"), F.col("b.w").alias("y"), F.round(S.trigram_similarity(F.col("a.w"), F.col("b.w")), 6).alias("s")
        )
        assert got == {tuple(r) for r in pairs.where(F.col("s") >= threshold).collect()}
    two = trigram_join(df, "w", df.where("w like 'post%'"), "w", 1.0).where("left_value = 'postgres'").first()
    assert (two["n_left"], two["n_right"]) == (2, 2)


def test_paths(spark):
    df = spark.createDataFrame([("a.b.c", 1), ("a.b", 2), ("a.bc", 4)], "path string, n int")
    rolled = {r["path"]: (r["depth"], r["s"]) for r in hierarchy_rollup(df, "path", [F.sum("n").alias("s")]).collect()}
    assert rolled == {"a": (1, 7), "a.b": (2, 3), "a.b.c": (3, 1), "a.bc": (2, 4)}
    assert one(spark, ancestors(F.lit("a.b.c"))) == ["a", "a.b", "a.b.c"]
    assert descendants(df, "path", "a.b").count() == 2


# -- graph, paths, predicates, assertions --------------------------------------------


@pytest.fixture(scope="module")
def graph(spark):
    v = spark.createDataFrame([(i, "n", i % 2) for i in range(1, 7)], "id int, label string, odd int")
    e = spark.createDataFrame([(1, 2, "x"), (2, 3, "x"), (3, 1, "x"), (3, 4, "y"), (4, 5, "y")], "src int, dst int, label string")
    return create_graph(v, e, "g")


def test_graph(spark, graph):
    walk = match_path(graph, [Hop(edge="label = 'x'"), Hop(edge="label = 'y'", node="odd = 0")], start="id = 2")
    assert [tuple(r) for r in walk.collect()] == [(2, 3, 4)]
    assert [tuple(r) for r in match_path(graph, [Hop(reverse=True)], start="id = 5").collect()] == [(5, 4)]
    start = spark.createDataFrame([(1,)], "id int")
    depth = lambda n, **kw: {r["id"]: r["depth"] for r in traverse(graph, start, n, **kw).collect()}
    assert depth(2) == {1: 0, 2: 1, 3: 2} and depth(9) == {1: 0, 2: 1, 3: 2, 4: 3, 5: 4}
    assert depth(1, directed=False) == {1: 0, 2: 1, 3: 1}
    with pytest.raises(ValueError):
        Graph(graph.vertices.limit(2), graph.edges, "bad", check=True)


def test_path_query(spark, graph):
    assert [r["id"] for r in path_query(graph.vertices, by={"odd": 1}, order="id", last=2).collect()] == [5, 3]
    with pytest.raises(ValueError):
        path_query(graph.vertices, last=2)


MOCK = {"choice": "technical", "confidence": 0.82, "probabilities": {"billing": 0.08, "technical": 0.85, "sales": 0.07},
        "number": 0.92, "model": "mock", "input_tokens": 312, "output_tokens": 48}


def test_predicates(spark):
    scorer = lambda requests: [MOCK for _ in requests]
    df = spark.createDataFrame([(1, "payouts failing"), (2, "payouts failing"), (3, None)], "id int, t string")
    labels = {"billing": "b", "technical": "t", "sales": "s"}
    out = predicates.classify(df, "t", "Which team?", labels, scorer)
    rows = {r["id"]: r for r in out.collect()}
    assert rows[1]["choice"] == rows[2]["choice"] == "technical" and rows[1]["confidence"] == 0.82
    assert rows[1]["probabilities"]["billing"] == 0.08 and rows[3]["choice"] is None
    stats = predicates.eval_stats(out.where("choice is not null")).first()
    assert (stats["n_answered"], stats["input_tokens"]) == (2, 624)
    assert predicates.yes_no(df, "t", "Urgent?", "yes", "no", scorer).where("number = 0.92").count() == 2
    city = spark.createDataFrame([("Paris", "Germany"), ("Rome", "Italy")], "name string, country string")

    def german(requests):
        return [{"number": 0.97 if '"country":"Germany"' in r["text"] else 0.1, "choice": "europe"} for r in requests]

    assert [r["name"] for r in predicates.row_filter(city, "the country is Germany", german).collect()] == ["Paris"]
    assert predicates.row_choice(city, "which continent?", ["europe", "asia"], german).where("choice = 'europe'").count() == 2
    assert predicates.row_score(city, "how german?", german).agg(F.max("score")).first()[0] == 0.97
    with pytest.raises(Exception, match="answers"):
        predicates.row_prob(city, "x", lambda requests: []).collect()


def test_assertions(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "k int, v string")
    out = assertions.assert_tables(
        spark,
        [
            assertions.rows_equal(a, a.orderBy("v"), "same"),
            assertions.rows_equal(a, a.distinct(), "not the same"),
            assertions.row_count_is(a, 3, "three"),
            assertions.holds_for_all(a, "v = 'x'", "all x"),
            assertions.is_unique(a, ["k"], "unique"),
            assertions.has_columns(a, ["k"], "has k"),
        ],
    ).orderBy("n").collect()
    assert [r["ok"] for r in out] == [True, False, True, False, False, True]
    assert out[1]["detail"] == "extra rows: 1 missing rows: 0" and out[0]["detail"] is None


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.75, 1.0])
def test_trigram_join_by_pairs_of_grams(spark, threshold):
    """Short and long numbered names: the pairs of a comparison of all."""
    from rankweave.operators import similar

    names = [f"Customer#{i:05d}" for i in range(0, 400, 7)] + ["a", "ab", "ab c", "b a", ""]
    names += [" ".join(f"{w}{i % 3}" for w in ("lorem", "ipsum", "dolor", "amet", "sit", "tempor", "magna"))[: 20 + i] for i in range(25)]
    df = spark.createDataFrame([(n,) for n in names], "t string")
    found = {(r[0], r[1], r[2]) for r in similar.trigram_join(df, "t", df, "t", threshold, same_table=True).collect()}

    def grams(text):
        words = re.findall(r"[a-z0-9]+", text.lower())
        return {f"  {w} "[i : i + 3] for w in words for i in range(len(w) + 1)}

    held = {n: grams(n) for n in names}
    expected = set()
    for a in held:
        for b in held:
            both = len(held[a] | held[b])
            if a < b and both and round(len(held[a] & held[b]) / both, 6) >= threshold:
                expected.add((a, b, round(len(held[a] & held[b]) / both, 6)))
    assert found == expected
    if threshold == 0.75:
        rows = similar._keyed(spark.createDataFrame([("x", 1, 20, list(range(20)), 6)], "value string, n_rows long, size int, grams array<long>, length int"), 0.75)
        assert rows.where("second < 0").count() == 0 and rows.count() == 21


def test_merge_is_dealt_by_rows(spark, monkeypatch):
    from rankweave.operators import versioned

    monkeypatch.setattr(versioned, "MERGE_ROWS", 20)
    base = spark.range(200).select("id", F.lit("old").alias("v"))
    log = base.where("id % 2 = 0").select("id", F.lit("new").alias("v"), F.lit(1).cast("long").alias("version"), F.lit("b").alias("branch"), F.lit("upsert").alias("op"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        merged = versioned.merge_branches(base, log, ["id"], [versioned.Line("main")], [versioned.Line("main", 0)], "b")
        assert merged.rdd.getNumPartitions() >= 10
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert merged.count() == 100
