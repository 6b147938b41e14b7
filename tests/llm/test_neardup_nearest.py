"""Near duplicates, leaks and nearest vectors against brute force."""

import random

import numpy as np
import pytest

from rankweave.llm import components, decontaminate, minhash, neardup, nearest, queries

FOLDER = "/root/testdata/sf0.001"


def shingles(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    width = min(width, len(words))
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def brute(rows, width, percent=80):
    """{row number: (size of its set, smallest key of its component)}."""
    sets = [shingles(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(least.get(find(i), key), key)
    return {i: (len(sets[i]), least.get(find(i)) if sets[i] else rows[i][0]) for i in range(len(rows))}


def check(spark, rows, width):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n int, node string")
    got = sorted(str((r["doc_id"], r["n_shingles"], r["component_id"])) for r in neardup.near_duplicates(docs, width=width).collect())
    assert got == sorted(str((k, *brute(rows, width)[i])) for i, (k, _) in enumerate(rows))


def prose(count):
    return [random.choice("abcdefghijklmnopqrstuvwxyz") + str(random.randrange(400)) for _ in range(count)]


def test_groups_of_near_copies_without_a_centre(spark, monkeypatch):
    """Chains, blocks that meet, and copies some of which are just below the threshold."""
    monkeypatch.setattr(neardup, "BLOCK", 8)
    random.seed(11)
    base = prose(60)
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(random.choice([1, 2, 3, 4])):
            words[random.randrange(60)] = f"new{random.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    chain = prose(80)
    for i in range(12):
        chain[5 * i] = f"c{i}"
        rows.append((100 + i, " ".join(chain)))
    rows += [(200 + i, " ".join(prose(40))) for i in range(20)]
    rows += [(None, None), (300, ""), (301, " \n\t"), (302, "One"), (303, "oNE"), (304, "one two"), (304, "one two"), (None, "lost copy here"), (305, "lost copy  HERE"), (None, "nobody")]
    rows.append((400, "long " + " ".join(prose(20_000))))
    check(spark, rows, 2)


def test_deduplicate_keeps_one_of_each(spark):
    rows = [(5, "a b c d e f g"), (3, "A b c d e f G"), (3, "A b c d e f G"), (9, "other words are in here"), (None, None), (1, "")]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, first int")
    kept = neardup.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "9", "None"]
    assert neardup.deduplicate(docs.limit(0)).count() == 0


def test_query_on_the_small_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    want = brute(docs, 2)
    got = sorted(str(tuple(r)) for r in queries.op8_near_duplicates(spark, FOLDER).collect())
    assert got == sorted(str((k, *want[i], k == want[i][1])) for i, (k, _) in enumerate(docs))


def test_components_of_chains_and_stars(spark):
    random.seed(2)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 20)] + [(7, 7), (None, 3)]
    names = list(range(200))
    random.shuffle(names)
    pairs = [(None if a is None else names[a], names[b]) for a, b in edges]
    df = spark.createDataFrame(pairs, "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(df, "a", "b").collect()}
    first, second = [names[i] for i in range(41)], [names[i] for i in range(100, 120)]
    assert got == {n: min(first) for n in first} | {n: min(second) for n in second}


def test_posterior_bounds_keep_similar_pairs():
    random.seed(1)
    kept = 0
    for _ in range(50):
        common = {f"w{i}" for i in range(160)}
        left, right = common | {f"l{i}" for i in range(20)}, common | {f"r{i}" for i in range(20)}
        sets = [np.unique(np.array([minhash.xxhash.xxh3_64_intdigest(x) for x in s], np.uint64)) for s in (left, right)]
        a, b = (minhash.signature(s, neardup.HASHES)[None] for s in sets)
        kept += len(minhash.may_reach(a, b, 0.8, neardup.MISS, neardup.STEP))
    assert kept == 50
    far = np.zeros((1, neardup.HASHES), np.uint16)
    assert not len(minhash.may_reach(far, far + 1, 0.8, neardup.MISS, neardup.STEP))


def distance(item, region):
    rows = list(range(len(region) + 1))
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(region, 1):
            new.append(min(rows[j] + 1, new[-1] + 1, rows[j - 1] + (x != y)))
        rows = new
    return min(rows), rows.index(min(rows))


def test_prefix_distance():
    random.seed(4)
    for _ in range(400):
        item, region = ([random.choice("abcd") for _ in range(random.randint(low, 14))] for low in (1, 0))
        assert decontaminate.prefix_distance(item, region) == distance(item, region)


@pytest.mark.parametrize("vocabulary", [decontaminate.VOCABULARY, 0])
def test_edited_passages_leak_and_others_do_not(spark, monkeypatch, vocabulary):
    monkeypatch.setattr(decontaminate, "VOCABULARY", vocabulary)
    random.seed(6)
    items = [prose(random.choice([6, 14, 25, 40, 70])) for _ in range(20)]
    rows, want = [], set()
    for i in range(60):
        number, words = i % 20, list(items[i % 20])
        budget = len(words) * decontaminate.PERCENT // 100
        edits = [0, budget, 3 * budget + 3][i // 20]
        for _ in range(edits):
            words[random.randrange(len(words))] = f"Zz{random.randrange(10**6)}"
        rows.append((i, " ".join(prose(30) + words + prose(30)).upper()))
        if min(distance(items[number], (rows[-1][1].lower().split())[s : s + 2 * len(words)])[0] for s in range(80)) <= budget:
            want.add((i, number))
    rows += [(None, None), (70, ""), (71, " ".join(items[3])), (71, " ".join(items[3])), (None, " ".join(items[4]))]
    want |= {(71, 3), (None, 4)}
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, start int")
    given = spark.createDataFrame([*enumerate(map(" ".join, items)), (90, None), (91, "too short")], "item_id long, text string")
    got = [(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, given).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    clean = decontaminate.without_leaks(docs, given)
    assert clean.columns == docs.columns
    assert clean.count() == len(rows) - len({d for d, _ in want if d is not None}) - 1 - 1
    assert decontaminate.leaks(docs, given.limit(0)).count() == decontaminate.leaks(docs.limit(0), given).count() == 0


def test_query_finds_the_passages_of_the_small_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    items = {r["item_id"]: decontaminate.words_of(r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()}
    want = {
        (d["doc_id"], i) for d in docs for i, w in items.items() if f" {' '.join(w)} " in f" {' '.join(decontaminate.words_of(d['text']))} "
    }
    got = {(r["doc_id"], r["item_id"]) for r in queries.op4_decontamination(spark, FOLDER).collect()}
    assert want <= got and want


def exact(ids, vectors, query, k):
    scores = vectors @ vectors[query]
    order = np.lexsort((ids, -scores))
    return [int(ids[o]) for o in order if ids[o] != ids[query]][:k]


def test_nearest_with_hot_and_void_vectors(spark):
    random = np.random.default_rng(3)
    vectors = random.normal(size=(400, 12)).astype(np.float32)
    vectors[100:220] = vectors[100]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    odd = [(1000, None), (1001, [0.0] * 12), (1002, [float("nan")] + [1.0] * 11), (1020, [1.0, None] + [1.0] * 10), (1040, [9.0]), (None, [5.0] * 12), (1060, [float("inf")] * 12)]
    table = spark.createDataFrame(rows + rows[:3] + odd, "vec_id long, embedding array<float>")
    got = nearest.nearest(table, table.where("vec_id % 20 = 0"), k=20).toPandas()
    ids, wide = np.arange(400), vectors.astype(np.float64)
    hits = 0
    for query, found in got.groupby("query_id"):
        found = found.sort_values("rank")
        assert found["rank"].tolist() == list(range(1, 21))
        assert np.allclose(found["score"], wide[found["vec_id"]] @ wide[query], rtol=0, atol=1e-12)
        pairs = list(zip(-found["score"], found["vec_id"]))
        assert pairs == sorted(pairs) and query not in set(found["vec_id"])
        hits += len(set(found["vec_id"]) & set(exact(ids, wide, query, 20)))
    assert got["query_id"].nunique() == 20
    assert hits / 400 >= 0.9
    assert nearest.nearest(table.limit(0), table).count() == 0


def test_fewer_vectors_than_asked_for(spark):
    table = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(5)], "vec_id long, embedding array<double>")
    got = nearest.nearest(table, table.where("vec_id = 0"), k=20).orderBy("rank").collect()
    assert [(r["rank"], r["vec_id"]) for r in got] == [(1, 1), (2, 2), (3, 3), (4, 4)]


def test_scan_gives_up_no_near_candidate():
    random = np.random.default_rng(9)
    stored, queries_ = random.normal(size=(3000, 40)), random.normal(size=(5, 40))
    rotation, _ = np.linalg.qr(random.normal(size=(40, 40)))
    cuts = list(range(0, 40, nearest.COLUMNS))
    turned = stored @ rotation
    blocks = [turned[:, c : c + nearest.COLUMNS] for c in cuts]
    squares = ((stored[None] - queries_[:, None]) ** 2).sum(axis=2)
    bounds = np.sort(squares, axis=1)[:, 40]
    row, column = nearest._scan(blocks, cuts, queries_ @ rotation, bounds, 40)
    true = {(q, i) for q in range(5) for i in np.argsort(squares[q])[:20]}
    assert len(true & set(zip(row.tolist(), column.tolist()))) >= 0.95 * len(true)
    assert len(row) < 5 * 100
