"""Manifests, fingerprints and collocations: brute force, ties, nulls, empty tables, clashing names."""

import hashlib
import os
import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from rankweave.llm import collocations, fingerprints, merkle, queries

FOLDER = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(digests, arity, paths):
    """The root of (digest, leaf numbers) nodes; siblings go to the leaves' paths."""
    while len(digests) > 1:
        up = []
        for i in range(0, len(digests), arity):
            run = digests[i : i + arity]
            for at, (_, below) in enumerate(run):
                for leaf in below:
                    paths[leaf].append(("".join(d for d, _ in run[:at]), "".join(d for d, _ in run[at + 1 :])))
            up.append((sha("".join(d for d, _ in run)), [x for _, below in run for x in below]))
        digests = up
    return digests[0]


def brute_manifest(rows, arity):
    leaves = sorted(((r[1] is not None, r[1] or "", r[0] is not None, r[0] or 0, leaf_of(r)) for r in rows))
    paths = [[] for _ in leaves]
    tops = []
    for group in sorted({x[:2] for x in leaves}, key=lambda g: (g[0], g[1].encode())):
        tops.append(climb([(x[4], [i]) for i, x in enumerate(leaves) if x[:2] == group], arity, paths))
    subroots = {i: d for d, below in tops for i in below}
    root = climb(tops, arity, paths)[0]
    return sorted((x[4], subroots[i], root, str(paths[i])) for i, x in enumerate(leaves))


@pytest.mark.parametrize("arity,levels", [(2, 10), (2, 2), (3, 2)])
def test_manifest_is_the_brute_force_tree(spark, monkeypatch, arity, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    random.seed(arity)
    rows = [(random.randrange(10**6), random.choice(["en", "fr", "é", "", None, "en"]), f"text {i}") for i in range(90)]
    rows += [(7, "only", None), (None, "en", ""), (None, "en", None), (5, "en", "x"), (5, "en", "x"), (5, "en", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    tree = merkle.manifest(docs, arity=arity)
    got = sorted((r["leaf"], r["subroot"], r["root"], str([tuple(s) for s in r["path"]])) for r in tree.collect())
    assert got == brute_manifest(rows, arity)
    assert tree.where(merkle.folded(F.col("leaf"), F.col("path")) != F.col("root")).count() == 0


def test_manifest_of_one_row_and_of_none(spark):
    docs = spark.createDataFrame([(1, "en", "long " * 50_000, "z")], "doc_id long, lang string, text string, __group string")
    only = merkle.manifest(docs, columns=["doc_id", "text"], carry={"more": F.lit(4)}).first()
    assert only["leaf"] == only["subroot"] == only["root"] == leaf_of((1, "long " * 50_000)) and only["path"] == [] and only["more"] == 4
    assert merkle.manifest(docs.limit(0)).count() == 0


def test_any_change_shows(spark):
    docs = spark.createDataFrame([(i, "aa", str(i)) for i in range(9)], "doc_id long, lang string, text string")
    tree = merkle.manifest(docs)
    forged = tree.select(merkle.folded(F.when(F.col("doc_id") == 4, F.sha2(F.lit("x"), 256)).otherwise(F.col("leaf")), F.col("path")).alias("f"), "root", "doc_id")
    assert [r["doc_id"] for r in forged.where("f != root").collect()] == [4]
    with pytest.raises(ValueError):
        merkle.manifest(docs, arity=1)


def numbers(text):
    """A fingerprint by plain sums."""
    out = [0] * (fingerprints.WIDE + fingerprints.SIGNS)
    for p in filter(None, re.split(r"[\n\r]", text or "")):
        for i in range(fingerprints.WIDE):
            out[i] = (out[i] + int(sha(p)[8 * i : 8 * i + 8], 16)) % 2**32
        for s in filter(None, (x.strip(" \t") for x in re.split(r"[.!?]", p))):
            for i in range(fingerprints.SIGNS):
                word, j = divmod(i, fingerprints.BITS)
                bit = int(sha(s)[15 * word : 15 * word + 15], 16) >> (j // 4 + fingerprints.FIELD * (j % 4)) & 1
                at = fingerprints.WIDE + i
                out[at] = (out[at] + 2 * bit - 1 + 2**15) % 2**16 - 2**15
    return out


@pytest.mark.parametrize("chunk", [fingerprints.CHUNK, 3])
def test_fingerprints_add_up(spark, monkeypatch, chunk):
    monkeypatch.setattr(fingerprints, "CHUNK", chunk)
    texts = ["a b. c d!\ne f\n\ng", "g\na b. c d!\ne f", "one", "", None, "Ünï. cödé\r\nzwei", "x. " * 3_000 + "\nlast"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, x int")
    got = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprints(docs).collect()}
    assert got == {i: numbers(t) for i, t in enumerate(texts)}
    assert got[0] == got[1] != got[2] and got[3] == got[4]
    whole = fingerprints.dataset_fingerprint(docs).first()["fingerprint"]
    assert whole == numbers("\n".join(t or "" for t in texts))
    assert fingerprints.dataset_fingerprint(docs.limit(0)).first()["fingerprint"] == [0] * len(whole)
    both = spark.createDataFrame([("a\nb. c", "b. c\nd")], "l string, r string").select(fingerprints.fingerprint(F.col("l")).alias("l"), fingerprints.fingerprint(F.col("r")).alias("r"))
    row = both.select(fingerprints.added(F.col("l"), F.col("r")).alias("sum"), fingerprints.removed(F.col("l"), F.col("r")).alias("less"), fingerprints.likeness(F.col("l"), F.col("r")).alias("near"), fingerprints.likeness(F.col("l"), F.col("l")).alias("same"))
    row = row.withColumn("back", fingerprints.added("less", fingerprints.fingerprint(F.lit("b. c\nd")))).first()
    assert row["sum"] == numbers("a\nb. c\nb. c\nd") and row["back"] == numbers("a\nb. c")
    assert row["same"] == 1.0 and 0.4 < row["near"] < 0.9


def test_edits_borrow_from_the_next_text(spark):
    rows = [(3, "cccccc"), (1, "ab"), (2, "bbbbbbbbb"), (2, "bbbbbbbbb"), (None, "n" * 7), (9, None), (4, "é" * 3)]
    docs = spark.createDataFrame([(*r, "q") for r in rows], "doc_id long, text string, edited string")
    got = sorted(str((r["doc_id"], r["text"], r["edited"])) for r in fingerprints.edited_by_next(docs).collect())
    want = [(9, "", ""), (4, "é" * 3, "ééc"), (3, "cccccc", "ccccbb"), (2, "b" * 9, "b" * 9), (2, "b" * 9, "bbbbbbab"), (1, "ab", "ab"), (None, "n" * 7, "nnnnn")]
    assert got == sorted(map(str, want))
    assert fingerprints.edited_by_next(docs.limit(0)).count() == 0
    alone = fingerprints.edited_by_next(docs.where("doc_id = 3")).first()
    assert alone["edited"] == "cccccc" and alone["next_print"] == numbers("cccccc")


def brute_phrases(rows, longest, least, percent, top):
    counts = {}
    for group, text in rows:
        own = counts.setdefault("und" if group is None else group, Counter())
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\n-\r]", lowered):
            words = re.findall(r"[^ \t]+", piece)
            own.update(tuple(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    out = []
    for group, own in counts.items():
        found = []
        held = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        for p, a in held.items():
            inside = any(len(q) > len(p) and 100 * f >= percent * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, f in held.items())
            if not inside:
                score, k = min((2_000_000 * a // (own[p[:k]] + own[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        n = sum(f for p, f in own.items() if len(p) == 1)
        out += [(group, i + 1, p.decode(), -a, left, right, n, -score) for i, (score, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


@pytest.mark.parametrize("parts", [{}, {"RANKED": 3, "SLICE_WORDS": 50, "VOCABULARY": 20, "MOST_BITS": 1 << 16}])
def test_collocations_are_the_brute_force_ones(spark, monkeypatch, parts):
    for name, value in parts.items():
        monkeypatch.setattr(collocations, name, value)
    random.seed(8)
    words = ["the", "The", "new", "york", "city", "é", "É", " x", "a\x1cb", "of", "und"]
    rows = []
    for i in range(400):
        said = [random.choice(words) if random.random() < 0.6 else "new york city" for _ in range(random.randrange(12))]
        text = random.choice([" ", "\t", "  "]).join(said)
        rows.append((random.choice(["en", "en", "en", None, "und", ""]), text + random.choice([". ", ",", "\n", "\x0b", ""]) + text))
    rows += [("xx", "same same same " * 20), ("en", None), ("en", ""), (None, None), ("yy", "!"), rows[0], rows[0]]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "lang string, text string, grp int")
    for top in (2000, 3):
        got = sorted(tuple(r) for r in collocations.collocations(docs, least=20, top=top).collect())
        assert got == brute_phrases(rows, 4, 20, 80, top) and len(got) > 5
    assert collocations.collocations(docs.limit(0)).count() == 0
    two = sorted(tuple(r) for r in collocations.collocations(docs, longest=2, least=20).collect())
    assert two == brute_phrases(rows, 2, 20, 80, 2000)


def test_stripes_hold_counted_entries_only(spark):
    said = spark.createDataFrame([("en", "a b c. a b d. a b c")] * 3, "grp string, text string")
    first = collocations.stripes(said, [1], 4)
    assert sorted(map(tuple, first.groupBy("word").sum("f").collect())) == [("", 3), ("a", 9), ("b", 9), ("c", 6)]
    bitmap = collocations._bitmap(collocations._extensions(first))
    second = collocations.stripes(said, [2], 4, 1, bitmap)
    assert sorted(map(tuple, second.collect())) == [("en", "a", "b", 9), ("en", "b", "c", 6)]
    counter = collocations._Counter([2], 1, bitmap, collocations._hashes([]))
    counter.add("en", "a b. d a")
    # No stripe for prefixes that no frequent word follows.
    assert [(r["prefix"], r["words"]) for b in counter.stripes() for r in b.to_pylist()] == [("a", "b")]


def test_counts_of_parts_are_broadcast_only_where_counted(spark, monkeypatch):
    """Spark sees neither copies made in a plan nor how large packed rows are in memory."""
    merged = spark.createDataFrame([("en", "a", "b", 9), ("en", "b", "c", 6)], "grp string, prefix string, word string, f long")
    counts = spark.createDataFrame([("en", w, n) for w, n in (("a", 9), ("b", 90_000), ("c", 9))], "grp string, part string, f long")
    rows = []
    for most in (0, 10):
        monkeypatch.setattr(collocations, "BROADCAST_ROWS", most, raising=False)
        scored = collocations._scored([merged], counts, 100_000)
        plan = scored._jdf.queryExecution().executedPlan().toString()
        assert ("SortMergeJoin" in plan) == (most == 0)
        rows.append(sorted(map(tuple, scored.collect())))
    assert rows[0] == rows[1] == [("en", "a b", 9, 9, 90_000, 199, 2), ("en", "b c", 6, 90_000, 9, 133, 2)]
    kept = collocations._without_subsumed(scored, [merged.limit(0), merged.limit(0), merged], 80)
    assert "rightHint=(strategy=merge)" in kept._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["op11_manifest", "op12_fingerprints", "op13_collocations"])
def test_query_equals_its_sql(spark, name):
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    cursor = con.execute(queries.ORACLES[name])
    names = [d[0] for d in cursor.description]
    found = queries.QUERIES[name](spark, FOLDER)
    assert sorted(found.columns) == sorted(names)
    assert sorted(map(str, (tuple(r[c] for c in names) for r in found.collect()))) == sorted(map(str, cursor.fetchall()))
