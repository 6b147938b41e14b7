"""License phrases against plain search, edited texts; pieces against the public library."""

import random
import re

import pytest

from rankweave.llm import licenses, pieces, queries

FOLDER = "/root/testdata/sf0.001"
SPLIT = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TABLE = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text):
    words = SPLIT.findall((text or "").translate(TABLE))
    places, labels = [], set()
    for phrase, label in licenses.PHRASES:
        want = phrase.split()
        for i in range(len(words)):
            if words[i : i + len(want)] == want:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


TEXTS = [
    None, "", "...", "MIT License", "the mit-license, MIT\nLICENSE mit", "General Public General Public License License",
    "general public license " * 400, "İmit license É apache license é", "mit licenses, mit  license", "x" * 100_000 + " apache license",
    "all rights reserved", "all rights are reserved",
]


def digest(rows):
    return sorted(
        str((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"])) for r in rows
    )


def test_base_phrases_on_awkward_texts(spark, monkeypatch):
    rows = [(i, t, 1, 2) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], 1, 2), (None, TEXTS[4], 1, 2), (None, TEXTS[4], 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, p int, template int")
    monkeypatch.setattr(queries, "table", lambda *_: docs)
    got = queries.op5_licenses(spark, "").collect()
    assert digest(got) == sorted(str((i, *brute(t))) for i, t, _, _ in rows)
    assert {r["doc_id"]: r["labels"] for r in got}[10] == "reserved"
    assert {r["doc_id"]: r["labels"] for r in got}[11] == ""
    assert licenses.find_licenses(docs.limit(0)).count() == 0


def test_query_on_the_small_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    assert digest(queries.op5_licenses(spark, FOLDER).collect()) == sorted(str((d["doc_id"], *brute(d["text"]))) for d in docs)


def test_edited_texts_are_spans(spark):
    whole = licenses.TEMPLATES[0][0].split()
    edited = whole[:8] + ["new", "words"] + whole[8:30] + whole[33:]
    half = whole[:20]
    docs = spark.createDataFrame(
        [(1, "a b c " + " ".join(whole)), (2, "a " + " ".join(edited) + " z"), (3, " ".join(half)), (4, (" ".join(whole) + " . x y z ") * 2)],
        "doc_id long, text string",
    )
    got = {r["doc_id"]: [(s["first"], s["last"], s["label"]) for s in r["spans"]] for r in licenses.find_licenses(docs).collect()}
    n = len(whole)
    assert got[1] == [(3, 3 + n, "mit")]
    assert got[2] == [(1, 1 + len(edited), "mit")]
    assert got[3] == []
    assert got[4] == [(0, n, "mit"), (n + 3, 2 * n + 3, "mit")]


@pytest.fixture(scope="module")
def machine():
    return pieces.Transducer(queries.MODEL)


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=queries.MODEL)


def test_ids_are_the_librarys(machine, library):
    random.seed(5)
    letters = ["a", "b", "e", "t", "h", "ing", "the", " ", "  ", "▁", "é", "中", "日本", "😀", "\n", "\t", "<s>", "<0x41>", "\0", "0", "=="]
    texts = ["".join(random.choices(letters, k=random.randint(0, 16))) for _ in range(4000)]
    texts += ["".join(random.choices([p.replace("▁", " ") for p in machine.arcs], k=4)) for _ in range(4000)]
    texts += ["ab" * 20_000, "", " ", "\u2581"]
    for text in texts:
        ids = library.encode(text)
        assert machine.encode(text) == ids, text
        assert machine.decode(ids) == library.decode(ids), text


def test_unigram_models_take_the_likeliest_path(machine):
    small = pieces.Transducer.__new__(pieces.Transducer)
    small.__dict__ |= {"kind": pieces.UNIGRAM, "pieces": ["<unk>", "a", "b", "ab", "ba", "aba"], "scores": [0, -2.0, -2.0, -3.0, -3.5, -9.0], "kinds": [2, 1, 1, 1, 1, 1], "unknown": 0, "bytes": {}}
    small.arcs = {p: i for i, p in enumerate(small.pieces) if i}
    small.spelled = {p[:n]: -1 for p in small.arcs for n in range(1, len(p))} | small.arcs
    assert small._path("aba") == (3, 1)
    assert small._path("abba") == (3, 4)
    assert small._path("axb") == (1, 0, 2)


def test_columns_and_odd_rows(spark, library):
    texts = [None, "", "Hello  wörld ", "a\n" * 30_000, "mark ▁ here", "Hello  wörld "]
    docs = spark.createDataFrame([(i or None, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    out = pieces.encode(docs, queries.MODEL, with_text=True).collect()
    assert [r["ids"] for r in out] == [None if t is None else library.encode(t) for t in texts]
    assert [r["exact"] for r in out] == [True, True, True, True, False, True]
    coded = pieces.encode(docs, queries.MODEL)
    back = pieces.decode(coded, queries.MODEL).collect()
    assert [r["text"] for r in back] == [t if t is None else t.replace("▁", " ") for t in texts]
    assert pieces.encode(docs.limit(0), queries.MODEL).count() == 0


def test_query_round_trip(spark):
    out = queries.op6_pieces(spark, FOLDER)
    assert out.where("not exact").count() == 0 and out.count() == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
