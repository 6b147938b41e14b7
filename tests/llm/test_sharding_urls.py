"""Placement against a plain simulation of the turns, URL verdicts against plain Python and SQL."""

import duckdb
import pytest

from rankweave.llm import queries, sharding, urls

FOLDER = "/root/testdata/sf0.001"


def simulated(shards, size):
    """Whole preference lists, each consumed turn by turn."""
    orders = []
    for name in shards:
        start, stride = sharding._digest(name, "start") % size, sharding._digest(name, "stride") % (size - 1) + 1
        orders.append([(start + i * stride) % size for i in range(size)])
    owner = {}
    turn = 0
    while len(owner) < size:
        shard = turn % len(shards)
        owner[next(s for s in orders[shard] if s not in owner)] = shard
        turn += 1
    return [owner[s] for s in range(size)]


@pytest.mark.parametrize("count, size", [(1, 2), (3, 7), (5, 5), (4, 101), (7, 211)])
def test_fill_is_the_simulated_one(count, size):
    names = [f"n{i}" for i in range(count)]
    assert sharding.fill_slots(names, size) == simulated(names, size)


def test_shares_are_even_and_stable():
    names = [f"n{i}" for i in range(10)]
    before, after = sharding.fill_slots(names, 1009), sharding.fill_slots(names[:-1], 1009)
    counts = [before.count(i) for i in range(10)]
    assert max(counts) - min(counts) <= 1
    moved = sum(a != b for a, b in zip(before, after) if a != 9)
    assert moved < 0.2 * 1009


@pytest.mark.parametrize("shards, size", [([], None), (["a", "a"], None), (["a"], 4), (["a", "b", "c"], 2)])
def test_bad_tables_are_refused(shards, size):
    with pytest.raises(ValueError):
        sharding.fill_slots(shards, size)


def test_place_keeps_every_row(spark):
    rows = [(None, "x", 1), (None, "y", 2), (5, "x", 3), (5, "x", 3), (2**60, None, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, shard string, slot int")
    placed = sharding.place(docs, "doc_id", ["a", "b", "c"]).collect()
    assert len(placed) == 5 and len({(r["doc_id"], r["slot"], r["shard"]) for r in placed}) == 3
    slots = sharding.fill_slots(["a", "b", "c"])
    assert all("abc"[slots[r["slot"]]] == r["shard"] for r in placed)
    assert sharding.place(docs.limit(0), "doc_id", ["a"]).count() == 0


def test_written_shards(spark, tmp_path):
    docs = spark.range(200).withColumnRenamed("id", "doc_id")
    sharding.write_shards(docs, "doc_id", ["a", "b"], f"{tmp_path}/out", splits=2)
    read = spark.read.parquet(f"{tmp_path}/out")
    placed = sharding.place(docs, "doc_id", ["a", "b"]).select("doc_id", "shard")
    assert sorted(map(tuple, read.collect())) == sorted(map(tuple, placed.collect()))


URLS = [
    None, "", "no scheme/en/", "http://", "http://com", "http://com/", "HTTP://WWW.Example.COM/en/x", "x://a.example.com/en/",
    "https://example.com/en", "https://example.com?/en/", "https://www.example.com/EN/", "a://b://example.com/en/",
    "ftp://net/es/1#x", "ftp://a.b.net/fr/?q", "ftp://netx/fr/", "ftp://.net/fr/", "ftp://net./fr/", "ftp://x.Net:80/fr/",
    "http://www.example.com/en/" + "a/" * 3000, "http://" + "a." * 2000 + "com/x", "http://É.com/x\ny",
]


def judged(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        rest = rest[cut:]
        path = rest[: min([i for i in (rest.find(c) for c in "?#") if i >= 0], default=len(rest))]
    fits = [(len(h + p), h + p, v) for h, p, v in queries.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


@pytest.mark.parametrize("limit", [urls.BROADCAST_RULES, 0])
def test_verdicts_on_awkward_urls(spark, monkeypatch, limit):
    monkeypatch.setattr(urls, "BROADCAST_RULES", limit)
    rules = spark.createDataFrame([*queries.RULES, (None, "/", "block")], "host string, path string, verdict string")
    rows = [(i, u, "x", "y") for i, u in enumerate(URLS)] + [(None, URLS[6], "x", "y")] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule string")
    got = sorted(map(str, map(tuple, urls.judge(pages, rules).collect())))
    assert got == sorted(str((i, *judged(u))) for i, u, _, _ in rows)
    assert urls.judge(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in urls.judge(pages, rules.limit(0)).collect()} == {"allow"}


def test_longer_host_and_block_break_ties(spark):
    rules = spark.createDataFrame(
        [("b.c", "/dd", "allow"), ("a.b.c", "/", "block"), ("c", "/", "allow"), ("c", "/", "block")],
        "host string, path string, verdict string",
    )
    pages = spark.createDataFrame([(1, "x://a.b.c/dd"), (2, "x://c/")], "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judge(pages, rules).collect()}
    assert got == {1: ("a.b.c/", "block"), 2: ("c/", "block")}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_their_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "pages"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    cursor = duck.execute(queries.ORACLES[name])
    names = [d[0] for d in cursor.description]
    want = sorted(str(tuple(r)) for r in cursor.fetchall())
    got = queries.QUERIES[name](spark, FOLDER).select(*names).collect()
    assert sorted(str(tuple(r)) for r in got) == want
