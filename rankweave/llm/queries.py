"""The registered corpus queries: thin digests over the operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.llm import (
    collocations,
    decontaminate,
    fingerprints,
    language,
    licenses,
    merkle,
    nearest,
    neardup,
    pieces,
    secrets,
    sharding,
    toxicity,
    urls,
)
from rankweave.sources import table

SHARDS = [f"shard-{i:02d}" for i in range(16)]


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document."""
    return sharding.place(table(spark, sf_dir, "documents"), "doc_id", SHARDS)


def _held_out(key: str = "doc_id"):
    """Rows that no model may learn from."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = table(spark, sf_dir, "documents")
    model = language.learn(docs.where(~_held_out()))
    found = language.identify(docs, model)
    return found.select("doc_id", _held_out().alias("held_out"), "lang_pred", "score")


RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL."""
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return urls.judge(table(spark, sf_dir, "pages"), rules)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that every document holds; clean documents have no row."""
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("text_hash")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and texts of every document."""
    found = licenses.find_licenses(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["phrase"])

    def labels(spans):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")

    starts = F.transform(base, lambda s: s["first"])
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["cover"])), F.lit(0.0)).alias("score"),
    )


MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The piece ids of every document, and whether they decode to its text again."""
    docs = table(spark, sf_dir, "documents")
    coded = pieces.encode(docs, MODEL, with_text=True)
    return coded.select("doc_id", "ids", "n_pieces", "exact")


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors to every twentieth vector."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document, over two-word shingles."""
    found = neardup.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)
    kept = F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    return found.select("doc_id", "n_shingles", "component_id", kept)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels").where(~_held_out()))
    scored = toxicity.score(docs, model)
    return scored.select(
        "doc_id",
        _held_out().alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"),
    )


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of every document, base kinds counted and digested."""
    scanned = secrets.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["strong"])

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["name"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["name"] == kind)).cast("long").alias(f"n_{kind}")

    return scanned.select(
        "doc_id",
        *map(count, secrets.STRONG),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


LEAF = ("doc_id", "source", "lang", "n_chars", "text")


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaf, roots and proof of every document; every seventh is verified as tampered with."""
    docs = table(spark, sf_dir, "documents")
    more = {"n_chars": (F.col("n_chars").cast("decimal(21,0)") + 1)}
    forged = merkle.digest(*[more.get(c, F.col(c)) for c in LEAF])
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    tree = merkle.manifest(docs, "doc_id", "lang", LEAF, carry={"forged": F.when(tampered, forged)})
    shown = tree.select(
        "doc_id", "leaf", "subroot", "root", merkle.proof(F.col("path")).alias("proof_sha256"), merkle.folded(F.coalesce("forged", "leaf"), F.col("path")).alias("folded_root")
    )
    return shown.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and how alike they are."""
    pairs = fingerprints.edited_by_next(table(spark, sf_dir, "documents"))
    prints = pairs.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprints.fingerprint(F.col("text")).alias("own"),
        fingerprints.fingerprint(F.col("edited")).alias("other"),
        "next_print",
    )
    return prints.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprints.encoded(F.col("own")).alias("fingerprint"),
        fingerprints.encoded(F.col("other")).alias("edited_fingerprint"),
        fingerprints.likeness(F.col("own"), F.col("other")).alias("near_edited"),
        fingerprints.likeness(F.col("own"), F.coalesce("next_print", "own")).alias("near_next"),
    )


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 phrases of every language."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_language": op2_language,
    "op3_url_filters": op3_url_filters,
    "op4_decontamination": op4_decontamination,
    "op5_licenses": op5_licenses,
    "op6_pieces": op6_pieces,
    "op7_nearest": op7_nearest,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_toxicity": op9_toxicity,
    "op10_secrets": op10_secrets,
    "op11_manifest": op11_manifest,
    "op12_fingerprints": op12_fingerprints,
    "op13_collocations": op13_collocations,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _licenses_sql() -> str:
    """Votes of equal word k-grams by diagonal, merged and verified by what they cover."""
    rows = [(t, label, i < len(licenses.PHRASES)) for i, (t, label) in enumerate([*licenses.PHRASES, *licenses.TEMPLATES])]
    values = ", ".join(f"({i}, '{t}', '{label}', {phrase})" for i, (t, label, phrase) in enumerate(rows))
    short, long = licenses.SHORT, licenses.LONG
    return f"""
        WITH docs AS (
            SELECT row_number() OVER () AS r, doc_id,
                   regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
        given AS (
            SELECT template, label, phrase, string_split(body, ' ') AS w, len(string_split(body, ' ')) AS length,
                   if(len(string_split(body, ' ')) <= {licenses.PHRASE_WORDS}, {short}, {long}) AS k
            FROM (VALUES {values}) v(template, body, label, phrase)),
        places AS (SELECT *, unnest(range(length - k + 1)) AS t FROM given),
        grams AS (SELECT template, label, phrase, length, k, t, array_to_string(w[t + 1:t + k], ' ') AS g FROM places),
        said AS (SELECT r, k, p, array_to_string(w[p + 1:p + k], ' ') AS g
                 FROM (SELECT r, w, k, unnest(range(len(w) - k + 1)) AS p FROM docs, (VALUES ({short}), ({long})) s(k))),
        votes AS (SELECT r, template, label, phrase, length, k, p - t AS d, t FROM said JOIN grams USING (k, g)),
        diagonals AS (SELECT r, template, label, phrase, length, k, d, list(DISTINCT t) AS ts FROM votes GROUP BY ALL),
        marked AS (
            SELECT *, if(phrase OR coalesce(d - lag(d) OVER o > least({licenses.SLACK}, length // 4), true), 1, 0) AS fresh
            FROM diagonals WINDOW o AS (PARTITION BY r, template ORDER BY d)),
        grouped AS (SELECT *, sum(fresh) OVER (PARTITION BY r, template ORDER BY d) AS copy FROM marked),
        covered AS (
            SELECT r, template, label, phrase, length, copy, min(d + list_min(ts)) AS first,
                   len(list_distinct(flatten(list(flatten(list_transform(ts, lambda t: range(t, t + k))))))) / length AS cover
            FROM grouped GROUP BY r, template, label, phrase, length, copy),
        spans AS (SELECT * FROM covered WHERE cover >= if(length <= {licenses.PHRASE_WORDS}, 1, {licenses.COVER}))
        SELECT doc_id, len(any_value(w))::BIGINT AS n_words, count(*) FILTER (phrase) AS n_base,
               (min(first) FILTER (phrase))::BIGINT AS first_word, (max(first) FILTER (phrase))::BIGINT AS last_word,
               coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (phrase), '') AS base_labels,
               coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels,
               coalesce(max(cover), 0)::DOUBLE AS score
        FROM docs LEFT JOIN spans USING (r) GROUP BY r, doc_id
    """


def _spans_sql() -> str:
    """The spans of every kind, positions summed up as lengths; then links within the scope.

    A key is a maximal run of its characters, which says the same as the look-around.
    """
    parts = []
    for number, kind in enumerate(secrets.KINDS):
        pattern, good = kind.pattern, f"length(g) >= {kind.least}"
        if kind.name == "key":
            pattern = "[A-Za-z0-9/+=]+"
            good = "length(g) = 40 AND NOT contains(g, '=') AND " + " AND ".join(
                f"regexp_matches(g, '[{c}]')" for c in ("a-z", "A-Z", "0-9")
            )
        quoted = "'" + pattern.replace("'", "''") + "'"
        parts.append(
            f"SELECT r, {number} AS kind, regexp_extract_all(x, {quoted}) AS hits, string_split_regex(x, {quoted}) AS gaps, "
            f"list_transform(regexp_extract_all(x, {quoted}, {kind.group}), lambda g: {good}) AS good FROM t"
        )
    needs = " ".join(
        f"WHEN {i} THEN " + " AND ".join(f"{role}_near" for role in kind.needs)
        for i, kind in enumerate(secrets.KINDS)
        if kind.needs
    )
    names = ", ".join(f"'{k.name}'" for k in secrets.KINDS)
    roles = ", ".join(f"'{k.role}'" for k in secrets.KINDS)
    near = ", ".join(
        f"bool_or(p.role = '{role}') AS {role}_near" for role in (secrets.IDENTIFIER, secrets.SECRET, secrets.ENDPOINT)
    )
    strong = len(secrets.STRONG)
    union = " UNION ALL ".join(parts)
    return f"""
        WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS x FROM documents),
        raw AS ({union}),
        each AS (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM raw),
        spans AS (
            SELECT r, kind, [{names}][kind + 1] AS name, [{roles}][kind + 1] AS role, s, s + length(hits[i]) AS e
            FROM (SELECT *, list_sum(list_transform(gaps[1:i], lambda g: length(g)))::BIGINT
                         + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0)::BIGINT AS s
                  FROM each WHERE good[i])),
        met AS (SELECT w.r, w.kind, w.s, w.e, {near} FROM spans w JOIN spans p
                  ON w.r = p.r AND w.kind >= {strong} AND p.s - w.e <= {secrets.SCOPE} AND w.s - p.e <= {secrets.SCOPE}
                GROUP BY ALL),
        kept AS (SELECT * FROM spans WHERE kind < {strong}
                 UNION ALL SELECT spans.* FROM spans JOIN met USING (r, kind, s, e) WHERE CASE kind {needs} END)
        SELECT doc_id,
               count(*) FILTER (name = 'assign') AS n_assign,
               count(*) FILTER (name = 'access') AS n_access,
               count(*) FILTER (name = 'hex') AS n_hex,
               sha256(coalesce(string_agg(concat_ws(':', name, s, e), ',' ORDER BY s, kind) FILTER (kind < {strong}), '')) AS base_sha256,
               coalesce(string_agg(concat_ws(':', name, s, e), ',' ORDER BY s, kind) FILTER (name IS NOT NULL), '') AS spans
        FROM t LEFT JOIN kept USING (r) GROUP BY r, doc_id
    """


def _tree_sql(levels: str, source: str) -> str:
    """(grp, level, i, n, d): all nodes above the leaves of ``source``, level by level."""
    return f"""
        {levels} AS (
            SELECT grp, 0 AS level, row_number() OVER (PARTITION BY grp ORDER BY place) - 1 AS i, count(*) OVER (PARTITION BY grp) AS n, d FROM {source}
            UNION ALL
            SELECT grp, level + 1, i // 2, (n + 1) // 2, sha256(string_agg(d, '' ORDER BY i)) FROM {levels} WHERE n > 1 GROUP BY grp, level, i // 2, n)"""


def _manifest_sql() -> str:
    """Trees level by level, siblings by their numbers, CRC-32 bit by bit."""

    def leaf(**changed: str) -> str:
        texts = [changed.get(c, f"{c}::VARCHAR") for c in LEAF]
        return "sha256(" + " || ".join(f"coalesce(strlen({t}) || ':' || {t}, '-')" for t in texts) + ")"

    crc = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), list_transform(range(8), lambda x: 0::BIGINT)), lambda y, z: xor(y >> 1, (y & 1) * 3988292384))), 4294967295)"
    return f"""
        WITH RECURSIVE
        docs AS (SELECT *, coalesce('=' || lang, '') AS grp, {leaf()} AS d, {leaf(n_chars="(n_chars::HUGEINT + 1)::VARCHAR")} AS forged,
                        coalesce({crc} % 7 = 0, false) AS tampered FROM documents),
        leaves AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, d) AS place FROM docs),
        {_tree_sql("nodes", "leaves")},
        subroots AS (SELECT '' AS grp, grp AS place, d FROM nodes WHERE n = 1),
        {_tree_sql("tops", "subroots")},
        places AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY place) - 1 AS i FROM leaves),
        groups AS (SELECT place AS grp, d AS subroot, row_number() OVER (ORDER BY place) - 1 AS i FROM subroots),
        steps AS (
            SELECT p.place, up AS step, (p.i >> up) % 2 = 1 AS is_right, s.d
            FROM places p JOIN (SELECT DISTINCT grp, level AS up FROM nodes WHERE n > 1) USING (grp)
            LEFT JOIN nodes s ON s.grp = p.grp AND s.level = up AND s.i = xor(p.i >> up, 1)
            UNION ALL
            SELECT p.place, 1000 + up, (g.i >> up) % 2 = 1, s.d
            FROM places p JOIN groups g USING (grp) CROSS JOIN (SELECT DISTINCT level AS up FROM tops WHERE n > 1)
            LEFT JOIN tops s ON s.level = up AND s.i = xor(g.i >> up, 1)),
        paths AS (
            SELECT place, string_agg(d, '' ORDER BY step) AS said,
                   list({{'l': if(is_right, d, ''), 'r': if(is_right, '', coalesce(d, '')), 'd': ''}} ORDER BY step) AS path
            FROM steps GROUP BY place),
        folded AS (
            SELECT place, list_reduce(list_prepend({{'l': '', 'r': '', 'd': if(tampered, forged, p.d)}}, coalesce(path, [])),
                                      lambda a, x: {{'l': '', 'r': '', 'd': sha256(x.l || a.d || x.r)}}).d AS folded_root,
                   sha256(coalesce(said, '')) AS proof_sha256
            FROM places p LEFT JOIN paths USING (place))
        SELECT doc_id, places.d AS leaf, subroot, tops.d AS root, proof_sha256, folded_root, folded_root = tops.d AS verified
        FROM places JOIN groups USING (grp) JOIN folded USING (place) JOIN tops ON n = 1
    """


def _fingerprints_sql() -> str:
    """Sums of numbers and bits cut from SHA-256 digests of paragraphs and sentences."""
    def number(first: str, count: int) -> str:
        return f"('0x' || substr(h, {first}, {count}))::BIGINT"

    return f"""
        WITH said AS (SELECT doc_id, coalesce(text, '') AS x, row_number() OVER () AS r FROM documents),
        nexts AS (SELECT *, coalesce(lead(x) OVER w, first(x) OVER w) AS y, coalesce(lead(r) OVER w, first(r) OVER w) AS follows
                  FROM said WINDOW w AS (ORDER BY doc_id DESC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
        edits AS (SELECT *, substr(x, 1, length(x) - length(x) // 3) || substr(y, 1, length(x) // 3) AS z FROM nexts),
        texts AS (SELECT r, false AS edited, x FROM edits UNION ALL SELECT r, true, z FROM edits),
        cut AS (
            SELECT r, edited,
                   list_transform(list_filter(regexp_split_to_array(x, '[\n\r]'), lambda p: p <> ''), lambda p: sha256(p)) AS ps,
                   list_transform(list_filter(list_transform(regexp_split_to_array(x, '[\n\r.!?]'), lambda s: trim(s, ' \t')), lambda s: s <> ''), lambda s: sha256(s)) AS ss
            FROM texts),
        prints AS (
            SELECT r, edited,
                   list_transform(range({fingerprints.WIDE}), lambda i: coalesce(list_sum(list_transform(ps, lambda h: {number("1 + 8 * i", 8)})), 0)::BIGINT % 4294967296) AS wide,
                   list_transform(range({fingerprints.SIGNS}), lambda i: (2 * coalesce(list_sum(list_transform(ss, lambda h:
                       ({number(f"1 + {fingerprints.BITS // 4} * (i // {fingerprints.BITS})", fingerprints.BITS // 4)} >> (i % {fingerprints.BITS} // 4 + {fingerprints.FIELD} * (i % 4))) & 1)), 0)::BIGINT
                       - len(ss) + 32768 & 65535) - 32768) AS signs
            FROM cut),
        shown AS (
            SELECT *, array_to_string(list_concat(list_transform(wide, lambda v: printf('%08x', v)), list_transform(signs, lambda v: printf('%04x', v & 65535))), '') AS p,
                   list_sum(list_transform(signs, lambda v: v * v)) AS own FROM prints)
        SELECT doc_id, length(x)::BIGINT AS n_chars, sha256(z) AS edited_sha256, a.p AS fingerprint, b.p AS edited_fingerprint,
               {_likeness_sql("a", "b")} AS near_edited, {_likeness_sql("a", "c")} AS near_next
        FROM edits JOIN shown a ON a.r = edits.r AND NOT a.edited JOIN shown b ON b.r = edits.r AND b.edited JOIN shown c ON c.r = follows AND NOT c.edited
    """


def _likeness_sql(a: str, b: str) -> str:
    product = f"list_sum(list_transform(list_zip({a}.signs, {b}.signs), lambda v: v[1] * v[2]))"
    return f"CASE WHEN {a}.p = {b}.p THEN 1.0::DOUBLE WHEN {a}.own + {b}.own = 0 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, (2 * {product})::DOUBLE / ({a}.own + {b}.own)::DOUBLE) END"


def _collocations_sql() -> str:
    """All phrases of one to four words counted, every cut scored."""
    return f"""
        WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\n-\r]')), '[^ \t]+') AS w FROM documents),
        sizes AS (SELECT unnest([1, 2, 3, 4]) AS size),
        places AS (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM pieces, sizes),
        counts AS (SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase, count(*) AS f FROM places GROUP BY ALL),
        totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE size = 1 GROUP BY 1),
        candidates AS (SELECT *, string_split(phrase, ' ') AS w FROM counts WHERE size > 1 AND f >= 30),
        cuts AS (SELECT *, unnest(range(1, size)) AS k FROM candidates),
        scored AS (
            SELECT c.lang, c.phrase, c.size, c.f AS a, k, x.f AS l, y.f AS r, (2000000::HUGEINT * c.f // (x.f + y.f))::BIGINT AS score
            FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:k], ' ')
            JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(w[k + 1:], ' ')),
        least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        kept AS (SELECT * FROM least c WHERE NOT EXISTS (
            SELECT 1 FROM candidates d WHERE d.lang = c.lang AND d.size > c.size AND 100 * d.f >= 80 * c.a
                AND contains(' ' || d.phrase || ' ', ' ' || c.phrase || ' '))),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
    """


ORACLES = {
    "op11_manifest": _manifest_sql(),
    "op12_fingerprints": _fingerprints_sql(),
    "op13_collocations": _collocations_sql(),
    "op5_licenses": _licenses_sql(),
    "op10_secrets": _spans_sql(),
    # The turns one by one; a state is the slots so far and where each shard looks next.
    "op1_sharding": f"""
        WITH RECURSIVE
        names AS (SELECT i, 'shard-' || lpad(i::VARCHAR, 2, '0') AS shard FROM range({len(SHARDS)}) r(i)),
        size AS (SELECT {sharding.table_size(len(SHARDS))} AS m),
        orders AS (
            SELECT i, ('0x' || substr(md5('start:' || shard), 1, 15))::BIGINT % m AS first,
                   ('0x' || substr(md5('stride:' || shard), 1, 15))::BIGINT % (m - 1) + 1 AS step
            FROM names, size),
        lists AS (SELECT list(first ORDER BY i) AS firsts, list(step ORDER BY i) AS steps FROM orders),
        turns AS (
            SELECT 0 AS turn, list_transform(range(m), lambda x: -1) AS slots,
                   list_transform(range({len(SHARDS)}), lambda x: 0) AS looked FROM size
            UNION ALL
            SELECT turn + 1,
                   list_transform(slots, lambda v, n: if(n - 1 = slot, shard, v)),
                   list_transform(looked, lambda v, n: if(n - 1 = shard, place, v))
            FROM (SELECT *, (firsts[shard + 1] + place * steps[shard + 1]) % m AS slot
                  FROM (SELECT *, list_filter(range(looked[shard + 1], m),
                                lambda j: slots[(firsts[shard + 1] + j * steps[shard + 1]) % m + 1] < 0)[1] AS place
                        FROM (SELECT *, turn % {len(SHARDS)} AS shard FROM turns, lists, size WHERE turn < m)))),
        filled AS (SELECT unnest(slots) AS i, unnest(range(m)) AS slot FROM turns, size WHERE turn = m)
        SELECT doc_id, slot, shard FROM (
            SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % m AS slot FROM documents, size)
        JOIN filled USING (slot) JOIN names USING (i)
    """,
    "op8_near_duplicates": f"""
        WITH RECURSIVE
        words AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOWER}, '[ \\t-\\r]+'), lambda w: w <> '') AS w FROM documents),
        sets AS (SELECT doc_id, CASE WHEN len(w) < 2 THEN w
                   ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM words),
        nodes AS (SELECT min(doc_id) AS node, md5(list_sort(s)::VARCHAR) AS h, any_value(s) AS s, len(any_value(s)) AS n
                  FROM sets WHERE len(s) > 0 GROUP BY 2),
        flat AS (SELECT node, n, unnest(s) AS sh FROM nodes),
        links AS (SELECT a.node AS x, b.node AS y FROM flat a JOIN flat b
                    ON a.sh = b.sh AND a.node < b.node AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)
                  GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
        both_ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
        reach AS (SELECT node AS x, node AS y FROM nodes UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x),
        tops AS (SELECT x AS node, min(y) AS top FROM reach GROUP BY 1)
        SELECT doc_id, len(sets.s)::BIGINT AS n_shingles, coalesce(top, doc_id) AS component_id,
               doc_id = coalesce(top, doc_id) AS kept
        FROM sets LEFT JOIN nodes ON len(sets.s) > 0 AND md5(list_sort(sets.s)::VARCHAR) = h LEFT JOIN tops USING (node)
    """,
    "op3_url_filters": """
        WITH cut AS (
            SELECT page_id,
                   translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
            FROM pages),
        rules(r_host, r_path, r_verdict) AS (VALUES
            ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
            ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
        numbered AS (SELECT row_number() OVER () AS n, * FROM cut),
        best AS (
            SELECT n, max_by(r_host || r_path, length(r_host || r_path)) AS rule,
                   max_by(r_verdict, length(r_host || r_path)) AS verdict
            FROM numbered JOIN rules
              ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
            GROUP BY n)
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
        FROM numbered LEFT JOIN best USING (n)
    """,
}
