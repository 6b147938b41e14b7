"""Secrets in text, with weak candidates linked through the other parts of a credential.

Strong spans (an assigned password or token, an access identifier, a long hexadecimal
run) are reported wherever they stand. Weak candidates are not telling alone: an opaque
40-character key, an account name, an endpoint. Each plays a part (identifier, secret
or endpoint), and is reported only if complementary parts stand within a scope of some
characters. Parts meet in an interval join: positions fall into bins as wide as the
scope, a candidate looks into its own bin and the two beside it, and the nearest
position of each part decides. Per bin only the outermost positions of a part are
kept, so a crowded text does not multiply.

All of it is DataFrame functions. A regular expression's matches give texts but no
positions; those are running sums of the lengths between and of the matches.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankweave.session import stored

# Characters (code points) between complementary parts of one credential.
SCOPE = 200

IDENTIFIER, SECRET, ENDPOINT = "identifier", "secret", "endpoint"


@dataclass(frozen=True)
class Kind:
    """One kind of span: its pattern, the part it plays, and what it must meet.

    ``guard`` is a cheap test that every text with a match passes. A match counts if
    its group ``group`` has ``least`` characters or more; others are dropped after
    matching, so they still use up their text. ``needs`` are the parts that must be
    in scope; none makes the kind strong.
    """

    name: str
    pattern: str
    role: str
    guard: tuple[str, ...]
    group: int = 0
    least: int = 1
    also: str | None = None
    needs: tuple[str, ...] = ()


KEYWORDS = "password|passwd|secret|token|api_?key"
# In the order in which spans that start together are listed. For the access and hex
# kinds the least length may stand in the pattern: a run is maximal, so a match that
# is too short contains no other.
KINDS = (
    Kind(
        "assign",
        rf"""(?i)({KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        SECRET,
        (r"[:=]", rf"(?i){KEYWORDS}"),
        group=2,
        least=6,
    ),
    Kind("access", r"AKIA[A-Z0-9]{16,}", IDENTIFIER, ("AKIA",)),
    Kind("hex", r"[0-9a-f]{24,}", SECRET, (r"[0-9a-f]{24}",)),
    Kind(
        "key",
        r"(?<![A-Za-z0-9/+=])[A-Za-z0-9/+]{40}(?![A-Za-z0-9/+=])",
        SECRET,
        (r"[A-Za-z0-9/+]{40}",),
        also=r"^(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9])",
        needs=(IDENTIFIER,),
    ),
    Kind(
        "account",
        r"""(?i)\b(?:user|login|account|client)(?:_?name|_?id)?["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}""",
        IDENTIFIER,
        (r"[:=]", r"(?i)user|login|account|client"),
        needs=(SECRET,),
    ),
    Kind(
        "endpoint",
        r"""[a-z][a-z0-9+.-]{1,15}://[A-Za-z0-9_.:@/-]+""",
        ENDPOINT,
        ("://", "[a-z]://"),
        needs=(IDENTIFIER, SECRET),
    ),
)
STRONG = tuple(k.name for k in KINDS if not k.needs)


def _matches(text: Column, number: int, kind: Kind) -> Column:
    """(kind, at, gap, size, good) of each match: the lengths before and of it."""
    hits = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    gaps = F.transform(F.split(text, kind.pattern, -1), lambda g: F.length(g))
    good = F.transform(
        F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(kind.group)),
        lambda g: (F.length(g) >= kind.least) & (g.rlike(kind.also) if kind.also else F.lit(True)),
    )
    lengths = F.transform(hits, lambda h: F.length(h))
    rows = F.transform(
        F.arrays_zip(lengths.alias("size"), good.alias("good"), F.slice(gaps, 1, F.size(hits)).alias("gap")),
        lambda m, i: F.struct(
            F.lit(number).alias("kind"),
            i.alias("at"),
            m["gap"].alias("gap"),
            m["size"].alias("size"),
            m["good"].alias("good"),
        ),
    )
    none = F.array().cast("array<struct<kind:int,at:int,gap:int,size:int,good:boolean>>")
    return F.when(_guarded(text, kind), rows).otherwise(none)


def _guarded(text: Column, kind: Kind) -> Column:
    out = F.lit(True)
    for guard in kind.guard:
        plain = guard.isalnum() or guard == "://"
        out = out & (text.contains(guard) if plain else text.rlike(guard))
    return out


def find_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """(key, text_hash, kind, start, end) of every reported span, ends exclusive.

    Positions are code points of the text. Rows with equal key and text give their
    spans once; a null text has none. ``kind`` is the number in ``KINDS``.
    """
    said = F.coalesce(F.col(text), F.lit(""))
    found = F.concat(*[_matches(said, i, k) for i, k in enumerate(KINDS)])
    rows = (
        docs.select(F.col(key).alias("id"), F.xxhash64(said).alias("text_hash"), found.alias("found"))
        .where(F.size("found") > 0)
        .groupBy("id", "text_hash")
        .agg(F.first("found").alias("found"))
        .select("id", "text_hash", F.inline("found"))
    )
    before = Window.partitionBy("id", "text_hash", "kind").orderBy("at")
    spans = rows.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(before)).select(
        "id", "text_hash", "kind", (F.col("end") - F.col("size")).alias("start"), "end", "good"
    )
    # Read twice below, and small: the texts are scanned once.
    spans = stored(spans.where("good").drop("good"), "secret-spans")
    strong = len(STRONG)
    reported = spans.where(F.col("kind") < strong)
    weak = _linked(spans.where(F.col("kind") >= strong), spans, scope)
    return reported.unionByName(weak).withColumnRenamed("id", key)


def _linked(weak: DataFrame, parts: DataFrame, scope: int) -> DataFrame:
    """The weak spans that have all parts they need within the scope."""
    role = F.element_at(F.array(*[F.lit(k.role) for k in KINDS]), F.col("kind") + 1)
    needs = F.element_at(F.array(*[F.array(*map(F.lit, k.needs)) if k.needs else F.array().cast("array<string>") for k in KINDS]), F.col("kind") + 1)

    def binned(df: DataFrame) -> DataFrame:
        """A row for each bin that a span touches, clipped to it."""
        bins = F.sequence(F.floor(F.col("start") / scope), F.floor((F.col("end") - 1) / scope))
        return (
            df.withColumn("bin", F.explode(bins))
            .withColumn("low", F.greatest("start", F.col("bin") * scope))
            .withColumn("high", F.least("end", (F.col("bin") + 1) * scope))
        )

    # A bin's part may be a weak span too: an account and a key vouch for each other.
    edges = (
        binned(parts)
        .groupBy("id", "text_hash", "bin", role.alias("role"))
        .agg(F.min("low").alias("first"), F.max("high").alias("last"))
        .withColumnRenamed("id", "p_id")
        .withColumnRenamed("text_hash", "p_hash")
        .withColumnRenamed("bin", "p_bin")
    )
    asking = binned(weak).withColumn("need", F.explode(needs)).withColumn(
        "near", F.explode(F.sequence(F.col("bin") - 1, F.col("bin") + 1))
    )
    met = asking.join(
        edges,
        F.col("id").eqNullSafe(F.col("p_id"))
        & (F.col("text_hash") == F.col("p_hash"))
        & (F.col("near") == F.col("p_bin"))
        & (F.col("need") == F.col("role"))
        & (F.col("first") - F.col("high") <= scope)
        & (F.col("low") - F.col("last") <= scope),
    )
    span = ["id", "text_hash", "kind", "start", "end"]
    return (
        met.groupBy(*span)
        .agg(F.count_distinct("need").alias("met"))
        .where(F.col("met") == F.size(needs))
        .select(*span)
    )


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row per row of ``docs``: its key, text_hash and ``spans``, sorted by start and kind.

    ``spans`` is an array of (start, end, kind number, kind name, strong). Rows without
    a span, null texts, null keys and repeated rows are all kept; other columns are not
    carried. An empty table gives no row.
    """
    name = F.element_at(F.array(*[F.lit(k.name) for k in KINDS]), F.col("kind") + 1)
    spans = (
        find_spans(docs.select(key, text), key, text, scope)
        .groupBy(F.col(key).alias("s_key"), F.col("text_hash").alias("s_hash"))
        .agg(
            F.sort_array(
                F.collect_list(
                    F.struct("start", F.col("kind"), "end", name.alias("name"), (F.col("kind") < len(STRONG)).alias("strong"))
                )
            ).alias("spans")
        )
    )
    keyed = docs.select(key, F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"))
    return keyed.join(
        spans, F.col(key).eqNullSafe(F.col("s_key")) & (F.col("text_hash") == F.col("s_hash")), "left"
    ).select(key, "text_hash", F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType)).alias("spans"))


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span in ``text`` replaced by ``mark``, all columns and rows kept.

    Overlapping or touching spans become one mark. Texts without a span stay as they
    are, null included.
    """
    said = F.col(text)
    spans = (
        find_spans(docs.select(key, text), key, text)
        .groupBy(F.col(key).alias("__key"), F.col("text_hash").alias("__hash"))
        .agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("__spans"))
    )
    # (code points used, pieces): a span inside what was used only lengthens it.
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<string>").alias("out"))
    cut = F.aggregate(
        "__spans",
        start,
        lambda acc, s: F.struct(
            F.greatest(acc["used"], s["end"]).alias("used"),
            F.when((s["start"] <= acc["used"]) & (F.size(acc["out"]) > 0), acc["out"])
            .otherwise(
                F.concat(
                    acc["out"],
                    F.array(
                        F.substring(said, (acc["used"] + 1).cast("int"), (s["start"] - acc["used"]).cast("int")),
                        F.lit(mark),
                    ),
                )
            )
            .alias("out"),
        ),
        lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(said, (acc["used"] + 1).cast("int"), F.length(said))),
    )
    hashed = F.xxhash64(F.coalesce(said, F.lit("")))
    joined = docs.join(spans, F.col(key).eqNullSafe(F.col("__key")) & (hashed == F.col("__hash")), "left")
    columns = [F.when(F.col("__spans").isNotNull(), cut).otherwise(said).alias(c) if c == text else F.col(c) for c in docs.columns]
    return joined.select(*columns)
