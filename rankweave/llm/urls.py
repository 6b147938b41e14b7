"""URL filter lists: expressions of host suffix and path prefix, met by digest.

Every URL is expanded into the expressions that a rule for it could have: each suffix
of its host, followed by each prefix of its path whose length some rule has. An
expression meets the rules by equality of a short digest prefix; the full digest then
confirms, and of the rules that fit the longest decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.session import at_most

# A rule list up to this many rows is broadcast (about 100 bytes a row).
BROADCAST_RULES = 100_000
# Hex digits of the short digest prefix (four bytes).
PREFIX_DIGITS = 8
# Copies of each rule when the list is too large to broadcast, to spread hot hosts.
RULE_SALTS = 16


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower."""
    return F.translate(
        F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")),
        "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
        "abcdefghijklmnopqrstuvwxyz",
    )


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(expression: Column) -> Column:
    return F.sha2(expression, 256)


def expressions(host: Column, path: Column, labels: int, lengths: list[int]) -> Column:
    """All (host suffix, path prefix) texts that a rule of these sizes could have.

    ``labels`` is the most labels that a rule's host has, ``lengths`` are the lengths
    that rule paths have; longer suffixes and other prefixes can meet no rule.
    """
    parts = F.split(host, r"\.", -1)
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels))),
        lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."),
    )
    cuts = F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length(path))
    prefixes = F.transform(cuts, lambda n: F.substring(path, F.lit(1), n))
    return F.flatten(
        F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p)))
    )


def judge(
    pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow"
) -> DataFrame:
    """(key, host, path, rule, verdict) for each row of ``pages``.

    ``rules`` has host, path (from its ``/``) and verdict. A rule fits its host and
    every subdomain if the URL's path starts with the rule's; the longest rule text
    wins, then the one with the longer host. Of equal rules ``block`` wins. Where no
    rule fits, ``rule`` is null and the verdict is ``default``. Null URLs and those
    without ``://`` have an empty host and path, which no rule fits; rules with a null
    part are void. Repeated rows and null keys are kept, other columns not carried.

    Distinct (host, path) pairs are judged once. What is sent to the driver is one
    row of sizes, whose array is bounded by the length of the longest rule path.
    """
    rules = (
        rules.where(F.col("host").isNotNull() & F.col("path").isNotNull() & F.col("verdict").isNotNull())
        .groupBy(F.lower("host").alias("r_host"), F.col("path").alias("r_path"))
        .agg(F.max_by("verdict", F.col("verdict") == "block").alias("r_verdict"))
        .withColumn("r_text", F.concat("r_host", "r_path"))
        .withColumn("r_digest", _digest(F.col("r_text")))
        .withColumn("r_prefix", F.substring("r_digest", 1, PREFIX_DIGITS))
    )
    sizes = rules.agg(
        F.coalesce(F.max(F.size(F.split("r_host", r"\.", -1))), F.lit(1)).alias("labels"),
        F.sort_array(F.collect_set(F.length("r_path"))).alias("lengths"),
    ).first()
    read = pages.select(
        F.col(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")
    )
    if not sizes["lengths"]:
        return read.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    asked = (
        read.select("host", "path")
        .distinct()
        .withColumn(
            "r_text",
            F.explode(expressions(F.col("host"), F.col("path"), sizes["labels"], sizes["lengths"])),
        )
        .withColumn("digest", _digest(F.col("r_text")))
        .withColumn("r_prefix", F.substring("digest", 1, PREFIX_DIGITS))
        .drop("r_text")
    )
    on = ["r_prefix"]
    if at_most(rules, BROADCAST_RULES):
        rules = F.broadcast(rules)
    else:
        # A popular host makes one expression frequent: its rule gets several copies.
        salts = F.array(*[F.lit(i) for i in range(RULE_SALTS)])
        rules = rules.withColumn("salt", F.explode(salts))
        asked = asked.withColumn("salt", F.pmod(F.xxhash64("path", "host"), F.lit(RULE_SALTS)).cast("int"))
        on.append("salt")
    best = (
        asked.join(rules, on)
        .where(F.col("digest") == F.col("r_digest"))
        .groupBy("host", "path")
        .agg(
            F.max(
                F.struct(
                    F.length("r_text").alias("n"),
                    F.length("r_host").alias("n_host"),
                    F.col("r_text").alias("rule"),
                    F.col("r_verdict").alias("verdict"),
                )
            ).alias("best")
        )
    )
    return read.join(best, ["host", "path"], "left").select(
        key,
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
