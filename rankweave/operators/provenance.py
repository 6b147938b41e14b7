"""Row provenance: relations whose rows know which source rows they come from.

An annotated relation is an ordinary DataFrame with two more columns: ``mono``, a
sorted array of source tokens that together give the row, and ``coef``, how often
they do. A row with several derivations has several such lines. So "or" is a union
of lines, "and" joins the arrays of two lines, and a row with a million derivations
is a million lines, never one array in one task.

``formula``, ``why``, ``counting``, ``probability``, ``shapley`` and ``banzhaf`` read
the lines of each row back.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.operators.components import components
from rankweave.operators.lineage_worlds import chance, worth
from rankweave.session import at_most, broadcast_if_small, null_safe_join, running_total, stored

# Lines of a row that are worked out together without looking for independent parts first.
PACKED = 10_000
# Tokens of a row that are numbered by their places; more have digests for numbers.
PLACED = 64
# Rows of a lineage, some 130 bytes each, that a join broadcasts.
LINEAGE_ROWS = 500_000

LINEAGE = ("mono", "coef")


def data_columns(relation: DataFrame) -> list[str]:
    return [c for c in relation.columns if c not in LINEAGE]


def token(table: str, *key: str) -> Column:
    """A stable token for a source row, by its table and key."""
    return F.substring(
        F.sha2(F.concat_ws("\x1f", F.lit(table), *[F.col(k).cast("string") for k in key]), 256), 1, 32
    )


def add_provenance(df: DataFrame, table: str, key: list[str]) -> DataFrame:
    """Annotate a source table: every row is its own single derivation."""
    return df.withColumn("mono", F.array(token(table, *key))).withColumn("coef", F.lit(1).cast("long"))


def provenance_mapping(relation: DataFrame, col: str) -> DataFrame:
    """(token, value) of an annotated source table."""
    return relation.select(F.col("mono")[0].alias("token"), F.col(col).alias("value"))


def _combine(lines: DataFrame, columns: list[str]) -> DataFrame:
    return lines.groupBy(*columns, "mono").agg(F.sum("coef").alias("coef"))


def project(relation: DataFrame, *columns: str) -> DataFrame:
    """DISTINCT over some columns: equal rows share their derivations."""
    return _combine(relation, list(columns))


def union_all(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both sides; equal rows keep the derivations of both."""
    return _combine(a.unionByName(b), data_columns(a))


def select_rows(relation: DataFrame, condition: Column | str) -> DataFrame:
    """Filter; derivations stay as they are."""
    return relation.where(condition)


def join(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Equi-join: a joined row needs a derivation of both sides.

    Where ``b`` is counted to be small, ``a`` stays where it is, with its tokens.
    """
    right = b.withColumnRenamed("mono", "__mono").withColumnRenamed("coef", "__coef")
    both = a.join(broadcast_if_small(right, LINEAGE_ROWS), on)
    keep = [c for c in both.columns if c not in (*LINEAGE, "__mono", "__coef")]
    return both.select(
        *keep,
        F.array_sort(F.concat("mono", "__mono")).alias("mono"),
        (F.col("coef") * F.col("__coef")).alias("coef"),
    )


def group(relation: DataFrame, by: list[str], aggs: list[Column]) -> tuple[DataFrame, DataFrame]:
    """(values, annotated): the aggregates per group, and the groups with their lineage.

    Aggregates are over source rows; a row of several lines must not be counted
    twice, so ``relation`` has to be a source table, a filter or a join of keys.
    """
    return relation.groupBy(*by).agg(*aggs), project(relation, *by)


def _mapped(relation: DataFrame, mapping: DataFrame) -> DataFrame:
    """Lines with ``values``: the mapped value of each token, in token order."""
    columns = data_columns(relation)
    tokens = relation.select(*columns, "mono", "coef", F.posexplode("mono").alias("__at", "token"))
    return (
        tokens.join(mapping, "token", "left")
        .groupBy(*columns, "mono", "coef")
        .agg(F.array_sort(F.collect_list(F.struct("__at", "value"))).alias("__v"))
        .select(*columns, "mono", "coef", F.transform("__v", lambda e: e["value"]).alias("values"))
    )


def sr_formula(relation: DataFrame, mapping: DataFrame) -> DataFrame:
    """(*columns, place, term): the formula of each row, a line for each of its terms.

    Tokens in a term are joined with ⊗; the terms of a row, in their order from place 1,
    are joined with ⊕ by whoever writes them out. A row may have any number of terms, and
    the places are exact, without any task holding a row's whole formula.
    """
    columns = data_columns(relation)
    one = F.array_join(F.array_sort(F.transform("values", lambda v: v.cast("string"))), " ⊗ ")
    several = F.when(F.col("coef") > 1, F.concat(F.col("coef").cast("string"), F.lit("·"), one)).otherwise(one)
    terms = _mapped(relation, mapping).select(*columns, several.alias("term"), "mono", F.lit(1).alias("__one"))
    placed = running_total(terms, columns, ["term", "mono"], "__one", "place")
    return placed.select(*columns, F.col("place").cast("long").alias("place"), "term")


def sr_counting(relation: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """(*columns, count): number of derivations, weighted by the mapped values."""
    columns = data_columns(relation)
    if mapping is None:
        return relation.groupBy(*columns).agg(F.sum("coef").alias("count"))
    product = F.aggregate("values", F.lit(1).cast("long"), lambda acc, v: acc * F.coalesce(v.cast("long"), F.lit(1).cast("long")))
    return (
        _mapped(relation, mapping)
        .groupBy(*columns)
        .agg(F.sum(F.col("coef") * product).alias("count"))
    )


def why(relation: DataFrame) -> DataFrame:
    """(*columns, witness): each set of source rows that is enough for the row."""
    return relation.select(*data_columns(relation), F.array_distinct("mono").alias("witness")).distinct()


def how(relation: DataFrame) -> DataFrame:
    """(*columns, mono, coef): the polynomial of each row, a line per term."""
    return _combine(relation, data_columns(relation)).select(*data_columns(relation), "mono", "coef")


def where(relation: DataFrame, sources: str | dict[str, tuple[str, DataFrame]]) -> DataFrame:
    """(*columns, out_column, table, column, token): the cells each output field is copied from.

    For a relation of one table ``sources`` is its name. For a join it gives for each
    output column the table that it comes from, and that table annotated, or any mapping of
    it with a ``token`` column: of a row's tokens those of that table hold the cell.
    """
    columns = data_columns(relation)
    if isinstance(sources, str):
        alone = F.when(F.size("mono") == 1, F.col("mono")[0]).otherwise(
            F.raise_error(F.lit("a row of several source rows needs the table of each column"))
        )
        cells = relation.select(*columns, F.explode(F.array(*map(F.lit, columns))).alias("out_column"), alone.alias("token"))
        return cells.select(
            *columns, "out_column", F.lit(sources).alias("table"), F.col("out_column").alias("column"), "token"
        ).distinct()
    unknown = set(columns) - set(sources)
    if unknown:
        raise ValueError(f"no table given for {sorted(unknown)}")
    tokens = relation.select(*columns, F.explode("mono").alias("token"))
    out = None
    for table, own in {t: m for t, m in sources.values()}.items():
        known = own.select("token") if "token" in own.columns else own.select(F.explode("mono").alias("token"))
        mine = [F.lit(c) for c in columns if sources[c][0] == table]
        part = tokens.join(known.distinct(), "token", "left_semi").select(
            *columns, F.explode(F.array(*mine)).alias("out_column"), F.lit(table).alias("table"), "token"
        )
        out = part if out is None else out.unionByName(part)
    return out.select(*columns, "out_column", "table", F.col("out_column").alias("column"), "token").distinct()


# -- probability and shares ----------------------------------------------------


def _lines(relation: DataFrame) -> DataFrame:
    """Lines as sets: repeated tokens and counts make no difference to truth."""
    return why(relation).withColumnRenamed("witness", "mono")


def _independent(relation: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows split into those whose derivations are one token each, and the others."""
    columns = data_columns(relation)
    lines = _lines(relation)
    widest = lines.groupBy(*columns).agg(F.max(F.size("mono")).alias("__w"))
    marked = null_safe_join(lines, widest, columns)
    return marked.where("__w <= 1").drop("__w"), marked.where("__w > 1").drop("__w")


def _packed(lines: DataFrame, probs: DataFrame | None) -> DataFrame:
    """One line per row, or part of one, with its tokens, their probabilities and its terms.

    A part whose derivations share tokens is worked out in one task, so its terms come
    together there.
    """
    columns = data_columns(lines)
    if probs is None:
        held = lines.groupBy(*columns).agg(F.collect_set("mono").alias("terms"))
        names = F.array_sort(F.array_distinct(F.flatten("terms")))
        return held.select(*columns, F.transform(names, lambda t: F.struct(t.alias("token"), F.lit(0.5).alias("p"))).alias("tokens"), "terms")
    tokens = lines.select(*columns, F.explode("mono").alias("token")).distinct().join(probs, "token", "left")
    listed = tokens.groupBy(*columns).agg(F.array_sort(F.collect_list(F.struct("token", "p"))).alias("tokens"))
    terms = lines.groupBy(*columns).agg(F.collect_set("mono").alias("terms"))
    return null_safe_join(listed, terms, columns)


def _parted(lines: DataFrame) -> DataFrame:
    """Lines of large rows with ``__part``: the token-disjoint part of its row that a line is in.

    Such a row is split into the connected parts of its tokens by Spark, so a row of any
    number of lines, few of them wide, is not one task's work. A
    line that shares its one token with no wide line has the part NULL.
    """
    columns = data_columns(lines)
    row = F.sha2(F.to_json(F.struct(F.lit(0), *columns), {"ignoreNullFields": "false"}), 256)
    named = lines.withColumn("__node", F.concat(row, F.col("mono")[0]))
    wide = named.where("size(mono) > 1").select("__node", F.explode(F.slice("mono", 2, 2**30)).alias("t"), "mono")
    other = F.concat(F.substring("__node", 1, 64), "t")
    parts = components(wide.select(F.col("__node").alias("a"), other.alias("b")), "a", "b")
    found = named.join(parts.select(F.col("node").alias("__node"), F.col("root").alias("__part")), "__node", "left")
    return found.select(*lines.columns, "__part")


def _digest(token: Column) -> Column:
    return F.unhex(F.md5(token.cast("binary")))


def _large(lines: DataFrame) -> DataFrame:
    """The rows of more than ``PACKED`` lines: fewer than lines by that factor."""
    columns = data_columns(lines)
    counted = lines.groupBy(*columns).agg(F.count("*").alias("__n")).where(F.col("__n") > PACKED)
    return F.broadcast(counted.select(*[F.col(c).alias(f"__r_{c}") for c in columns]))


def _is_row(columns: list[str]) -> Column:
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"__r_{c}"))
    return same


# How a row is worked out: split first, by its closed form, by elimination.
LARGE, CLOSED, OPEN = 0, 1, 2


def _forms(lines: DataFrame) -> DataFrame:
    """(*columns, tokens, placed, terms, alone, common, rest) of rows of a bounded number of lines.

    Where terms share no token but those that all of them hold, ``common``, the row has a
    closed form, ``rest`` being what else each of them holds.
    """
    columns = data_columns(lines)
    held = lines.groupBy(*columns).agg(F.collect_set("mono").alias("terms"))
    held = held.withColumn("tokens", F.array_distinct(F.flatten("terms")))
    digests = F.transform("tokens", lambda t: F.xxhash64(t))
    # Digests of a row's tokens that meet are no numbers.
    held = held.withColumn("placed", (F.size("tokens") <= PLACED) | (F.size(F.array_distinct(digests)) < F.size("tokens")))
    number = lambda t: F.when(F.col("placed"), F.array_position(F.col("tokens"), t)).otherwise(F.xxhash64(t))
    held = held.withColumn("terms", F.transform("terms", lambda m: F.transform(m, number)))
    held = held.withColumn("alone", F.coalesce(F.array_max(F.transform("terms", F.size)), F.lit(0)) <= 1)
    shared = F.aggregate(F.slice("terms", 2, 2**30), F.element_at("terms", 1), lambda s, t: F.array_intersect(s, t))
    held = held.withColumn("common", F.when(F.col("placed") & ~F.col("alone"), shared))
    held = held.withColumn("rest", F.transform("terms", lambda t: F.array_except(t, F.col("common"))))
    several = F.aggregate("rest", F.lit(0), lambda s, t: s + F.size(t))
    apart = F.coalesce(F.size(F.array_distinct(F.flatten("rest"))) == several, F.lit(False))
    return held.withColumn("common", F.when(apart, F.col("common"))).withColumn("rest", F.when(apart, F.col("rest")))


def _weighed(lines: DataFrame, probs: DataFrame) -> DataFrame:
    """(*columns, kind, sure, log, terms, chances) of rows of a bounded number of lines.

    A row's terms stay where its lines meet. Only numbers of tokens, with the digests by which
    they look their probabilities up, are dealt to these, and come back to the terms as
    numbers with probabilities.
    """
    columns = data_columns(lines)
    held = _forms(lines)
    number = lambda t, i: F.when(F.col("placed"), (i + 1).cast("long")).otherwise(F.xxhash64(t))
    asked = held.select(*columns, F.inline(F.transform("tokens", lambda t, i: F.struct(number(t, i).alias("n"), _digest(t).alias("key")))))
    known = probs.select(_digest(F.col("token")).alias("key"), F.col("p").cast("double").alias("p"))
    # What a row is, from its terms; NULL beside its tokens.
    is_open = ~F.col("alone") & F.col("common").isNull()
    form = F.struct("alone", "common", "rest", F.when(is_open, F.col("terms")).alias("terms")).alias("form")
    terms = held.select(*columns, form, F.lit(None).cast("long").alias("n"), F.lit(None).cast("double").alias("p"))
    # Spark would take packed files for small tables.
    known = F.broadcast(known) if at_most(known, LINEAGE_ROWS) else known.hint("merge")
    found = asked.join(known, "key", "left").select(*columns, F.lit(None).cast(terms.schema["form"].dataType).alias("form"), "n", "p")
    both = terms.unionByName(found)
    # Lists begun before this would only be longer rows: a row's tokens come from many tasks.
    dealt = both.repartition(*columns) if columns else both
    met = dealt.groupBy(*columns).agg(
        F.first("form", ignorenulls=True).alias("form"),
        F.array_sort(F.collect_list(F.when(F.col("n").isNotNull(), F.struct("n", "p")))).alias("chances"),
    )
    met = met.withColumn("ps", F.transform("chances", lambda e: e["p"]))
    # Numbers of closed forms are places from 1, each once if each token has one probability.
    once = F.size("chances") == F.coalesce(F.element_at("chances", -1)["n"], F.lit(0))
    most = lambda n: F.array_max(F.transform(F.filter("chances", lambda e: e["n"] == n), lambda e: e["p"]))
    places = F.sequence(F.lit(1).cast("long"), F.element_at("chances", -1)["n"])
    met = met.withColumn("own", F.when(F.col("form.common").isNotNull(), F.when(once, F.col("ps")).otherwise(F.transform(places, most))))
    product = lambda names: F.aggregate(names, F.lit(1.0), lambda s, n: s * F.element_at(F.col("own"), n.cast("int")))
    absent = F.aggregate("form.rest", F.lit(1.0), lambda s, t: s * (1.0 - product(t)))
    chance_of = F.coalesce(product("form.common") * (1.0 - absent), F.raise_error(F.lit("a token has no probability")).cast("double"))
    met = met.withColumn("chance", F.when(F.col("form.common").isNotNull(), chance_of))
    kind = F.when(F.col("form.alone") | F.col("form.common").isNotNull(), CLOSED).otherwise(OPEN)
    logs = F.aggregate("ps", F.lit(0.0), lambda s, x: s + F.when(x < 1, F.log1p(-x)).otherwise(0.0))
    return met.select(
        *columns,
        kind.alias("kind"),
        F.when(F.col("form.alone"), F.coalesce(F.exists("ps", lambda x: x >= 1), F.lit(False))).otherwise(F.col("chance") >= 1).alias("sure"),
        F.when(F.col("form.alone"), logs).otherwise(F.when(F.col("chance") < 1, F.log1p(-F.col("chance"))).otherwise(0.0)).alias("log"),
        F.col("form.terms").alias("terms"),
        F.when(kind == OPEN, F.col("chances")).alias("chances"),
    )


def _alone(lines: DataFrame, probs: DataFrame) -> DataFrame:
    """(*columns, chance) of lines of one token."""
    columns = data_columns(lines)
    found = lines.select(*columns, F.col("mono")[0].alias("token")).join(probs, "token", "left")
    return found.select(*columns, F.col("p").alias("chance"))


def _present(columns: list[str], parts: DataFrame) -> DataFrame:
    """(*columns, probability) of independent parts of rows, each with its ``chance``."""
    absent = parts.groupBy(*columns).agg(
        F.max(F.when(F.col("chance") >= 1, 1).otherwise(0)).alias("__sure"),
        F.sum(F.when(F.col("chance") < 1, F.log1p(-F.col("chance"))).otherwise(0.0)).alias("__log"),
    )
    return absent.select(*columns, F.when(F.col("__sure") == 1, 1.0).otherwise(1.0 - F.exp("__log")).alias("probability"))


def probability(relation: DataFrame, probs: DataFrame, samples: int | None = None, seed: int = 42) -> DataFrame:
    """(*columns, probability) with independent source rows of (token, p).

    Derivations of one token each have a closed form, for any number of them, and so have
    derivations that share no token but those that all of the row's hold. Other
    rows are worked out exactly: parts that share no token apart, each by elimination, whose
    work grows with how entangled the derivations are, not with their number. Where that
    is too much the error says so, and a caller may ask for ``samples`` seeded worlds.
    """
    columns = data_columns(relation)
    if samples is not None:
        single, several = _independent(relation)
        out = _present(columns, _alone(single, probs)).unionByName(_sampled(several, probs, samples, seed))
        return out.withColumn("probability", F.round("probability", 6))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in relation.schema if f.name in columns)

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [chance(tokens, terms) for tokens, terms in zip(batch["tokens"], batch["terms"])]
            yield batch[columns].assign(chance=out)

    lines = relation.select(*columns, F.array_distinct("mono").alias("mono"))
    large = _large(lines)
    few = _weighed(lines.join(large, _is_row(columns), "left_anti"), probs)
    marks = large.select(*[F.col(f"__r_{c}").alias(c) for c in columns], F.lit(LARGE).alias("kind"))
    # Kept, so that what the relation is made of is read and dealt once.
    rows = stored(few.unionByName(marks, allowMissingColumns=True), "rows")
    kinds = {r["kind"] for r in rows.select("kind").distinct().collect()}
    out = rows.where(F.col("kind") == CLOSED).select(*columns, F.when(F.col("sure"), 1.0).otherwise(1.0 - F.exp("log")).alias("probability"))
    if OPEN in kinds:
        numbered = F.transform("chances", lambda e: F.struct(e["n"].alias("token"), e["p"].alias("p")))
        ways = rows.where(F.col("kind") == OPEN).select(*columns, numbered.alias("tokens"), "terms")
        out = out.unionByName(_present(columns, ways.mapInPandas(weigh, schema + ", chance double")))
    if LARGE in kinds:
        named = rows.where(F.col("kind") == LARGE).select(*[F.col(c).alias(f"__r_{c}") for c in columns])
        single, several = _independent(relation.join(F.broadcast(named), _is_row(columns), "left_semi"))
        parted = _parted(several)
        packed = _packed(parted.where("__part IS NOT NULL"), probs)
        missing = _alone(single, probs).unionByName(_alone(parted.where("__part IS NULL").drop("__part"), probs))
        out = out.unionByName(_present(columns, missing.unionByName(packed.mapInPandas(weigh, schema + ", chance double"))))
    return out.withColumn("probability", F.round("probability", 6))


def expected(relation: DataFrame, probs: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(*keys, expected_count, expected_sum) of the rows of each group.

    The sum over an uncertain relation is the sum of its values, each annotated with its
    row's lineage; expectation is linear, so rows may share tokens. NULL values add nothing
    to the sum. Groups without a row do not appear.
    """
    rows = probability(relation, probs)
    held = rows.groupBy(*keys).agg(
        F.sum("probability").alias("expected_count"), F.sum(F.col("probability") * F.coalesce(F.col(value).cast("double"), F.lit(0.0))).alias("expected_sum")
    )
    return held.select(*keys, F.round("expected_count", 6).alias("expected_count"), F.round("expected_sum", 2).alias("expected_sum"))


def _sampled(lines: DataFrame, probs: DataFrame, samples: int, seed: int) -> DataFrame:
    """Share of seeded worlds in which a row has a whole term."""
    columns = data_columns(lines)
    terms = lines.withColumn("__term", F.xxhash64("mono"))
    # A token's state in a world is a hash, so it is the same wherever it is looked up.
    drawn = (
        terms.select(*columns, "__term", F.explode("mono").alias("token"))
        .join(probs, "token", "left")
        .withColumn("world", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(samples - 1).cast("long"))))
        .withColumn("__in", F.pmod(F.xxhash64("token", "world", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30)) < F.col("p"))
    )
    whole = drawn.groupBy(*columns, "world", "__term").agg(F.every("__in").alias("__in"))
    row = whole.groupBy(*columns, "world").agg(F.max(F.col("__in").cast("int")).alias("__in"))
    return row.groupBy(*columns).agg(F.avg("__in").alias("probability"))


def _shares(relation: DataFrame, power_index: str) -> DataFrame:
    columns = data_columns(relation)
    single, several = _independent(relation)
    count = single.groupBy(*columns).agg(F.count("*").alias("__n"))
    even = 1.0 / F.col("__n") if power_index == "shapley" else F.pow(F.lit(2.0), 1.0 - F.col("__n"))
    closed = null_safe_join(single, count, columns).select(
        *columns, F.col("mono")[0].alias("token"), even.alias(power_index)
    )
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in relation.schema if f.name in columns)

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep, names, values = [], [], []
            for at, (tokens, terms) in enumerate(zip(batch["tokens"], batch["terms"])):
                for name, value in worth(tokens, terms, power_index).items():
                    keep.append(at)
                    names.append(name)
                    values.append(value)
            yield batch[columns].iloc[keep].assign(**{"token": names, power_index: values})

    rest = _packed(several, None).mapInPandas(weigh, f"{schema}, token string, {power_index} double")
    return closed.unionByName(rest).withColumn(power_index, F.round(power_index, 6))


def shapley(relation: DataFrame) -> DataFrame:
    """(*columns, token, shapley): each source row's share in the row being there."""
    return _shares(relation, "shapley")


def banzhaf(relation: DataFrame) -> DataFrame:
    """(*columns, token, banzhaf): how often a source row decides, over all worlds."""
    return _shares(relation, "banzhaf")
