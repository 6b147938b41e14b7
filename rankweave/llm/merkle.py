"""A Merkle tree over a table: one subtree for each group, their roots below one root.

The leaves of a group stand in key order. A node's siblings stand at fixed offsets from it,
so lag and lead columns, masked by the node's slot and the length of its run, supply them,
and the row of each run's first child hashes the parent. Windows cover blocks of
``arity ** LEVELS`` neighbouring rows only: a block yields one node, whose table is the
next, shorter input, so no window grows with a group.

Digests are SHA-256 in lowercase hex; a parent is the digest of its children's hex digits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankweave.session import running_total, stored

# Levels that one set of windows climbs.
LEVELS = 10
# Copies of a group's row count that its leaves are dealt to.
SALTS = 32


def digest(*values: Column) -> Column:
    """The digest of a row's values: ``-`` for NULL, else byte count, colon and value."""
    texts = [v.cast("string") for v in values]
    parts = [F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest and the siblings of its path give."""
    return F.aggregate(path, leaf, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


def proof(path: Column) -> Column:
    """The digest of a path's siblings, from the leaf up, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""), 256)


def manifest(
    rows: DataFrame, key: str = "doc_id", group: str = "lang", columns: Sequence[str] | None = None, arity: int = 2, carry: dict[str, Column] | None = None
) -> DataFrame:
    """(key, leaf, subroot, root, path) of every row, and the ``carry`` columns.

    ``leaf`` is the digest of ``columns`` (all, in order, if None). ``path`` lists, from the
    leaf to the root, the digits of the siblings left and right of each node on the way; a
    node alone in its run has an entry without siblings, and a level of a single node none.

    Keys ascend, NULL first; rows of one key go by their leaf, and equal rows stand side by
    side, each a leaf of its own. Groups go by the UTF-8 bytes of their value, NULL first
    and apart from the empty string. NULL and empty values have different digests. A table
    of one row is its own root; an empty one gives no row. Columns that are neither named
    nor carried are left out, whatever their names.
    """
    if arity < 2:
        raise ValueError("a run needs room for two children")
    value = F.col(group).cast("string")
    carry = carry or {}
    leaves = rows.select(
        F.when(value.isNull(), "").otherwise(F.concat(F.lit("="), value)).alias("__group"),
        F.col(key).alias("__key"),
        digest(*[F.col(c) for c in columns or rows.columns]).alias("__digest"),
        *[c.alias(f"__with_{name}") for name, c in carry.items()],
        # Equal rows are dealt to several ranges by this number.
        F.rand(29).alias("__tie"),
        F.lit(1).alias("__one"),
    )
    placed = running_total(leaves, ["__group"], ["__key", "__digest", "__tie"], "__one", "__pos")
    leaves = stored(_counted(placed.withColumn("__pos", F.col("__pos") - 1).drop("__tie", "__one")), "leaves")
    levels = _climbed(leaves, arity)
    tops = levels[-1].select("__group", F.col("__digest").alias("__subroot"))

    ranked = running_total(tops.select(F.lit("").alias("__all"), "__group", "__subroot", F.lit(1).alias("__one")), ["__all"], ["__group"], "__one", "__pos")
    groups = stored(
        _counted(
            ranked.select(F.col("__all").alias("__group"), F.col("__group").alias("__name"), F.col("__subroot").alias("__digest"), (F.col("__pos") - 1).alias("__pos"))
        ),
        "groups",
    )
    upper = _climbed(groups, arity)
    empty = F.array().cast("array<struct<left:string,right:string>>")
    root = upper[-1].select("__group", "__pos", F.col("__digest").alias("__root"), empty.alias("__path"))
    above = _with_paths(upper, root, arity, ["__root"])
    above = above.select(F.col("__name").alias("__group"), F.lit(0).cast("long").alias("__pos"), F.col("__digest").alias("__subroot"), "__root", "__path")
    whole = _with_paths(levels, above, arity, ["__subroot", "__root"])
    return whole.select(
        F.col("__key").alias(key),
        F.col("__digest").alias("leaf"),
        F.col("__subroot").alias("subroot"),
        F.col("__root").alias("root"),
        F.col("__path").alias("path"),
        *[F.col(f"__with_{name}").alias(name) for name in carry],
    )


def _counted(nodes: DataFrame) -> DataFrame:
    """Nodes with ``__n``, the number in their group; a hot group's count has several copies."""
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    counts = nodes.groupBy("__group").agg(F.count("*").alias("__n")).withColumn("__salt", copies)
    return nodes.withColumn("__salt", F.col("__pos") % SALTS).join(counts, ["__group", "__salt"]).drop("__salt")


def _climbed(nodes: DataFrame, arity: int) -> list[DataFrame]:
    """The nodes, those that their blocks yield, and so on, until every group has one."""
    levels = [nodes]
    span = arity**LEVELS
    while (levels[-1].agg(F.max("__n")).first()[0] or 0) > 1:
        hashed = _hashed(levels[-1], arity)
        parents = hashed.where(F.col("__pos") % span == 0).select(
            "__group",
            F.expr(f"__pos div {span}").alias("__pos"),
            F.expr(f"(__n + {span - 1}) div {span}").alias("__n"),
            F.col(f"__d{LEVELS}").alias("__digest"),
        )
        levels.append(stored(parents, "nodes"))
    return levels


def _hashed(nodes: DataFrame, arity: int) -> DataFrame:
    """Nodes with, for each level of their block, siblings and the digest above.

    A node of level l stands in the row of its first leaf, so its siblings are a multiple
    of arity ** l rows away; other rows hold NULL there.
    """
    block = Window.partitionBy("__group", "__block").orderBy("__pos")
    out = nodes.withColumn("__block", F.expr(f"__pos div {arity**LEVELS}")).withColumn("__d0", F.col("__digest"))
    for level in range(LEVELS):
        step = arity**level
        number = F.expr(f"__pos div {step}")
        slot = number % arity
        count = F.expr(f"(__n + {step - 1}) div {step}")
        run = F.least(F.lit(arity).cast("long"), count - number + slot)
        here, several = F.col("__pos") % step == 0, count > 1
        node = F.col(f"__d{level}")
        left = [F.when(slot >= j, F.lag(node, j * step).over(block)).otherwise("") for j in range(arity - 1, 0, -1)]
        right = [F.when(slot + j < run, F.lead(node, j * step).over(block)).otherwise("") for j in range(1, arity)]
        out = out.withColumns({f"__l{level}": F.when(here & several, F.concat(*left)), f"__r{level}": F.when(here & several, F.concat(*right))})
        parent = F.when(several, F.sha2(F.concat(node, F.col(f"__r{level}")), 256)).otherwise(node)
        out = out.withColumn(f"__d{level + 1}", F.when(here & (slot == 0), parent))
    return out


def _with_paths(levels: list[DataFrame], top: DataFrame, arity: int, carry: list[str]) -> DataFrame:
    """The nodes of the first level with ``__path`` up to where ``top`` goes on, and its columns."""
    so_far = Window.partitionBy("__group", "__block").orderBy("__pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    above = top
    for nodes in levels[-2::-1]:
        hashed = _hashed(nodes, arity)
        # The row that holds a leaf's node of any level is the last one that holds any.
        filled = hashed.withColumns(
            {f"__{side}{level}": F.last(f"__{side}{level}", ignorenulls=True).over(so_far) for level in range(LEVELS) for side in "lr"}
        )
        steps = [
            F.when(F.col(f"__l{level}").isNotNull(), F.struct(F.col(f"__l{level}").alias("left"), F.col(f"__r{level}").alias("right")))
            for level in range(LEVELS)
        ]
        own = filled.select(*nodes.columns, "__block", F.array_compact(F.array(*steps)).alias("__own"))
        given = above.select("__group", F.col("__pos").alias("__block"), F.col("__path").alias("__rest"), *carry)
        above = own.join(given, ["__group", "__block"]).withColumn("__path", F.concat("__own", "__rest")).drop("__own", "__rest", "__block")
    if len(levels) == 1:
        above = levels[0].join(top.select("__group", "__pos", "__path", *carry), ["__group", "__pos"])
    return above
