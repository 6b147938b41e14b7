"""Connected parts of a graph given as links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.session import stored


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of all linked nodes; ``root`` names the part, one node of it.

    Every round gives nodes new random ranks, joins each with its neighbour of lowest rank
    and contracts links to the nodes chosen. A constant share of nodes goes in each round,
    however long the chains. Links with NULL ends and loops are void.
    """
    edges = stored(links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v").distinct(), "links")
    nodes = edges.select("u").union(edges.select("v")).distinct()
    owners = stored(nodes.select(F.col("u").alias("node"), F.col("u").alias("root")), "owners")
    turn = 0
    while not edges.isEmpty():
        both = edges.union(edges.select("v", "u"))
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("rank"), F.col(c).alias("node"))
        lowest = both.groupBy("u").agg(F.min(rank("v")).alias("m"))
        chosen = stored(lowest.select("u", F.least(rank("u"), "m")["node"].alias("w")), "chosen")
        moved = edges.join(chosen, "u").select(F.col("w").alias("x"), "v")
        moved = moved.join(chosen.withColumnRenamed("u", "v").withColumnRenamed("w", "y"), "v")
        after = moved.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).where("u <> v").distinct()
        owners = owners.join(chosen.select(F.col("u").alias("root"), F.col("w").alias("next")), "root", "left")
        owners = stored(owners.select("node", F.coalesce("next", "root").alias("root")), "owners")
        edges, turn = stored(after, "links"), turn + 1
    return owners
