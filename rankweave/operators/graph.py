"""Property graphs as two DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.session import durable

class Graph:
    """Vertices (id, label, ...) and edges (src, dst, label, ...)."""

    def __init__(self, vertices: DataFrame, edges: DataFrame, name: str = "graph", check: bool = False) -> None:
        for df, needed, what in ((vertices, {"id"}, "vertices"), (edges, {"src", "dst"}, "edges")):
            if not needed <= set(df.columns):
                raise ValueError(f"{what} need the columns {sorted(needed)}")
        if not name:
            raise ValueError("a graph needs a name")
        self.vertices, self.edges, self.name = vertices, edges, name
        if check and self.dangling().limit(1).collect():
            raise ValueError("edges name vertices that do not exist")

    def dangling(self) -> DataFrame:
        """Edges with an end that is no vertex."""
        known = self.vertices.select("id")
        lost = lambda end: self.edges.join(known, self.edges[end] == known["id"], "left_anti")
        return lost("src").union(lost("dst")).distinct()


def create_graph(vertices: DataFrame, edges: DataFrame, name: str) -> Graph:
    """A checked named graph."""
    return Graph(vertices, edges, name, check=True)


@dataclass(frozen=True)
class Hop:
    """One step of a pattern: an edge, its direction, and conditions on edge and end.

    Conditions see the columns of the edge (``edge``) or of the vertex reached (``node``).
    """

    edge: Column | str | None = None
    node: Column | str | None = None
    reverse: bool = False


def _condition(condition: Column | str | None) -> Column:
    if condition is None:
        return F.lit(True)
    return F.expr(condition) if isinstance(condition, str) else condition


def match_path(graph: Graph, hops: list[Hop], start: Column | str | None = None) -> DataFrame:
    """(v0, v1, ..., vn) for every walk that fits the pattern, one equi-join per hop.

    Conditions are applied before the joins, and only ids move through them.
    """
    out = graph.vertices.where(_condition(start)).select(F.col("id").alias("v0"))
    for n, hop in enumerate(hops, start=1):
        near, far = ("dst", "src") if hop.reverse else ("src", "dst")
        edges = graph.edges.where(_condition(hop.edge)).select(
            F.col(near).alias(f"v{n - 1}"), F.col(far).alias(f"v{n}")
        )
        out = out.join(edges, f"v{n - 1}")
        if hop.node is not None:
            ends = graph.vertices.where(_condition(hop.node)).select(F.col("id").alias(f"v{n}"))
            out = out.join(ends, f"v{n}", "left_semi")
    return out.select(*[f"v{n}" for n in range(len(hops) + 1)])


def traverse(graph: Graph, start: DataFrame, max_depth: int, directed: bool = True) -> DataFrame:
    """(id, depth): every vertex within ``max_depth`` steps of the start ids.

    Rounds of frontier against edges; a vertex is kept at its first depth. Every
    round is written to the shared checkpoint folder: the next one uses it twice, so
    without that the work would double from round to round.
    """
    edges = graph.edges.select("src", "dst")
    edges = durable(edges if directed else edges.union(edges.select("dst", "src")).distinct())
    ids = start.select(F.col(start.columns[0]).alias("id")).distinct()
    seen = durable(ids.withColumn("depth", F.lit(0)))
    frontier = seen
    for step in range(1, max_depth + 1):
        reached = durable(
            frontier.select(F.col("id").alias("src"))
            .join(edges, "src")
            .select(F.col("dst").alias("id"))
            .distinct()
            .join(seen.select("id"), "id", "left_anti")
            .withColumn("depth", F.lit(step))
        )
        if not reached.limit(1).collect():
            break
        seen, frontier = seen.unionByName(reached), reached
    return seen


def path_query(df: DataFrame, by: dict | None = None, order: str | None = None, last: int | None = None, first: int | None = None) -> DataFrame:
    """Equality filters, an order, and the first or last n rows of it."""
    out = df
    for col, value in (by or {}).items():
        out = out.where(F.col(col) == F.lit(value))
    if (last is not None or first is not None) and order is None:
        raise ValueError("first and last need an order")
    if last is not None and first is not None:
        raise ValueError("give first or last, not both")
    if order is None:
        return out
    if last is not None:
        return out.orderBy(F.col(order).desc_nulls_last()).limit(last)
    ordered = out.orderBy(F.col(order).asc_nulls_last())
    return ordered if first is None else ordered.limit(first)
