"""The property graph: nodes, at most one edge per ordered pair, and questions asked of it.

Rows carry ``ord``, their place in the input: attributes of repeated nodes and
edges come from the last one, their place from the first.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fulcrum.durable import Workspace
from fulcrum.functions.numbers import round_binary
from fulcrum.functions.text import domain, domains
from fulcrum.operators.skew import spread_join
from fulcrum.schemas import EDGE_TYPES

NODE_ATTRIBUTES = ("type", "title", "granularity", "description", "fields", "confidence", "status", "extraction_method", "cross_field_ref")
EDGE_ATTRIBUTES = ("edge_id", "type", "strength", "confidence", "mechanism", "extraction_method")


@dataclass(frozen=True)
class PropertyGraph:
    nodes: DataFrame
    edges: DataFrame


def _last_by(df: DataFrame, keys: list[str], keep: list[str]) -> DataFrame:
    """One row a key: ``keep`` of the last row by ``ord``, ``ord`` of the first."""
    got = df.groupBy(*keys).agg(F.max_by(F.struct(*keep), "ord").alias("_r"), F.min("ord").alias("ord"))
    return got.select(*keys, "_r.*", "ord")


def build_graph(nodes: DataFrame, edges: DataFrame) -> PropertyGraph:
    """Nodes by id; edges between known nodes, without self loops, one per ordered pair.

    Input columns: ``node_id``/``ord`` and attributes; ``source_node_id``,
    ``target_node_id``/``ord`` and attributes.  Missing attributes are left out.
    Null ids name nothing.  Endpoints are checked by two semi-joins before the
    pairs are grouped, so dropped edges are never shuffled twice.
    """
    n = _last_by(nodes.filter("node_id IS NOT NULL"), ["node_id"], [c for c in NODE_ATTRIBUTES if c in nodes.columns])
    ids = n.select("node_id")
    e = edges.filter("source_node_id <> target_node_id").withColumnsRenamed({"source_node_id": "src", "target_node_id": "dst"})
    e = e.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
    return PropertyGraph(n, _last_by(e, ["src", "dst"], [c for c in EDGE_ATTRIBUTES if c in edges.columns]))


def of_types(edges: DataFrame, types: tuple[str, ...] = EDGE_TYPES) -> DataFrame:
    """The typed subgraph's edges; nodes stay."""
    return edges.filter(F.col("type").isin(*types))


def weight() -> Column:
    return F.col("strength") * F.col("confidence")


def count_by_type(df: DataFrame) -> DataFrame:
    """``(type, n, first_ord)``; order by ``n`` descending, then ``first_ord``."""
    return df.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first_ord"))


def field_distribution(nodes: DataFrame) -> DataFrame:
    """Tags by domain; two tags of one domain on one node count twice."""
    return nodes.select(F.explode("fields").alias("f"), "ord").groupBy(domain("f").alias("domain")).agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first_ord"))


def orphans(g: PropertyGraph) -> DataFrame:
    """Nodes without any edge."""
    ends = g.edges.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    return g.nodes.join(ends, "node_id", "left_anti")


def cross_field_edges(g: PropertyGraph) -> DataFrame:
    """Edges whose two domain sets are both non-empty and disjoint."""
    d = g.nodes.select("node_id", domains("fields").alias("d"))
    rows = g.edges.count()  # a node may be the end of a large part of all edges
    both = spread_join(spread_join(g.edges, d.selectExpr("node_id AS src", "d AS d1"), "src", rows, "inner"), d.selectExpr("node_id AS dst", "d AS d2"), "dst", rows, "inner")
    return both.filter((F.size("d1") > 0) & (F.size("d2") > 0) & ~F.arrays_overlap("d1", "d2")).drop("d1", "d2")


def graph_stats(g: PropertyGraph) -> DataFrame:
    """One row: ``n_nodes, n_edges, n_orphans, orphan_pct, n_cross_field``; an empty graph has zeros."""
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    row = one(g.nodes, "n_nodes").crossJoin(one(g.edges, "n_edges")).crossJoin(one(orphans(g), "n_orphans")).crossJoin(one(cross_field_edges(g), "n_cross_field"))  # single rows
    pct = round_binary(100.0 * F.col("n_orphans") / F.greatest("n_nodes", F.lit(1)), 1)
    return row.withColumn("orphan_pct", pct)


def reachable(edges: DataFrame, start: DataFrame, reverse: bool = False) -> DataFrame:
    """``(node_id, depth)``: nodes reached from any of ``start(node_id)`` (depth 0 itself), fewest hops.

    One join with the frontier a level, until a level finds nothing new; visited
    nodes are never expanded again, so cycles end.  Each level is a written table.
    """
    a, b = ("dst", "src") if reverse else ("src", "dst")
    work = Workspace(edges.sparkSession, "reach")
    links = work.put(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).distinct(), "links")
    front = work.put(start.select("node_id").filter("node_id IS NOT NULL").distinct().withColumn("depth", F.lit(0)), "level")
    seen = front
    for depth in count(1):
        step = links.join(front.select(F.col("node_id").alias("a")), "a", "left_semi").select(F.col("b").alias("node_id")).distinct()
        front = work.put(step.join(seen.select("node_id"), "node_id", "left_anti").withColumn("depth", F.lit(depth)), "level")
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)
        if depth % 20 == 0:  # many levels are gathered in one table, so that plans stay short
            seen = work.put(seen, "seen")


def blocked_by(edges: DataFrame, node_id: str) -> DataFrame:
    """Direct predecessors over the dependency edge types."""
    return of_types(edges).filter(F.col("dst") == node_id).select(F.col("src").alias("node_id"), "type", weight().alias("weight"))


def common_ancestors(edges: DataFrame, x: DataFrame, y: DataFrame) -> DataFrame:
    """Nodes from which both ``x`` and ``y`` can be reached, with both distances; neither counts for itself."""
    up_x = reachable(edges, x, reverse=True).filter("depth > 0").withColumnRenamed("depth", "depth_x")
    up_y = reachable(edges, y, reverse=True).filter("depth > 0").withColumnRenamed("depth", "depth_y")
    return up_x.join(up_y, "node_id")


def shared_blocker_degree(edges: DataFrame) -> DataFrame:
    """How many different nodes each node enables."""
    return edges.filter("type = 'ENABLES'").select("src", "dst").distinct().groupBy("src").agg(F.count(F.lit(1)).alias("n"))


def subgraph(g: PropertyGraph, field: str | None = None, node_type: str | None = None, scores: DataFrame | None = None, least: float = 0.0) -> PropertyGraph:
    """Nodes of a domain, a type, at least a leverage, and the edges among them."""
    n = g.nodes
    if field is not None:
        n = n.filter(F.array_contains(domains("fields"), field))
    if node_type is not None:
        n = n.filter(F.col("type") == node_type)
    if scores is not None:
        n = n.join(scores.filter(F.col("leverage") >= least).select("node_id"), "node_id", "left_semi")
    ids = n.select("node_id")
    e = g.edges.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
    return PropertyGraph(n, e)
