"""The tables queries start from, and small proxy graphs built from the trade tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fulcrum.operators.graph import PropertyGraph, build_graph
from fulcrum.schemas import NODE_TYPES


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def problem_graph(spark: SparkSession, d: str) -> PropertyGraph:
    """The property graph of the tables nodes and edges."""
    return build_graph(table(spark, d, "nodes"), table(spark, d, "edges"))


def trade_nodes(spark: SparkSession, d: str) -> DataFrame:
    """One node per nation: its domain is its region."""
    n = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # five regions
    kind = F.element_at(F.array(*map(F.lit, NODE_TYPES)), (F.col("n_nationkey") % 6 + 1).cast("int"))
    return n.select(
        F.concat(F.lit("n"), "n_nationkey").alias("node_id"), F.col("n_nationkey").cast("long").alias("ord"), kind.alias("type"), F.col("n_name").alias("title"),
        F.array(F.concat_ws(".", "r_name", "n_name"), F.concat("r_name", F.lit(".general"))).alias("fields"),
    )


def trade_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Supplier nation to customer nation over all line items, grouped before any name is joined."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("v"))
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("u"))
    li = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity", "l_discount")
    rows = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.groupBy("u", "v").agg((F.avg("l_quantity") / 50).alias("strength"), (1 - F.avg("l_discount")).alias("confidence"), F.count(F.lit(1)).alias("n"))


def trade_edges(spark: SparkSession, d: str) -> DataFrame:
    """All pairs as raw edges: self loops included, later repeats of each pair as PRODUCES_FOR."""
    p = trade_pairs(spark, d)
    place = (F.col("u") * 25 + F.col("v")).cast("long")
    base = p.select(
        F.concat(F.lit("n"), "u").alias("source_node_id"), F.concat(F.lit("n"), "v").alias("target_node_id"), F.lit("ENABLES").alias("type"),
        F.col("strength"), F.col("confidence"), place.alias("ord"), "u", "v",
    )
    again = base.filter("(u + v) % 7 = 0").withColumns({"type": F.lit("PRODUCES_FOR"), "ord": F.col("ord") + 1000, "strength": F.col("strength") / 2})
    return base.unionByName(again)


def trade_graph(spark: SparkSession, d: str) -> PropertyGraph:
    """The acyclic part: edges from lower to higher nation only."""
    return build_graph(trade_nodes(spark, d), trade_edges(spark, d).filter("u < v"))


TRADE_SQL = """
tn AS MATERIALIZED (
  SELECT 'n' || n_nationkey AS node_id, n_nationkey::BIGINT AS ord, n_name AS title, r_name AS dom, [r_name || '.' || n_name, r_name || '.general'] AS fields,
    ['knowledge_gap', 'capability_gap', 'data_gap', 'infrastructure_gap', 'theoretical_gap', 'engineering_bottleneck'][n_nationkey % 6 + 1] AS type
  FROM nation JOIN region ON n_regionkey = r_regionkey
), tp AS MATERIALIZED (
  SELECT s_nationkey AS u, c_nationkey AS v, avg(l_quantity) / 50 AS strength, 1 - avg(l_discount) AS confidence
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2
), tr AS MATERIALIZED (
  SELECT 'n' || u AS source_node_id, 'n' || v AS target_node_id, 'ENABLES' AS type, strength, confidence, (u * 25 + v)::BIGINT AS ord, u, v FROM tp
  UNION ALL SELECT 'n' || u, 'n' || v, 'PRODUCES_FOR', strength / 2, confidence, u * 25 + v + 1000, u, v FROM tp WHERE (u + v) % 7 = 0
), te AS MATERIALIZED (
  SELECT source_node_id AS src, target_node_id AS dst, arg_max(type, ord) AS type, arg_max(strength, ord) AS strength, arg_max(confidence, ord) AS confidence,
    arg_max(strength, ord) * arg_max(confidence, ord) AS w, min(ord) AS ord
  FROM tr WHERE u < v GROUP BY 1, 2
)"""

PROBLEM_SQL = """
gn AS MATERIALIZED (
  SELECT node_id, arg_max(type, ord) AS type, arg_max(title, ord) AS title, arg_max(fields, ord) FILTER (WHERE fields IS NOT NULL) AS fields0, min(ord) AS ord,
    arg_max(struct_pack(f := fields), ord).f AS fields, arg_max(struct_pack(f := confidence), ord).f AS confidence, arg_max(struct_pack(f := granularity), ord).f AS granularity
  FROM nodes WHERE node_id IS NOT NULL GROUP BY 1
), ge AS MATERIALIZED (
  SELECT source_node_id AS src, target_node_id AS dst, arg_max(type, ord) AS type, arg_max(strength, ord) AS strength, arg_max(confidence, ord) AS confidence, min(ord) AS ord
  FROM edges WHERE source_node_id <> target_node_id AND source_node_id IN (SELECT node_id FROM gn) AND target_node_id IN (SELECT node_id FROM gn) GROUP BY 1, 2
), gd AS MATERIALIZED (SELECT node_id, list_distinct(list_transform(coalesce(fields, []), lambda f: split_part(f, '.', 1))) AS d FROM gn)"""
