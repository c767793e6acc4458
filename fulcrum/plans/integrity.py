"""Queries on referential integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fulcrum.operators import orphans


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    edges = _t(spark, d, "edges")
    known = orphans.known_ids([_t(spark, d, "nodes"), _t(spark, d, "seed_nodes")], _t(spark, d, "node_tombstones"))
    rows = orphans.direct_orphans(orphans.edge_references(edges), known, 2 * edges.count())
    return rows.selectExpr("record_id AS edge_id", "side", "kind")


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.report(orphans.all_orphans(*(_t(spark, d, n) for n in ("nodes", "seed_nodes", "edges", "node_tombstones"))))


_REFS = """
WITH RECURSIVE recs AS (
  SELECT lower(trim(node_id, ' ' || chr(9))) AS id, ingested_at FROM nodes UNION ALL SELECT lower(trim(node_id, ' ' || chr(9))), ingested_at FROM seed_nodes
), seen AS (SELECT id, min(ingested_at) AS first_seen FROM recs GROUP BY id),
tomb AS (SELECT id, NOT back AS deleted FROM (SELECT lower(trim(node_id, ' ' || chr(9))) AS id, restored_at IS NOT NULL AS back,
  row_number() OVER (PARTITION BY lower(trim(node_id, ' ' || chr(9))) ORDER BY deleted_at DESC, (restored_at IS NOT NULL) DESC) AS rn FROM node_tombstones) WHERE rn = 1),
par AS (SELECT record_id, parent, came, period FROM (SELECT lower(trim(node_id, ' ' || chr(9))) AS record_id, lower(trim(parent_id, ' ' || chr(9))) AS parent, ingested_at AS came, strftime(created_at, '%Y-%m') AS period,
  row_number() OVER (PARTITION BY lower(trim(node_id, ' ' || chr(9))) ORDER BY ingested_at) AS rn FROM nodes) WHERE rn = 1 AND parent <> ''),
refs AS (
  SELECT 'edges' AS table_name, edge_id AS record_id, 'source' AS side, lower(trim(source_node_id, ' ' || chr(9))) AS ref_id, ingested_at AS came, strftime(created_at, '%Y-%m') AS period FROM edges
  UNION ALL SELECT 'edges', edge_id, 'target', lower(trim(target_node_id, ' ' || chr(9))), ingested_at, strftime(created_at, '%Y-%m') FROM edges
  UNION ALL SELECT 'nodes', record_id, 'parent', parent, came, period FROM par
), kinds AS (
  SELECT DISTINCT r.table_name, r.record_id, r.side, r.ref_id, r.period,
    CASE WHEN t.deleted THEN 'deleted' WHEN s.id IS NULL THEN 'missing' WHEN s.first_seen > r.came THEN 'late' END AS kind
  FROM refs r LEFT JOIN seen s ON r.ref_id = s.id LEFT JOIN tomb t ON r.ref_id = t.id WHERE r.ref_id <> ''
), direct AS (SELECT * FROM kinds WHERE kind IS NOT NULL)
"""

QUERIES = {"p4_found": p4_found, "p4_report": p4_report}

SQL = {
    "p4_found": _REFS + "SELECT record_id AS edge_id, side, kind FROM direct WHERE table_name = 'edges'",
    "p4_report": _REFS
    + """
, lost AS (
  SELECT record_id AS id FROM direct WHERE table_name = 'nodes' AND kind <> 'late'
  UNION SELECT p.record_id FROM par p JOIN lost l ON p.parent = l.id
), inh AS (
  SELECT DISTINCT r.table_name, r.record_id, r.side, r.period, 'inherited' AS kind FROM refs r JOIN lost l ON r.ref_id = l.id
  WHERE (r.table_name, r.record_id, r.side) NOT IN (SELECT (table_name, record_id, side) FROM direct)
)
SELECT table_name, side, period, kind, count(*) AS n_references FROM (
  SELECT table_name, record_id, side, period, kind FROM direct UNION ALL SELECT table_name, record_id, side, period, kind FROM inh
) GROUP BY ALL""",
}
