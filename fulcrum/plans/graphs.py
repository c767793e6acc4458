"""Queries on the property graph and its scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fulcrum.durable import Workspace
from fulcrum.operators import graph, scoring
from fulcrum.plans.tables import PROBLEM_SQL, TRADE_SQL, problem_graph, table, trade_edges, trade_graph, trade_nodes
from fulcrum.schemas import SCORE
from fulcrum.sources import sinks

#: Rounds the SQL unrolls for the 25 nodes of the acyclic trade graph: no walk is longer.
ROUNDS = 26


def gr06_build_graph(spark: SparkSession, d: str) -> DataFrame:
    e = graph.build_graph(trade_nodes(spark, d), trade_edges(spark, d)).edges
    return e.select("src", "dst", "type", F.round("strength", 6).alias("strength"), F.round("confidence", 6).alias("confidence"), "ord")


def gr06_problem_edges(spark: SparkSession, d: str) -> DataFrame:
    return problem_graph(spark, d).edges.select("src", "dst", "type", "strength", "confidence", "ord")


def gr07_graph_stats(spark: SparkSession, d: str) -> DataFrame:
    return graph.graph_stats(problem_graph(spark, d))


def agg01_node_types(spark: SparkSession, d: str) -> DataFrame:
    return graph.count_by_type(problem_graph(spark, d).nodes)


def agg02_field_distribution(spark: SparkSession, d: str) -> DataFrame:
    return graph.field_distribution(problem_graph(spark, d).nodes)


def agg03_orphans(spark: SparkSession, d: str) -> DataFrame:
    return graph.orphans(problem_graph(spark, d)).select("node_id", "ord")


def agg04_edge_types(spark: SparkSession, d: str) -> DataFrame:
    return graph.count_by_type(problem_graph(spark, d).edges)


def agg05_cross_field_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.cross_field_edges(problem_graph(spark, d)).select("src", "dst", "type")


def gr08_typed_subgraph(spark: SparkSession, d: str) -> DataFrame:
    g = problem_graph(spark, d)
    per = graph.of_types(g.edges, ("ENABLES",)).groupBy(F.col("src").alias("node_id")).agg(F.count(F.lit(1)).alias("n_out"))
    return g.nodes.select("node_id").join(per, "node_id", "left").na.fill(0, ["n_out"])


def gr09_normalised(spark: SparkSession, d: str) -> DataFrame:
    rows = problem_graph(spark, d).nodes.filter("confidence BETWEEN 0 AND 1").select("node_id", "confidence")
    return scoring.normalise(rows, "confidence").select("node_id", F.round("confidence", 6).alias("scaled"))


def gr10_cascade(spark: SparkSession, d: str) -> DataFrame:
    return scoring.cascade_scores(trade_graph(spark, d)).select("node_id", F.round("cascade", 4).alias("cascade"))


def gr10_cascade_problems(spark: SparkSession, d: str) -> DataFrame:
    """All rounds over the problem graph, whose cycles let scores grow; in seven digits."""
    s = scoring.cascade_scores(problem_graph(spark, d))
    return s.select("node_id", F.format_string("%.6e", "cascade").alias("cascade"))


def gr11_cross_field(spark: SparkSession, d: str) -> DataFrame:
    s = scoring.cross_field_leverage(trade_graph(spark, d))
    return s.select("node_id", F.round("cross_field", 6).alias("cross_field"), "n_domains")


def gr12_bottleneck(spark: SparkSession, d: str) -> DataFrame:
    return scoring.bottleneck_centrality(trade_graph(spark, d)).select("node_id", F.round("bottleneck", 6).alias("bottleneck"))


def leverage_index(spark: SparkSession, d: str) -> DataFrame:
    """GR13, GR14, WIN04, SRT03: the top 15 with their components."""
    g = trade_graph(spark, d)
    top = scoring.leaderboard(scoring.leverage_index(g), g.nodes, 15)
    return top.select("rank", "node_id", "title", "fields", *(F.round(c, 6).alias(c) for c in (*scoring.WEIGHTS, "leverage")))


def q02_roots_of_field(spark: SparkSession, d: str) -> DataFrame:
    """Nodes from which a node of the domain ASIA can be reached, with their distance."""
    g = trade_graph(spark, d)
    inside = graph.subgraph(g, field="ASIA").nodes.select("node_id")
    return graph.reachable(graph.of_types(g.edges), inside, reverse=True)


def q03_unlocked_by(spark: SparkSession, d: str) -> DataFrame:
    """Everything reachable from the most referenced seed or node of the problem graph, by distance."""
    g = problem_graph(spark, d)
    e = graph.of_types(g.edges)
    top = e.groupBy(F.col("src").alias("node_id")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "node_id").limit(1)
    return graph.reachable(e, top)


def q02_top_roots_problems(spark: SparkSession, d: str) -> DataFrame:
    """The ten nodes of the highest cascade score from which the domain agronomy can be reached."""
    g = problem_graph(spark, d)
    up = graph.reachable(graph.of_types(g.edges), graph.subgraph(g, field="agronomy").nodes.select("node_id"), reverse=True)
    return scoring.cascade_scores(g).join(up, "node_id").join(g.nodes.select("node_id", "ord"), "node_id").orderBy(F.desc("cascade"), "ord").limit(10).select("node_id", "depth")


def q03_unlocked_by_importance(spark: SparkSession, d: str) -> DataFrame:
    """What the most referenced node unlocks, the twenty of the highest cascade score first."""
    got = q03_unlocked_by(spark, d)
    g = problem_graph(spark, d)
    rows = got.join(scoring.cascade_scores(g), "node_id").join(g.nodes.select("node_id", "ord"), "node_id")
    return rows.orderBy(F.desc("cascade"), "ord").limit(20).select("node_id", "depth")


def udf06_weights(spark: SparkSession, d: str) -> DataFrame:
    """The leverage of the trade graph by weights of one's own, which needn't sum to 1."""
    g = trade_graph(spark, d)
    s = scoring.leverage_index(g, {"cascade": 1.0, "cross_field": 0.0, "bottleneck": 0.5})
    return s.select("node_id", F.round("leverage", 5).alias("leverage"))


def snk05_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores with nested components as JSON lines, read back."""
    path = Workspace(spark, "scores").root + "/scores"
    sinks.write_jsonl(sinks.nested_scores(scoring.leverage_index(trade_graph(spark, d))), path)
    return spark.read.schema(SCORE).json(path).select("node_id", F.round("leverage", 5).alias("leverage"), F.round("components.bottleneck", 5).alias("bottleneck"))


def q04_blocks(spark: SparkSession, d: str) -> DataFrame:
    return graph.blocked_by(trade_graph(spark, d).edges, "n20").select("node_id", "type", F.round("weight", 6).alias("weight"))


def q05_common_ancestors(spark: SparkSession, d: str) -> DataFrame:
    e = trade_graph(spark, d).edges
    one = lambda i: spark.createDataFrame([(i,)], "node_id string")
    return graph.common_ancestors(e, one("n12"), one("n17"))


def dg01_blocker_degree(spark: SparkSession, d: str) -> DataFrame:
    return graph.shared_blocker_degree(table(spark, d, "edges").withColumnsRenamed({"source_node_id": "src", "target_node_id": "dst"}).filter("src IS NOT NULL AND dst IS NOT NULL"))


def dg02_reach_strength(spark: SparkSession, d: str) -> DataFrame:
    g = trade_graph(spark, d)
    return scoring.reach_strength(g).select("node_id", F.round("strength", 6).alias("strength"))


def dg13_subgraph(spark: SparkSession, d: str) -> DataFrame:
    return graph.subgraph(problem_graph(spark, d), field="agronomy", node_type="data_gap").edges.select("src", "dst")


# --- the scores over the tables nodes and edges; they follow paths of any length, so SQL has no twin ---


def _typed_ends(g: graph.PropertyGraph, end: str, n: int) -> DataFrame:
    """The ``n`` nodes most often at this end of an edge."""
    return graph.of_types(g.edges).groupBy(F.col(end).alias("node_id")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "node_id").limit(n).select("node_id")


def gr10_cascade_whole_problems(spark: SparkSession, d: str) -> DataFrame:
    """Rounds until no score moves by the tolerance, at most 100; ``converged`` tells which."""
    s = scoring.cascade_scores(problem_graph(spark, d))
    return s.select("node_id", F.round("cascade", 6).alias("cascade"), "rounds", "converged")


def gr11_cross_field_problems(spark: SparkSession, d: str) -> DataFrame:
    s = scoring.cross_field_leverage(problem_graph(spark, d))
    return s.select("node_id", F.round("cross_field", 6).alias("cross_field"), "n_domains")


def gr12_bottleneck_problems(spark: SparkSession, d: str) -> DataFrame:
    return scoring.bottleneck_centrality(problem_graph(spark, d)).select("node_id", F.round("bottleneck", 9).alias("bottleneck"))


def leverage_index_problems(spark: SparkSession, d: str) -> DataFrame:
    """The top 15 of the problem graph with their components."""
    g = problem_graph(spark, d)
    top = scoring.leaderboard(scoring.leverage_index(g), g.nodes, 15)
    return top.select("rank", "node_id", "title", "fields", *(F.round(c, 6).alias(c) for c in (*scoring.WEIGHTS, "leverage")))


def dg02_reach_strength_problems(spark: SparkSession, d: str) -> DataFrame:
    g = problem_graph(spark, d)
    return scoring.reach_strength(g).select("node_id", F.round("strength", 6).alias("strength"))


def q02_roots_of_field_problems(spark: SparkSession, d: str) -> DataFrame:
    """Nodes from which a node of the domain agronomy can be reached, with their distance."""
    g = problem_graph(spark, d)
    inside = graph.subgraph(g, field="agronomy").nodes.select("node_id")
    return graph.reachable(graph.of_types(g.edges), inside, reverse=True)


def q04_blocks_problems(spark: SparkSession, d: str) -> DataFrame:
    """What blocks the node with most predecessors."""
    g = problem_graph(spark, d)
    top = [r.node_id for r in _typed_ends(g, "dst", 1).collect()]
    return graph.blocked_by(g.edges, top[0] if top else "").select("node_id", "type", F.round("weight", 6).alias("weight"))


def q05_common_ancestors_problems(spark: SparkSession, d: str) -> DataFrame:
    """Common ancestors of the two nodes with most predecessors."""
    g = problem_graph(spark, d)
    one, two = ([r.node_id for r in _typed_ends(g, "dst", 2).collect()] + [None, None])[:2]
    start = lambda i: spark.createDataFrame([(i,)], "node_id string")
    return graph.common_ancestors(graph.of_types(g.edges), start(one), start(two))


def _cascade_sql(nodes: str, edges: str, rounds: int, typed: str = "TRUE") -> str:
    out = f", s0 AS (SELECT node_id, 0.0::DOUBLE AS s FROM {nodes})"
    for k in range(1, rounds + 1):
        out += f", s{k} AS MATERIALIZED (SELECT n.node_id, coalesce(sum(e.w * (1 + 0.85 * coalesce(p.s, 0))), 0) AS s FROM {nodes} n LEFT JOIN {edges} e ON e.src = n.node_id AND {typed} LEFT JOIN s{k - 1} p ON p.node_id = e.dst GROUP BY 1)"
    return out


def _bfs_sql(levels: int) -> str:
    out = ", b0 AS MATERIALIZED (SELECT node_id AS start, node_id, 0::BIGINT AS pos, 1.0::DOUBLE AS weight, 0 AS depth FROM tn), v0 AS (SELECT * FROM b0)"
    for k in range(1, levels + 1):
        out += f"""
, b{k} AS MATERIALIZED (SELECT start, node_id, row_number() OVER (PARTITION BY start ORDER BY parent, place) AS pos, weight, {k} AS depth FROM (
  SELECT f.start, e.dst AS node_id, f.pos AS parent, e.ord AS place, f.weight * e.w AS weight, row_number() OVER (PARTITION BY f.start, e.dst ORDER BY f.pos, e.ord) AS rn
  FROM b{k - 1} f JOIN te e ON e.src = f.node_id WHERE NOT EXISTS (SELECT 1 FROM v{k - 1} s WHERE s.start = f.start AND s.node_id = e.dst)) WHERE rn = 1)
, v{k} AS MATERIALIZED (SELECT * FROM v{k - 1} UNION ALL SELECT * FROM b{k})"""
    return out + f"""
, cf0 AS (SELECT v.start, o.dom AS domain, max(v.weight) AS w FROM v{levels} v JOIN tn s ON s.node_id = v.start JOIN tn o ON o.node_id = v.node_id WHERE v.depth > 0 AND o.dom <> s.dom GROUP BY 1, 2)
, cf AS (SELECT n.node_id, coalesce(sum(c.w), 0) AS cross_field, count(c.w) AS n_domains FROM tn n LEFT JOIN cf0 c ON c.start = n.node_id GROUP BY 1)"""


def _between_sql() -> str:
    out = ", d0 AS MATERIALIZED (SELECT a.ord AS i, b.ord AS j, CASE WHEN a.ord = b.ord THEN 0 ELSE coalesce(min(1 / greatest(e.w, 1e-6)), 1e18) END AS d FROM tn a CROSS JOIN tn b LEFT JOIN te e ON e.src = a.node_id AND e.dst = b.node_id GROUP BY a.ord, b.ord)"
    for k in range(25):
        out += f", d{k + 1} AS MATERIALIZED (SELECT p.i, p.j, least(p.d, a.d + b.d) AS d FROM d{k} p JOIN d{k} a ON a.i = p.i AND a.j = {k} JOIN d{k} b ON b.i = {k} AND b.j = p.j)"
    return out + """
, bc0 AS (SELECT a.j AS v, count(*) AS c FROM d25 st JOIN d25 a ON a.i = st.i JOIN d25 b ON b.i = a.j AND b.j = st.j
  WHERE st.i <> st.j AND a.j <> st.i AND a.j <> st.j AND st.d < 1e17 AND abs(a.d + b.d - st.d) < 1e-9 GROUP BY 1)
, bc AS (SELECT n.node_id, coalesce(c.c, 0) / (24.0 * 23.0) AS bottleneck FROM tn n LEFT JOIN bc0 c ON c.v = n.ord)"""


_TYPED = "(SELECT src, dst FROM ge WHERE type IN ('ENABLES', 'PRODUCES_FOR'))"


def _levels_sql(start: str, levels: int, back: bool = False, h: str = "h", k: str = "k") -> str:
    """Tables ``k0`` to ``k<levels>`` of what a query's nodes reach."""
    a, b = ("dst", "src") if back else ("src", "dst")
    out = f", {h}0 AS MATERIALIZED (SELECT DISTINCT node_id, 0 AS depth FROM ({start})), {k}0 AS (SELECT * FROM {h}0)"
    for n in range(1, levels + 1):
        out += f", {h}{n} AS MATERIALIZED (SELECT DISTINCT e.{b} AS node_id, {n} AS depth FROM {h}{n - 1} f JOIN {_TYPED} e ON e.{a} = f.node_id WHERE e.{b} NOT IN (SELECT node_id FROM {k}{n - 1})), {k}{n} AS MATERIALIZED (SELECT * FROM {k}{n - 1} UNION ALL SELECT * FROM {h}{n})"
    return out


def _most_sql(end: str, skip: int = 0) -> str:
    return f"SELECT {end} AS node_id FROM {_TYPED} GROUP BY 1 ORDER BY count(*) DESC, {end} LIMIT 1 OFFSET {skip}"


def _reach_sql(levels: int) -> str:
    return _levels_sql(_most_sql("src"), levels) + f" SELECT node_id, depth FROM k{levels}"


_T, _G = "WITH RECURSIVE" + TRADE_SQL, "WITH RECURSIVE" + PROBLEM_SQL
_CROSS = "SELECT e.* FROM ge e JOIN gd a ON a.node_id = e.src JOIN gd b ON b.node_id = e.dst WHERE len(a.d) > 0 AND len(b.d) > 0 AND NOT list_has_any(a.d, b.d)"
_ORPHAN = "SELECT node_id, ord FROM gn WHERE node_id NOT IN (SELECT src FROM ge UNION SELECT dst FROM ge)"
_UP = "{0} AS (SELECT '{1}' AS node_id, 0 AS depth UNION SELECT e.src, r.depth + 1 FROM {0} r JOIN te e ON e.dst = r.node_id)"

QUERIES = {
    f.__name__: f
    for f in (
        gr06_build_graph, gr06_problem_edges, gr07_graph_stats, gr08_typed_subgraph, gr09_normalised, gr10_cascade, gr10_cascade_problems, gr11_cross_field, gr12_bottleneck, leverage_index,
        agg01_node_types, agg02_field_distribution, agg03_orphans, agg04_edge_types, agg05_cross_field_edges, q02_roots_of_field, q03_unlocked_by, q04_blocks, q05_common_ancestors,
        dg01_blocker_degree, dg02_reach_strength, dg13_subgraph, q02_top_roots_problems, q03_unlocked_by_importance, udf06_weights, snk05_scores, gr10_cascade_whole_problems, gr11_cross_field_problems, gr12_bottleneck_problems, leverage_index_problems, dg02_reach_strength_problems,
        q02_roots_of_field_problems, q04_blocks_problems, q05_common_ancestors_problems,
    )
}

SQL = {
    "gr06_build_graph": _T + " SELECT source_node_id AS src, target_node_id AS dst, arg_max(type, ord) AS type, round(arg_max(strength, ord), 6) AS strength, round(arg_max(confidence, ord), 6) AS confidence, min(ord) AS ord FROM tr WHERE u <> v GROUP BY 1, 2",
    "gr06_problem_edges": _G + " SELECT src, dst, type, strength, confidence, ord FROM ge",
    "gr07_graph_stats": _G + f", o AS ({_ORPHAN}), x AS ({_CROSS}) SELECT (SELECT count(*) FROM gn) AS n_nodes, (SELECT count(*) FROM ge) AS n_edges, (SELECT count(*) FROM o) AS n_orphans, (SELECT count(*) FROM x) AS n_cross_field, printf('%.1f', 100.0 * (SELECT count(*) FROM o) / greatest((SELECT count(*) FROM gn), 1))::DOUBLE AS orphan_pct",
    "gr08_typed_subgraph": _G + " SELECT n.node_id, count(e.src) AS n_out FROM gn n LEFT JOIN ge e ON e.src = n.node_id AND e.type = 'ENABLES' GROUP BY 1",
    "gr09_normalised": _G + ", c AS (SELECT node_id, confidence FROM gn WHERE confidence BETWEEN 0 AND 1) SELECT node_id, round(CASE WHEN max(confidence) OVER () = min(confidence) OVER () THEN 0 ELSE (confidence - min(confidence) OVER ()) / (max(confidence) OVER () - min(confidence) OVER ()) END, 6) AS scaled FROM c",
    "gr10_cascade": _T + _cascade_sql("tn", "te", ROUNDS) + f" SELECT node_id, round(s, 4) AS cascade FROM s{ROUNDS}",
    "gr10_cascade_problems": _G + ", gw AS MATERIALIZED (SELECT src, dst, strength * confidence AS w FROM ge WHERE type IN ('ENABLES', 'PRODUCES_FOR'))" + _cascade_sql("gn", "gw", 100) + " SELECT node_id, printf('%.6e', s) AS cascade FROM s100",
    "gr11_cross_field": _T + _bfs_sql(6) + " SELECT node_id, round(cross_field, 6) AS cross_field, n_domains FROM cf",
    "gr12_bottleneck": _T + _between_sql() + " SELECT node_id, round(bottleneck, 6) AS bottleneck FROM bc",
    "leverage_index": _T + _cascade_sql("tn", "te", ROUNDS) + _bfs_sql(6) + _between_sql() + f"""
, parts AS (SELECT n.node_id, n.ord, n.title, n.fields, s.s AS cascade, cf.cross_field, bc.bottleneck FROM tn n JOIN s{ROUNDS} s USING (node_id) JOIN cf USING (node_id) JOIN bc USING (node_id)),
ends AS (SELECT min(cascade) a, max(cascade) b, min(cross_field) c, max(cross_field) d, min(bottleneck) e, max(bottleneck) f FROM parts),
scaled AS (SELECT node_id, ord, title, fields, CASE WHEN a = b THEN 0 ELSE (cascade - a) / (b - a) END AS cascade, CASE WHEN c = d THEN 0 ELSE (cross_field - c) / (d - c) END AS cross_field, CASE WHEN e = f THEN 0 ELSE (bottleneck - e) / (f - e) END AS bottleneck FROM parts, ends),
lev AS (SELECT *, 0.45 * cascade + 0.30 * cross_field + 0.25 * bottleneck AS leverage FROM scaled)
SELECT row_number() OVER (ORDER BY leverage DESC, ord)::INT AS rank, node_id, title[1:40] AS title, array_to_string(fields[1:2], ', ') AS fields, round(cascade, 6) AS cascade, round(cross_field, 6) AS cross_field, round(bottleneck, 6) AS bottleneck, round(leverage, 6) AS leverage
FROM lev ORDER BY 1 LIMIT 15""",
    "udf06_weights": _T + _cascade_sql("tn", "te", ROUNDS) + _between_sql() + f""", ends AS (SELECT min(s) AS a, max(s) AS b FROM s{ROUNDS}), ends2 AS (SELECT min(bottleneck) AS a, max(bottleneck) AS b FROM bc)
SELECT s.node_id, round((s.s - ends.a) / (ends.b - ends.a) + 0.5 * CASE WHEN ends2.a = ends2.b THEN 0 ELSE (bottleneck - ends2.a) / (ends2.b - ends2.a) END, 5) AS leverage FROM s{ROUNDS} s JOIN bc USING (node_id), ends, ends2""",
    "q02_roots_of_field_problems": _G + _levels_sql("SELECT node_id FROM gd WHERE list_contains(d, 'agronomy')", 24, back=True) + " SELECT node_id, depth FROM k24",
    "q04_blocks_problems": _G + f", m AS ({_most_sql('dst')}) SELECT src AS node_id, type, round(strength * confidence, 6) AS weight FROM ge WHERE type IN ('ENABLES', 'PRODUCES_FOR') AND dst IN (SELECT node_id FROM m)",
    "q05_common_ancestors_problems": _G + _levels_sql(_most_sql("dst"), 24, back=True) + _levels_sql(_most_sql("dst", 1), 24, back=True, h="g", k="l") + " SELECT node_id, x.depth AS depth_x, y.depth AS depth_y FROM k24 x JOIN l24 y USING (node_id) WHERE x.depth > 0 AND y.depth > 0",
    "agg01_node_types": _G + " SELECT type, count(*) AS n, min(ord) AS first_ord FROM gn GROUP BY 1",
    "agg02_field_distribution": _G + " SELECT split_part(f, '.', 1) AS domain, count(*) AS n, min(ord) AS first_ord FROM (SELECT unnest(fields) AS f, ord FROM gn) GROUP BY 1",
    "agg03_orphans": _G + f" {_ORPHAN}",
    "agg04_edge_types": _G + " SELECT type, count(*) AS n, min(ord) AS first_ord FROM ge GROUP BY 1",
    "agg05_cross_field_edges": _G + f", x AS ({_CROSS}) SELECT src, dst, type FROM x",
    "q02_roots_of_field": _T + ", r AS (SELECT node_id, 0 AS depth FROM tn WHERE dom = 'ASIA' UNION SELECT e.src, r.depth + 1 FROM r JOIN te e ON e.dst = r.node_id) SELECT node_id, min(depth) AS depth FROM r GROUP BY 1",
    "q03_unlocked_by": _G + _reach_sql(24),
    "q04_blocks": _T + " SELECT src AS node_id, type, round(w, 6) AS weight FROM te WHERE dst = 'n20'",
    "q05_common_ancestors": _T + f", {_UP.format('x', 'n12')}, {_UP.format('y', 'n17')} SELECT node_id, min(x.depth) AS depth_x, min(y.depth) AS depth_y FROM x JOIN y USING (node_id) WHERE x.depth > 0 AND y.depth > 0 GROUP BY 1",
    "dg01_blocker_degree": "SELECT source_node_id AS src, count(DISTINCT target_node_id) AS n FROM edges WHERE type = 'ENABLES' AND source_node_id IS NOT NULL AND target_node_id IS NOT NULL GROUP BY 1",
    "dg02_reach_strength": _T + ", m0 AS MATERIALIZED (SELECT src AS s, dst AS t, w FROM te)" + "".join(f", m{k} AS MATERIALIZED (SELECT s, t, max(w) AS w FROM (SELECT * FROM m{k - 1} UNION ALL SELECT m.s, e.dst, m.w * e.w FROM m{k - 1} m JOIN te e ON e.src = m.t) GROUP BY 1, 2)" for k in range(1, 25)) + " SELECT n.node_id, round(coalesce(sum(m.w), 0), 6) AS strength FROM tn n LEFT JOIN m24 m ON m.s = n.node_id GROUP BY 1",
    "dg13_subgraph": _G + ", k AS (SELECT n.node_id FROM gn n JOIN gd USING (node_id) WHERE list_contains(gd.d, 'agronomy') AND n.type = 'data_gap') SELECT src, dst FROM ge WHERE src IN (SELECT node_id FROM k) AND dst IN (SELECT node_id FROM k)",
}
SQL["snk05_scores"] = SQL["leverage_index"].split("SELECT row_number()")[0] + " SELECT node_id, round(leverage, 5) AS leverage, round(bottleneck, 5) AS bottleneck FROM lev"
