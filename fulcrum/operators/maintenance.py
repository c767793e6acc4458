"""Keeping the graph clean and current: edges, ids, hierarchy, staleness, coverage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fulcrum.durable import Workspace
from fulcrum.functions.numbers import min_max
from fulcrum.operators import similarity
from fulcrum.operators.skew import spread_join

WEAK_EDGE = 0.15
#: Yearly decay of confidence without a new confirmation; no rate is prescribed, this one halves it in about two years.
DECAY_PER_YEAR = 0.35

# How a problem's decomposability picks one of six ways to attack it.
ARCHITECTURES = ((0.85, "fully_parallel"), (0.7, "map_reduce"), (0.55, "pipeline"), (0.4, "hierarchical"), (0.2, "iterative_loop"), (0.0, "single_expert"))


def clean_edges(edges: DataFrame, weakest: float = WEAK_EDGE) -> DataFrame:
    """One edge per source, target and type (the first by ``ord``), weak ones dropped, ``near_duplicate`` where a pair has several types.

    Edges without a strength or confidence can't be judged and stay.
    """
    keys = ["source_node_id", "target_node_id", "type"]
    rest = [c for c in edges.columns if c not in keys]
    once = edges.filter("source_node_id IS NOT NULL AND target_node_id IS NOT NULL").groupBy(*keys).agg(F.min_by(F.struct(*rest), "ord").alias("r")).select(*keys, "r.*")
    strong = once.filter(F.coalesce(F.col("strength") * F.col("confidence") >= weakest, F.lit(True)))
    pairs = strong.groupBy("source_node_id", "target_node_id").agg((F.count(F.lit(1)) > 1).alias("near_duplicate"))
    return strong.join(pairs, ["source_node_id", "target_node_id"])


def permanent_ids(nodes: DataFrame, prefix: str = "p_") -> DataFrame:
    """``(old_id, new_id)``: ids derived from the old ones, so that reruns agree."""
    return nodes.select(F.col("node_id").alias("old_id")).filter("old_id IS NOT NULL").distinct().withColumn("new_id", F.concat(F.lit(prefix), F.substring(F.sha2("old_id", 256), 1, 20)))


def hierarchy(nodes: DataFrame) -> DataFrame:
    """``(node_id, root_id, depth)`` up the parents; nodes without a known parent are roots.

    Each round doubles the distance that every node looks up, so a chain of n nodes
    takes about log2(n) rounds.  Nodes on or below a cycle of parents have no root: both
    are null.  Nodes that have arrived at a root are only looked up, and an ancestor of
    very many nodes is spread.
    """
    work = Workspace(nodes.sparkSession, "hierarchy")
    up = nodes.filter("node_id IS NOT NULL").groupBy("node_id").agg(F.max_by("parent_id", "ord").alias("parent_id"))
    rows = up.count()
    known = up.select(F.col("node_id").alias("parent_id"), F.lit(True).alias("known"))
    up = work.put(spread_join(up, known, "parent_id", rows).select("node_id", F.when(F.col("known"), F.col("parent_id")).alias("parent_id")), "up")
    roots = up.filter("parent_id IS NULL").select("node_id", F.col("node_id").alias("root_id"), F.lit(0).cast("long").alias("depth"))
    below = up.filter("parent_id IS NOT NULL").select("node_id", F.col("parent_id").alias("at"), F.lit(1).cast("long").alias("depth"))
    known_roots = roots.select(F.col("node_id").alias("at"), F.lit(True).alias("_root"))
    below = work.put(spread_join(below, known_roots, "at", rows).select("node_id", "at", "depth", F.coalesce("_root", F.lit(False)).alias("home")), "below")
    reach = 1
    while reach <= rows and not below.filter("NOT home").isEmpty():
        # an ancestor that is no root itself is replaced by the one it has come to
        further = below.select(F.col("node_id").alias("at"), F.col("at").alias("next"), F.col("depth").alias("more"), F.col("home").alias("there"))
        met = spread_join(below.filter("NOT home").drop("home"), further, "at", rows)
        moved = met.select("node_id", F.col("next").alias("at"), (F.col("depth") + F.col("more")).alias("depth"), F.col("there").alias("home"))
        spent, below = below, work.put(below.filter("home").unionByName(moved), "below")
        work.drop(spent)
        reach *= 2
    ended = below.select("node_id", F.when(F.col("home"), F.col("at")).alias("root_id"), F.when(F.col("home"), F.col("depth")).alias("depth"))
    return roots.unionByName(ended).select("node_id", "root_id", F.col("depth").cast("int").alias("depth"))


def with_orphan_flag(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """``rows`` with ``orphan``: no edge ``(src, dst)`` names the node."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct().withColumn("_met", F.lit(True))
    return rows.join(ends, "node_id", "left").withColumn("orphan", F.col("_met").isNull()).drop("_met")


def decayed_confidence(nodes: DataFrame, as_of: str, rate: float = DECAY_PER_YEAR) -> DataFrame:
    """``(node_id, decayed, stale)``: confidence times exp(-rate * years) since the last validation; stale from two years on."""
    days = F.datediff(F.lit(as_of).cast("date"), F.coalesce("last_validated", "created_at").cast("date"))
    return nodes.select("node_id", (F.col("confidence") * F.exp(-rate * F.greatest(days, F.lit(0)) / 365.0)).alias("decayed"), (days >= 730).alias("stale"))


def normalised_within(scores: DataFrame, by: str, value: str) -> DataFrame:
    """The value scaled to 0..1 within each group; group ends are aggregated and joined, no group is gathered."""
    ends = scores.groupBy(F.col(by).alias("_by")).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    out = scores.join(ends, F.col(by).eqNullSafe(F.col("_by"))).drop("_by")
    return out.withColumn(value, min_max(F.col(value), F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def resolve_stubs(best: DataFrame, sure: float = 0.85, near: float = 0.75, far: float = 0.80) -> DataFrame:
    """``(id, decision, match)`` from each stub's two nearest ``(id, rank, match, sim)``.

    Flag if both are near; resolve if the first is sure; promote if none is close;
    anything left is flagged too.
    """
    one = best.groupBy("id").agg(F.max(F.when(F.col("rank") == 1, F.col("sim"))).alias("top1"), F.max(F.when(F.col("rank") == 2, F.col("sim"))).alias("top2"), F.max(F.when(F.col("rank") == 1, F.col("match"))).alias("match"))
    second = F.coalesce("top2", F.lit(-1.0))
    decision = F.when((F.col("top1") > near) & (second > near), "flag").when((F.col("top1") > sure) & (second < near), "resolve").when(F.col("top1") < far, "promote").otherwise("flag")
    return one.select("id", decision.alias("decision"), F.when(decision == "resolve", F.col("match")).alias("match"))


def integrate_seeds(seeds: DataFrame, nodes: DataFrame, key: Column) -> DataFrame:
    """``(seed_id, node_id, status)``: seeds and nodes matched on a normalised key, the unmatched of both sides kept."""
    s = seeds.withColumn("_k", key).filter("_k IS NOT NULL").groupBy("_k").agg(F.min("node_id").alias("seed_id"))
    n = nodes.withColumn("_k", key).filter("_k IS NOT NULL").groupBy("_k").agg(F.min("node_id").alias("node_id"))
    both = s.join(n, "_k", "full")
    return both.select("seed_id", "node_id", F.when(F.col("seed_id").isNull(), "extracted").when(F.col("node_id").isNull(), "seed_only").otherwise("matched").alias("status"))


def integrate_by_nearest(seeds: DataFrame, nodes: DataFrame, make: Callable[[], similarity.Embedder] = similarity.hashed_words, sure: float = 0.85) -> DataFrame:
    """``(seed_id, node_id, status)``: each seed's most similar node by title and description, if similar enough; the unmatched of both sides kept.

    Seeds are a list set by hand; every seed is compared with all nodes.
    """
    worded = lambda df: df.filter("node_id IS NOT NULL").groupBy(F.col("node_id").alias("id")).agg(F.min(F.concat_ws(". ", "title", "description")).alias("t"))
    best = similarity.nearest_texts(worded(seeds), worded(nodes), make).filter(F.col("sim") >= sure).select(F.col("id").alias("seed_id"), F.col("match").alias("node_id"))
    only = seeds.select(F.col("node_id").alias("seed_id")).filter("seed_id IS NOT NULL").distinct().join(best, "seed_id", "left")
    rest = nodes.select("node_id").filter("node_id IS NOT NULL").distinct().join(best.select("node_id").distinct(), "node_id", "left_anti")
    return only.select("seed_id", "node_id", F.when(F.col("node_id").isNull(), "seed_only").otherwise("matched").alias("status")).unionByName(rest.select(F.lit(None).cast("string").alias("seed_id"), "node_id", F.lit("extracted").alias("status")))


#: Bounds that a finished graph has to keep, metric, least, most.
GATES = (("n_nodes", 400.0, None), ("n_edges", 1500.0, None), ("orphan_pct", None, 15.0), ("n_cross_field", 50.0, None))


def gate_verdicts(values: DataFrame) -> DataFrame:
    """``(metric, value, passed)`` of ``(metric, value)`` rows that have a bound."""
    verdict = F.lit(None).cast("boolean")
    for metric, least, most in GATES:
        verdict = F.when(F.col("metric") == metric, (F.col("value") >= least) if least is not None else (F.col("value") <= most)).otherwise(verdict)
    return values.select("metric", "value", verdict.alias("passed")).filter("passed IS NOT NULL")


def coverage(top: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(metric, value)`` of a leaderboard: rows, share of the largest domain, mean confidence."""
    rows = top.select("node_id").join(nodes, "node_id")
    dom = rows.select(F.explode("fields").alias("f")).groupBy(F.substring_index("f", ".", 1).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    share = dom.agg((100.0 * F.max("n") / F.sum("n")).alias("value")).select(F.lit("largest_domain_pct").alias("metric"), "value")
    rest = rows.agg(F.count(F.lit(1)).cast("double").alias("n_rows"), F.avg(F.when(F.col("confidence").between(0, 1), F.col("confidence"))).alias("mean_confidence"))
    return rest.select(F.explode(F.create_map(F.lit("n_rows"), "n_rows", F.lit("mean_confidence"), "mean_confidence")).alias("metric", "value")).unionByName(share)


def as_of(nodes: DataFrame, edges: DataFrame, year: int) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges created up to the end of a year."""
    return tuple(t.filter(F.year("created_at") <= year) for t in (nodes, edges))  # type: ignore[return-value]


def decomposability(axes: Column, *more: Column) -> tuple[Column, Column]:
    """Mean of the axes (0..1 each) and the way of attack it suggests."""
    parts = (axes, *more)
    mean = sum(parts[1:], parts[0]) / len(parts)
    pick = F.lit(ARCHITECTURES[-1][1])
    for least, name in reversed(ARCHITECTURES[:-1]):
        pick = F.when(mean >= least, name).otherwise(pick)
    return mean, pick


def emerging_bottlenecks(edges: DataFrame, period: Column) -> DataFrame:
    """``(src, period, degree, delta)``: different targets newly enabled per period, and the change from the period before."""
    per = edges.filter("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst", period.alias("period")).distinct().groupBy("src", "period").agg(F.count(F.lit(1)).alias("degree"))
    before = F.lag("degree", 1, 0).over(Window.partitionBy("src").orderBy("period"))  # a node's periods are few
    return per.withColumn("delta", F.col("degree") - before)
