"""Cascade, cross-field and bottleneck scores, and the leverage index they make up."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fulcrum.durable import Workspace
from fulcrum.functions.numbers import min_max
from fulcrum.functions.text import domains
from fulcrum.operators import compact as cp
from fulcrum.operators.graph import PropertyGraph, of_types, weight
from fulcrum.schemas import EDGE_TYPES

# Weights of the index.
WEIGHTS = {"cascade": 0.45, "cross_field": 0.30, "bottleneck": 0.25}

#: Starts of a round trip where a graph is too large to be sent to the executors.
STARTS_AT_ONCE = 1_000


def cascade_scores(g: PropertyGraph, max_rounds: int = 100, damping: float = 0.85, tolerance: float = 1e-6, cut_every: int = 4) -> DataFrame:
    """``(node_id, cascade, rounds, converged)``: damped sum of edge weights over all walks.

    Jacobi rounds from an importance of 1, ``s = sum of w * imp_next`` and then
    ``imp = 1 + damping * s``, until no score moves by the tolerance or the rounds are
    over; without convergence (cycles with a spectral radius of 1 or more) the last
    round is returned and says so.  Lineage is cut every few rounds; each round's
    largest move is kept, so that the first round that is still enough counts.
    Nodes without out-edges score 0; an empty graph gives no rows.  A graph within
    ``compact.MOST_EDGES`` takes its rounds in one task, a larger one in joins.
    """
    work = Workspace(g.nodes.sparkSession, "cascade")
    links = _typed(g, work)
    if _small(links):
        return _cascade_small(links, g.nodes, work, max_rounds, damping, tolerance)
    state = work.put(g.nodes.select("node_id", F.lit(0.0).alias("s")), "s0")
    last, rounds, converged = "s", 0, False
    while rounds < max_rounds and not converged:
        before, state, names = state, state.select("node_id", F.col(last).alias("s")), ["s"]
        for k in range(1, min(cut_every, max_rounds - rounds) + 1):
            carried = links.join(state.select(F.col("node_id").alias("dst"), F.col(names[-1]).alias("_s")), "dst")
            sums = carried.groupBy(F.col("src").alias("node_id")).agg(F.sum(F.col("w") * (1 + (damping if rounds + k > 1 else 0.0) * F.col("_s"))).alias("_new"))
            state = state.join(sums, "node_id", "left").withColumn(f"s{k}", F.coalesce("_new", F.lit(0.0))).drop("_new")
            names.append(f"s{k}")
        state = work.put(state, f"s{rounds}")
        work.drop(before)
        moves = state.agg(*(F.max(F.abs(F.col(n) - F.col(m))).alias(n) for m, n in zip(names, names[1:], strict=False))).first()
        for last in names[1:]:
            rounds += 1
            if moves[last] is None or moves[last] < tolerance:
                converged = True
                break
    return state.select("node_id", F.col(last).alias("cascade"), F.lit(rounds).alias("rounds"), F.lit(converged).alias("converged"))


def _cascade_small(links: DataFrame, nodes: DataFrame, work: Workspace, max_rounds: int, damping: float, tolerance: float) -> DataFrame:
    graph = cp.compact(links)
    shared = links.sparkSession.sparkContext.broadcast(graph)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        n = len(c.ids)
        src = np.repeat(np.arange(n), np.diff(c.first))
        score, rounds, converged = np.zeros(n), 0, False
        while rounds < max_rounds and not converged:
            new = np.bincount(src, weights=c.weight * (1 + (damping if rounds else 0.0) * score[c.to]), minlength=n)
            rounds, converged = rounds + 1, bool(np.abs(new - score).max(initial=0.0) < tolerance)
            score = new
        for _ in batches:
            yield pa.RecordBatch.from_pydict({"node_id": pa.array([*c.ids.to_pylist(), None], pa.string()), "cascade": np.append(score, 0.0), "rounds": pa.array([rounds] * (n + 1), pa.int32()), "converged": [converged] * (n + 1)})

    made = work.put(links.sparkSession.range(0, 1, 1, 1).mapInArrow(run, "node_id string, cascade double, rounds int, converged boolean"), "scores")
    end = made.filter("node_id IS NULL").first()  # one row says how it ended
    return nodes.select("node_id").join(made.filter("node_id IS NOT NULL").select("node_id", "cascade"), "node_id", "left").select("node_id", F.coalesce("cascade", F.lit(0.0)).alias("cascade"), F.lit(end.rounds).alias("rounds"), F.lit(end.converged).alias("converged"))


def _small(links: DataFrame) -> bool:
    return links.count() <= cp.MOST_EDGES


def _typed(g: PropertyGraph, work: Workspace, types: tuple[str, ...] = EDGE_TYPES) -> DataFrame:
    """``(src, dst, w, place)``; an edge without strength or confidence has the weight 0."""
    return work.put(of_types(g.edges, types).select("src", "dst", F.coalesce(weight(), F.lit(0.0)).alias("w"), F.col("ord").alias("place")), "links")


def _each_start(links: DataFrame, graph: cp.Compact, starts: np.ndarray, run: Callable[[cp.Compact, np.ndarray], dict], schema: str) -> DataFrame:
    """What ``run`` makes of each task's starts; ``graph`` is sent to every executor."""
    spark = links.sparkSession
    shared = spark.sparkContext.broadcast((graph, starts))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, every = shared.value
        for b in batches:
            for lot in c.lots(every[b.column(0).to_numpy()]):
                yield pa.RecordBatch.from_pydict(run(c, lot))

    tasks = max(1, min(len(starts), 4 * spark.sparkContext.defaultParallelism))
    return spark.range(0, len(starts), 1, tasks).mapInArrow(work, schema)


def _starts(graph: cp.Compact) -> np.ndarray:
    """The nodes with an out-edge."""
    return np.nonzero(np.diff(graph.first))[0]


def cross_field_leverage(g: PropertyGraph) -> DataFrame:
    """``(node_id, cross_field, n_domains)``: best weight with which each foreign domain is first reached, summed.

    Breadth-first from every node: a node is discovered once, by the earliest parent
    of its level, then the earliest edge, and carries the product of weights along
    that tree path.  Nodes without fields count for nothing but pass the path on.
    A graph within ``compact.MOST_EDGES`` is searched from its starts independently; a
    larger one level by level in joins, STARTS_AT_ONCE starts at a time.
    """
    work = Workspace(g.nodes.sparkSession, "crossfield")
    links = _typed(g, work)
    dom = work.put(g.nodes.select("node_id", domains("fields").alias("d")), "domains")
    best = (_cross_field_small if _small(links) else _cross_field_large)(links, dom, work)
    return g.nodes.select("node_id").join(best, "node_id", "left").na.fill(0.0, ["cross_field"]).na.fill(0, ["n_domains"])


def _cross_field_small(links: DataFrame, dom: DataFrame, work: Workspace) -> DataFrame:
    graph = cp.compact(links)
    ends = links.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    listed = dom.join(ends, "node_id", "left_semi").toArrow().sort_by("node_id")  # the nodes of the edges, so of bounded number too
    named = listed.column("d").to_pylist()
    code: dict[str, int] = {}
    own = [[code.setdefault(x, len(code)) for x in d] for d in named]
    first, codes = np.concatenate([[0], np.cumsum([len(d) for d in own])]).astype(np.int64), np.array([c for d in own for c in d], np.int64)
    wide, n = len(code), len(graph.ids)

    def run(c: cp.Compact, starts: np.ndarray) -> dict:
        place, w = cp.first_paths(c, starts)
        held = first[place % n + 1] - first[place % n]
        at = np.arange(held.sum()) + np.repeat(first[place % n] - (np.cumsum(held) - held), held)
        best = np.full(len(starts) * wide, -np.inf)
        np.maximum.at(best, np.repeat(place // n, held) * wide + codes[at], np.repeat(w, held))
        mine = first[starts + 1] - first[starts]
        at = np.arange(mine.sum()) + np.repeat(first[starts] - (np.cumsum(mine) - mine), mine)
        best[np.repeat(np.arange(len(starts)), mine) * wide + codes[at]] = -np.inf
        best = best.reshape(len(starts), wide)
        there = np.isfinite(best)
        return {"node_id": c.ids.take(pa.array(starts)), "cross_field": np.where(there, best, 0.0).sum(1), "n_domains": there.sum(1)}

    return _each_start(links, graph, _starts(graph), run, "node_id string, cross_field double, n_domains long")


def _lots(links: DataFrame, work: Workspace) -> Iterator[DataFrame]:
    """The nodes with an out-edge in lots of about STARTS_AT_ONCE, dealt by their hashes."""
    starts = work.put(links.select("src").distinct(), "starts")
    many = max(1, -(-starts.count() // STARTS_AT_ONCE))
    for k in range(many):
        yield starts.filter(F.pmod(F.xxhash64("src"), F.lit(many)) == k)


def _cross_field_large(links: DataFrame, dom: DataFrame, work: Workspace) -> DataFrame:
    out = None
    queue = Window.partitionBy("start").orderBy("parent", "place")
    for starts in _lots(links, work):
        front = work.put(starts.select(F.col("src").alias("start"), F.col("src").alias("node_id"), F.lit(0).cast("long").alias("pos"), F.lit(1.0).alias("weight"), F.lit(0).alias("depth")), "front")
        levels = [front]
        for depth in count(1):
            seen = levels[0]
            for level in levels[1:]:
                seen = seen.unionByName(level)
            step = front.join(links.withColumnRenamed("src", "node_id"), "node_id").select("start", F.col("dst").alias("node_id"), F.col("pos").alias("parent"), "place", (F.col("weight") * F.col("w")).alias("weight"))
            earliest = step.groupBy("start", "node_id").agg(F.min(F.struct("parent", "place", "weight")).alias("f")).select("start", "node_id", "f.*")
            fresh = earliest.join(seen.select("start", "node_id"), ["start", "node_id"], "left_anti")
            front = work.put(fresh.select("start", "node_id", F.row_number().over(queue).cast("long").alias("pos"), "weight", F.lit(depth).alias("depth")), "front")
            if front.isEmpty():
                break
            levels.append(front)
        hit = seen.filter("depth > 0").join(dom.selectExpr("node_id AS start", "d AS own"), "start").join(dom, "node_id")
        foreign = hit.select("start", "weight", F.explode(F.array_except("d", "own")).alias("domain"))
        part = foreign.groupBy("start", "domain").agg(F.max("weight").alias("w")).groupBy(F.col("start").alias("node_id")).agg(F.sum("w").alias("cross_field"), F.count(F.lit(1)).alias("n_domains"))
        part = work.put(part, "part")
        for level in levels:
            work.drop(level)
        out = part if out is None else out.unionByName(part)
    return out


def bottleneck_centrality(g: PropertyGraph, edge_types: tuple[str, ...] = EDGE_TYPES, sources: int | None = None) -> DataFrame:
    """``(node_id, bottleneck)``: weighted betweenness, endpoints excluded, scaled for directed graphs.

    Edge length is ``1 / max(strength * confidence, 1e-6)``; equal shortest paths
    share.  A graph within ``compact.MOST_EDGES`` is searched from its starts
    independently; a larger one in joins, STARTS_AT_ONCE starts at a time.  ``sources``
    takes that many of the nodes with an out-edge, by hash, and scales up by their share
    of these nodes: an explicit, unbiased approximation for large graphs.
    """
    work = Workspace(g.nodes.sparkSession, "bottleneck")
    links = _typed(g, work, edge_types).withColumn("w", 1.0 / F.greatest("w", F.lit(1e-6)))
    n = g.nodes.count()
    if n <= 2 or links.isEmpty():
        return g.nodes.select("node_id", F.lit(0.0).alias("bottleneck"))
    if _small(links):
        graph = cp.compact(links)
        starts = _starts(graph)
        scale = 1.0
        if sources is not None and sources < len(starts):
            ids = graph.ids.take(pa.array(starts)).to_pylist()
            dealt = np.argsort([int.from_bytes(hashlib.sha256(i.encode()).digest()[:8], "big") for i in ids], kind="stable")
            scale, starts = len(starts) / sources, np.sort(starts[dealt[:sources]])
        run = lambda c, lot: {"node_id": c.ids, "part": cp.between(c, lot)}
        parts = _each_start(links, graph, starts, run, "node_id string, part double")
    else:
        scale = 1.0
        lots = _lots(links, work)
        if sources is not None:
            every = links.select("src").distinct()
            scale = max(1.0, every.count() / sources)
            lots = iter([every.orderBy(F.sha2("src", 256)).limit(sources)])
        parts = None
        for lot in lots:
            part = work.put(_between_large(links, lot, work), "part")
            parts = part if parts is None else parts.unionByName(part)
    sums = parts.groupBy("node_id").agg((F.sum("part") * scale / ((n - 1) * (n - 2))).alias("b"))
    return g.nodes.select("node_id").join(sums, "node_id", "left").select("node_id", F.coalesce("b", F.lit(0.0)).alias("bottleneck"))


def _between_large(links: DataFrame, starts: DataFrame, work: Workspace) -> DataFrame:
    """``(node_id, part)``: the same as ``compact.between``, each step a join; state is written every round."""
    far = front = work.put(starts.select(F.col("src").alias("s"), F.col("src").alias("v"), F.lit(0.0).alias("d")), "far")
    edges = links.select(F.col("src").alias("v"), F.col("dst").alias("to"), "w")
    while not front.isEmpty():
        step = front.join(edges, "v").groupBy("s", F.col("to").alias("v")).agg(F.min(F.col("d") + F.col("w")).alias("d"))
        front = work.put(step.join(far.withColumnRenamed("d", "old"), ["s", "v"], "left").filter("old IS NULL OR d < old").select("s", "v", "d"), "front")
        far, spent = work.put(far.unionByName(front).groupBy("s", "v").agg(F.min("d").alias("d")), "far"), far
        work.drop(spent)
    tight = far.join(edges, "v").join(far.select("s", F.col("v").alias("to"), F.col("d").alias("d_to")), ["s", "to"]).filter("d + w = d_to").select("s", F.col("v").alias("a"), F.col("to").alias("b"))
    tight = work.put(tight, "tight")
    # paths are counted wave by wave; a place passes them on once all its edges have come in
    waiting = work.put(tight.groupBy("s", F.col("b").alias("v")).agg(F.count(F.lit(1)).alias("open"), F.lit(0.0).alias("paths")), "waiting")
    front = work.put(starts.select(F.col("src").alias("s"), F.col("src").alias("v"), F.lit(1.0).alias("paths")), "wave")
    waves = []
    while not front.isEmpty():
        waves.append(front)
        came = tight.join(front.select("s", F.col("v").alias("a"), "paths"), ["s", "a"]).groupBy("s", F.col("b").alias("v")).agg(F.count(F.lit(1)).alias("k"), F.sum("paths").alias("more"))
        left = waiting.join(came, ["s", "v"], "left").select("s", "v", (F.col("open") - F.coalesce("k", F.lit(0))).alias("open"), (F.col("paths") + F.coalesce("more", F.lit(0.0))).alias("paths"))
        settled, spent = work.put(left, "settled"), waiting
        front = work.put(settled.filter("open = 0").select("s", "v", "paths"), "wave")
        waiting = work.put(settled.filter("open > 0"), "waiting")
        work.drop(spent)
        work.drop(settled)
    share = work.put(waves[-1].select("s", "v", "paths", F.lit(0.0).alias("share")), "share")
    done = share
    for wave in reversed(waves[:-1]):
        back = tight.join(wave.select("s", F.col("v").alias("a"), F.col("paths").alias("pa")), ["s", "a"]).join(done.select("s", F.col("v").alias("b"), F.col("paths").alias("pb"), "share"), ["s", "b"])
        got = back.groupBy("s", F.col("a").alias("v")).agg(F.sum(F.col("pa") / F.col("pb") * (1 + F.col("share"))).alias("share"))
        share = work.put(wave.join(got, ["s", "v"], "left").select("s", "v", "paths", F.coalesce("share", F.lit(0.0)).alias("share")), "share")
        done = done.unionByName(share)
    return done.filter("s <> v").groupBy(F.col("v").alias("node_id")).agg(F.sum("share").alias("part"))


def reach_strength(g: PropertyGraph) -> DataFrame:
    """``(node_id, strength)``: over all nodes it can reach, the sum of the best path's product of weights.

    Max-product relaxation: a pair's best product only grows while it can.  Weights
    over 1 on a cycle would make it grow for ever, which raises.  A graph within
    ``compact.MOST_EDGES`` is searched from its starts independently; a larger one in
    joins, STARTS_AT_ONCE starts at a time.
    """
    work = Workspace(g.nodes.sparkSession, "strength")
    links = _typed(g, work)
    if _small(links):
        graph = cp.compact(links)

        def run(c: cp.Compact, lot: np.ndarray) -> dict:
            best = cp.best_values(c, lot, product=True)
            best[np.arange(len(lot)) * len(c.ids) + lot] = 0.0
            return {"node_id": c.ids.take(pa.array(lot)), "strength": np.where(np.isfinite(best), best, 0.0).reshape(len(lot), -1).sum(1)}

        sums = _each_start(links, graph, _starts(graph), run, "node_id string, strength double")
    else:
        sums = None
        n = links.select(F.explode(F.array("src", "dst")).alias("v")).distinct().count()
        for lot in _lots(links, work):
            best = front = work.put(lot.select(F.col("src").alias("s"), F.col("src").alias("t"), F.lit(1.0).alias("w")), "best")
            for k in count():
                if k > n:
                    raise ValueError("a cycle of edges improves its own nodes without end")
                step = front.join(links.selectExpr("src AS t", "dst AS u", "w AS w2"), "t").groupBy("s", F.col("u").alias("t")).agg(F.max(F.col("w") * F.col("w2")).alias("w"))
                front = work.put(step.join(best.withColumnRenamed("w", "old"), ["s", "t"], "left").filter("old IS NULL OR w > old").select("s", "t", "w"), "front")
                if front.isEmpty():
                    break
                best, spent = work.put(best.unionByName(front).groupBy("s", "t").agg(F.max("w").alias("w")), "best"), best
                work.drop(spent)
            part = work.put(best.filter("s <> t").groupBy(F.col("s").alias("node_id")).agg(F.sum("w").alias("strength")), "part")
            sums = part if sums is None else sums.unionByName(part)
    return g.nodes.select("node_id").join(sums, "node_id", "left").na.fill(0.0, ["strength"])


def normalise(df: DataFrame, *columns: str) -> DataFrame:
    """The columns scaled to 0..1 over all rows; constant ones become 0."""
    ends = df.agg(*(f(c).alias(f"_{c}_{n}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))))
    out = df.join(F.broadcast(ends))  # one row
    return out.withColumns({c: min_max(F.col(c), F.col(f"_{c}_lo"), F.col(f"_{c}_hi")) for c in columns}).select(*df.columns)


def leverage_index(g: PropertyGraph, weights: dict[str, float] | None = None, max_rounds: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """``(node_id, ord, cascade, cross_field, bottleneck, leverage)``, components normalised."""
    w = weights or WEIGHTS
    work = Workspace(g.nodes.sparkSession, "leverage")  # three metrics read the graph many times: build it once
    g = PropertyGraph(work.put(g.nodes, "nodes"), work.put(g.edges, "edges"))
    parts = (
        g.nodes.select("node_id", "ord")
        .join(cascade_scores(g, max_rounds, tolerance=tolerance).select("node_id", "cascade"), "node_id")
        .join(cross_field_leverage(g).select("node_id", "cross_field"), "node_id")
        .join(bottleneck_centrality(g), "node_id")
    )
    scaled = normalise(work.put(parts, "parts"), *WEIGHTS)
    return scaled.withColumn("leverage", sum((w[c] * F.col(c) for c in WEIGHTS), F.lit(0.0)))


def leaderboard(scores: DataFrame, nodes: DataFrame, top: int = 15) -> DataFrame:
    """The top nodes: ``rank`` from 1, score descending, ties in node order; title cut to 40, first two fields."""
    first = scores.orderBy(F.desc("leverage"), "ord").limit(top)
    shown = nodes.select("node_id", F.substring("title", 1, 40).alias("title"), F.array_join(F.slice(F.coalesce("fields", F.array().cast("array<string>")), 1, 2), ", ").alias("fields"))
    ranked = first.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("leverage"), "ord")))  # at most ``top`` rows
    return ranked.join(shown, "node_id", "left").select("rank", "node_id", "title", "fields", *WEIGHTS, "leverage")
