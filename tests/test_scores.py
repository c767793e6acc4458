"""Golden values of the toy graph, and random graphs against plain Python."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fulcrum.operators import compact, graph, scoring
from fulcrum.plans import registry

FIELDS = {"A": ["materials_science.batteries"], "B": ["ai_ml.nlp", "ai_ml.optimization"], "C": ["drug_discovery.general"], "D": ["cross_domain"], "E": [], "F": ["ai_ml.general"]}
EDGES = [("A", "B", "ENABLES", 0.8, 0.9), ("A", "C", "ENABLES", 0.2, 0.5), ("B", "C", "PRODUCES_FOR", 1.0, 0.9), ("C", "D", "ENABLES", 0.5, 0.8), ("A", "B", "PRODUCES_FOR", 0.6, 0.5), ("D", "A", "ENABLES", 0.5, 0.4), ("D", "D", "ENABLES", 1.0, 1.0), ("A", "Z", "ENABLES", 1.0, 1.0), ("B", "D", "ENABLES", 0.4, 0.5), ("D", "E", "ENABLES", 1.0, 1.0)]
NODE = "node_id string, ord long, type string, fields array<string>"
EDGE = "source_node_id string, target_node_id string, type string, strength double, confidence double, ord long"


def make(spark, nodes, edges):
    return graph.build_graph(spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE))


@pytest.fixture(scope="module")
def toy(spark):
    return make(spark, [(n, i, "data_gap", f) for i, (n, f) in enumerate(FIELDS.items())], [(*e, i) for i, e in enumerate(EDGES)])


def column(df, c):
    return {r["node_id"]: r[c] for r in df.collect()}


def test_build_keeps_first_place_and_last_attributes(toy):
    rows = toy.edges.orderBy("ord").collect()
    assert [r.src + r.dst for r in rows] == ["AB", "AC", "BC", "CD", "DA", "BD", "DE"]
    assert (rows[0].type, rows[0].strength) == ("PRODUCES_FOR", 0.6)


def test_stats(toy):
    r = graph.graph_stats(toy).first()
    assert (r.n_nodes, r.n_edges, r.n_orphans, r.orphan_pct, r.n_cross_field) == (6, 7, 1, 16.7, 6)
    assert {x.domain: x.n for x in graph.field_distribution(toy.nodes).collect()} == {"ai_ml": 3, "materials_science": 1, "drug_discovery": 1, "cross_domain": 1}


@pytest.mark.parametrize("most", [2_000_000, 0])
def test_cascade_golden(toy, monkeypatch, most):
    monkeypatch.setattr(compact, "MOST_EDGES", most)
    got = column(scoring.cascade_scores(toy, cut_every=1), "cascade")
    want = {"A": 0.981953, "B": 1.993917, "C": 0.864757, "D": 1.366932, "E": 0, "F": 0}
    assert got == pytest.approx(want, abs=2e-6)
    assert column(scoring.cascade_scores(toy, 1), "cascade") == pytest.approx({"A": 0.4, "B": 1.1, "C": 0.4, "D": 1.2, "E": 0, "F": 0})


def test_cross_field_golden_follows_the_first_path(toy):
    assert column(scoring.cross_field_leverage(toy), "cross_field") == pytest.approx({"A": 0.46, "B": 1.14, "C": 0.504, "D": 0.28, "E": 0, "F": 0})
    best = column(scoring.reach_strength(toy), "strength")
    assert best["A"] > 0.46


def test_bottleneck_golden(toy):
    assert column(scoring.bottleneck_centrality(toy), "bottleneck") == pytest.approx({"A": 0.15, "B": 0.20, "C": 0.25, "D": 0.30, "E": 0, "F": 0})


def test_leverage_golden(toy):
    rows = scoring.leaderboard(scoring.leverage_index(toy), toy.nodes.selectExpr("*", "node_id AS title")).orderBy("rank").collect()
    assert [r.node_id for r in rows] == ["B", "D", "C", "A", "E", "F"]
    assert [r.leverage for r in rows] == pytest.approx([0.916667, 0.632182, 0.536129, 0.467666, 0, 0], abs=2e-6)


def test_no_edges_one_node_and_nothing(spark):
    g = make(spark, [("A", 0, "data_gap", None)], [])
    assert column(scoring.leverage_index(g), "leverage") == {"A": 0}
    empty = make(spark, [], [])
    assert scoring.cascade_scores(empty).count() == 0
    assert graph.graph_stats(empty).first().orphan_pct == 0


def test_diverging_cycle_stops(spark):
    g = make(spark, [("A", 0, "x", []), ("B", 1, "x", [])], [("A", "B", "ENABLES", 2.0, 1.0, 0), ("B", "A", "ENABLES", 2.0, 1.0, 1)])
    r = scoring.cascade_scores(g, 12).first()
    assert (r.rounds, r.converged) == (12, False)


def fifo(nodes, edges):
    """Queue-based search, one start at a time."""
    adj = {}
    for s, t, w in edges:
        adj.setdefault(s, []).append((t, w))
    out = {}
    for start, own in nodes.items():
        seen, queue, best = {start}, [(start, 1.0)], {}
        while queue:
            u, w = queue.pop(0)
            for v, x in adj.get(u, []):
                if v not in seen:
                    seen.add(v)
                    queue.append((v, w * x))
                    for f in {z.split(".")[0] for z in nodes[v]} - {z.split(".")[0] for z in own}:
                        best[f] = max(best.get(f, 0), w * x)
        out[start] = sum(best.values())
    return out


def test_cross_field_random(spark):
    rnd = random.Random(5)
    for _ in range(2):
        n = 9
        nodes = {f"n{i}": rnd.sample(["a.x", "b", "c.y", "a.z"], rnd.randint(0, 2)) for i in range(n)}
        pairs = [(i, j) for i in range(n) for j in range(n) if i != j and rnd.random() < 0.25]
        rnd.shuffle(pairs)
        edges = [(f"n{i}", f"n{j}", rnd.choice([0.25, 0.5, 0.75])) for i, j in pairs]
        g = make(spark, [(k, i, "x", f) for i, (k, f) in enumerate(nodes.items())], [(s, t, "ENABLES", w, 1.0, i) for i, (s, t, w) in enumerate(edges)])
        assert column(scoring.cross_field_leverage(g), "cross_field") == pytest.approx(fifo(nodes, edges))


def test_reach_with_cycle_and_ancestors(toy, spark):
    one = lambda x: spark.createDataFrame([(x,)], "node_id string")
    assert {r.node_id: r.depth for r in graph.reachable(toy.edges, one("A")).collect()} == {"A": 0, "B": 1, "C": 1, "D": 2, "E": 3}
    assert {r.node_id for r in graph.common_ancestors(toy.edges, one("C"), one("E")).collect()} == {"A", "B", "C", "D"} - {"C"} | {"D"}


def betweenness(nodes, edges):
    """Every simple path, one pair at a time; shortest ones share."""
    adj = {}
    for s, t, w in edges:
        adj.setdefault(s, []).append((t, 1 / w))
    out = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        paths, stack = {}, [((s,), 0.0)]
        while stack:
            p, far = stack.pop()
            paths.setdefault(p[-1], []).append((far, p))
            stack += [((*p, v), far + x) for v, x in adj.get(p[-1], []) if v not in p]
        for t in set(paths) - {s}:
            best = [p for far, p in paths[t] if far == min(paths[t])[0]]
            for p in best:
                for v in p[1:-1]:
                    out[v] += 1 / len(best)
    return {v: b / ((len(nodes) - 1) * (len(nodes) - 2)) for v, b in out.items()}


def test_scores_of_the_problem_tables(spark, tmp_path):
    """A cycle through all nodes, so no fixed number of rounds or levels ends the walks."""
    rnd = random.Random(11)
    n = 14
    fields = {f"p{i}": rnd.sample(["a.x", "b", "c.y", "agronomy.z"], rnd.randint(0, 2)) for i in range(n)}
    pairs = [(i, (i + 1) % n) for i in range(n)] + [(i, j) for i in range(n) for j in range(n) if (j - i) % n > 1 and rnd.random() < 0.06]
    rnd.shuffle(pairs)
    edges = [(f"p{i}", f"p{j}", rnd.choice([0.25, 0.5, 1.0]) * (0.5 if i % 2 else 1)) for i, j in pairs]
    spark.createDataFrame([(k, i, "data_gap", k.upper(), f) for i, (k, f) in enumerate(fields.items())], "node_id string, ord long, type string, title string, fields array<string>").write.parquet(str(tmp_path / "nodes.parquet"))
    spark.createDataFrame([(s, t, "ENABLES", w, 1.0, i) for i, (s, t, w) in enumerate(edges)], EDGE).write.parquet(str(tmp_path / "edges.parquet"))
    run = lambda q: registry.QUERIES[q](spark, str(tmp_path))
    score, rounds = dict.fromkeys(fields, 0.0), 0
    while rounds < 100:
        new = {k: sum(w * (1 + (0.85 if rounds else 0) * score[t]) for s, t, w in edges if s == k) for k in fields}
        rounds, move, score = rounds + 1, max(abs(new[k] - score[k]) for k in fields), new
        if move < 1e-7:
            break
    got = run("gr10_cascade_whole_problems")
    assert rounds > 10 and {r.converged for r in got.collect()} == {True}
    assert column(got, "cascade") == pytest.approx(score, abs=1e-4)
    cross, middle = fifo(fields, edges), betweenness(fields, edges)
    assert column(run("gr11_cross_field_problems"), "cross_field") == pytest.approx(cross, abs=1e-6)
    assert column(run("gr12_bottleneck_problems"), "bottleneck") == pytest.approx(middle, abs=1e-8)
    scale = lambda x: {k: (v - min(x.values())) / (max(x.values()) - min(x.values())) for k, v in x.items()}
    a, b, c = scale(score), scale(cross), scale(middle)
    assert column(run("leverage_index_problems"), "leverage") == pytest.approx({k: 0.45 * a[k] + 0.30 * b[k] + 0.25 * c[k] for k in fields}, abs=1e-4)
    best = {(s, t): w for s, t, w in edges}
    for m in fields:
        for s in fields:
            for t in fields:
                if len({s, m, t}) == 3:
                    best[s, t] = max(best.get((s, t), 0), best.get((s, m), 0) * best.get((m, t), 0))
    assert column(run("dg02_reach_strength_problems"), "strength") == pytest.approx({k: sum(w for (s, _), w in best.items() if s == k) for k in fields}, abs=1e-5)
    assert {r.node_id for r in run("q02_roots_of_field_problems").collect()} == set(fields)
    most = sorted(fields, key=lambda k: (-sum(t == k for _, t, _ in edges), k))
    assert column(run("q04_blocks_problems"), "weight") == {s: w for s, t, w in edges if t == most[0]}
    assert {r.node_id for r in run("q05_common_ancestors_problems").collect()} == set(fields) - set(most[:2])


def random_graph(spark, seed, n=11, share=0.2):
    rnd = random.Random(seed)
    nodes = {f"n{i:02d}": rnd.sample(["a.x", "b", "c.y", "a.z"], rnd.randint(0, 2)) for i in range(n)}
    pairs = [(i, j) for i in range(n) for j in range(n) if i != j and rnd.random() < share]
    rnd.shuffle(pairs)
    edges = [(f"n{i:02d}", f"n{j:02d}", rnd.choice([0.25, 0.5, 0.5, 1.0])) for i, j in pairs]
    return nodes, edges, make(spark, [(k, i, "x", f) for i, (k, f) in enumerate(nodes.items())], [(s, t, "ENABLES", w, 1.0, i) for i, (s, t, w) in enumerate(edges)])


def test_large_graphs_are_searched_in_joins_with_the_same_results(spark, monkeypatch):
    nodes, edges, g = random_graph(spark, 8)
    near = [column(scoring.cross_field_leverage(g), "cross_field"), column(scoring.bottleneck_centrality(g), "bottleneck"), column(scoring.reach_strength(g), "strength")]
    assert near[0] == pytest.approx(fifo(nodes, edges)) and near[1] == pytest.approx(betweenness(nodes, edges))
    monkeypatch.setattr(compact, "MOST_EDGES", 0)
    monkeypatch.setattr(scoring, "STARTS_AT_ONCE", 6)
    assert column(scoring.cross_field_leverage(g), "cross_field") == pytest.approx(near[0])
    assert column(scoring.bottleneck_centrality(g), "bottleneck") == pytest.approx(near[1])
    assert column(scoring.reach_strength(g), "strength") == pytest.approx(near[2])


def test_lots_of_starts_change_nothing(spark, monkeypatch):
    import numpy as np

    nodes, edges, g = random_graph(spark, 3, 12)
    c = compact.compact(scoring._typed(g, scoring.Workspace(spark, "t")).withColumn("w", 1 / F.col("w")))
    starts = np.nonzero(np.diff(c.first))[0]
    whole = compact.between(c, starts)
    assert sum(compact.between(c, starts[k : k + 1]) for k in range(len(starts))) == pytest.approx(whole)
    assert dict(zip(c.ids.to_pylist(), whole / (11 * 10), strict=True)) == pytest.approx({k: v for k, v in betweenness(nodes, edges).items() if k in c.ids.to_pylist()})


def drawn(n, m, lengths, seed):
    """A graph of n nodes and about m edges, as ``compact`` makes it."""
    import numpy as np

    rng = np.random.default_rng(seed)
    src, dst = np.unique(rng.integers(0, n, (m, 2)), axis=0).T
    w = rng.choice(np.array(lengths, float), len(src))
    src, dst, w = (x[src != dst] for x in (src, dst, w))
    return compact.Compact(pa.array([f"n{i:03d}" for i in range(n)]), np.concatenate([[0], np.cumsum(np.bincount(src, minlength=n))]), dst.astype(np.int32), w)


@pytest.mark.parametrize("bounds", [{}, {"CLASSES": 1, "WIDE": 3, "BUFFER": 7}, {"CLASSES": 0, "MOST_WAVES": 0}, {"MOST_WIDTHS": 0}])
@pytest.mark.parametrize("lengths", [[1, 2, 4], [1, 1, 3, 1e6], [1, 2.0**-30, 2], [1, 2, float("nan")]])
def test_bottleneck_of_any_lengths_in_rows(monkeypatch, lengths, bounds):
    import numpy as np

    for name, value in bounds.items():
        monkeypatch.setattr(compact, name, value)
    for seed in range(4):
        c = drawn(8, 22, lengths, seed)
        ids, src = c.ids.to_pylist(), np.repeat(np.arange(8), np.diff(c.first))
        edges = [(ids[s], ids[t], 1 / w) for s, t, w in zip(src, c.to, c.weight, strict=True) if w == w]
        want = {k: v * 42 for k, v in betweenness(ids, edges).items()}
        assert dict(zip(ids, compact.between(c, np.nonzero(np.diff(c.first))[0]), strict=True)) == pytest.approx(want, abs=1e-9)


def test_bottleneck_is_quicker_than_following_single_places():
    """All of it takes less than the distances alone did, when every improved place was followed by itself."""
    import time

    import numpy as np

    c = drawn(2_000, 6_500, np.arange(102, 900) / 100, 5)
    starts = np.nonzero(np.diff(c.first))[0][:400]

    def cpu(f):
        began = time.process_time()
        f()
        return time.process_time() - began

    places = min(cpu(lambda: compact.best_values(c, starts, product=False)) for _ in range(2))
    assert min(cpu(lambda: compact.between(c, starts)) for _ in range(2)) < places


def test_sampled_bottleneck_is_not_biased(spark):
    """Three of five leaves lead into the middle of a star, two out of it; all sources sampled gives the exact value."""
    g = make(spark, [(n, i, "x", []) for i, n in enumerate("MABCDE")], [(a, b, "ENABLES", 1.0, 1.0, i) for i, (a, b) in enumerate([("A", "M"), ("B", "M"), ("C", "M"), ("M", "D"), ("M", "E")])])
    exact = column(scoring.bottleneck_centrality(g), "bottleneck")
    assert exact["M"] == pytest.approx(6 / 20)
    assert column(scoring.bottleneck_centrality(g, sources=4), "bottleneck") == pytest.approx(exact)
    assert column(scoring.bottleneck_centrality(g, sources=99), "bottleneck") == pytest.approx(exact)


def test_endless_products_raise(spark):
    g = make(spark, [("A", 0, "x", []), ("B", 1, "x", [])], [("A", "B", "ENABLES", 2.0, 1.0, 0), ("B", "A", "ENABLES", 2.0, 1.0, 1)])
    with pytest.raises(Exception, match="without end"):
        scoring.reach_strength(g).collect()


def test_long_chains_are_followed_to_their_end(spark):
    edges = spark.createDataFrame([(f"c{i:03d}", f"c{i + 1:03d}", "ENABLES") for i in range(70)], "src string, dst string, type string")
    got = graph.reachable(edges, spark.createDataFrame([("c000",)], "node_id string"))
    assert {r.node_id: r.depth for r in got.collect()} == {f"c{i:03d}": i for i in range(71)}


def test_cascade_counts_its_rounds(spark, monkeypatch):
    g = make(spark, [(f"k{i}", i, "x", []) for i in range(7)], [(f"k{i}", f"k{i + 1}", "ENABLES", 0.5, 1.0, i) for i in range(6)])
    for most, cut in ((2_000_000, 4), (0, 1), (0, 3)):
        monkeypatch.setattr(compact, "MOST_EDGES", most)
        r = scoring.cascade_scores(g, cut_every=cut)
        assert {(x.rounds, x.converged) for x in r.collect()} == {(7, True)}
    assert column(r, "cascade")["k5"] == 0.5
