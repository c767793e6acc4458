import datetime as dt
import io
import json
import tarfile

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from fulcrum.durable import Workspace, shared_dir
from fulcrum.functions import text as tx
from fulcrum.functions.numbers import round_binary
from fulcrum.operators import basics, dedup, extract, maintenance, orphans, sections, similarity, skew
from fulcrum.plans import registry, upkeep
from fulcrum.sources import paged, readers, sinks
from fulcrum.streaming import ingest

REFS = "array<struct<source_type:string,source_id:string,evidence_quote:string>>"


def test_text_scalars(spark):
    df = spark.createDataFrame([("07/15/2023", "2023-07-15", "  Deep LEARNING ", "x" * 201, "x" * 200, "cross_domain", "a.b.c", "  a b ")], "d string, e string, t string, l string, k string, f string, g string, w string")
    r = df.select(tx.year_of_mdy("d"), tx.year_of_mdy("e"), tx.title_key("t"), F.length(tx.clamp_title("l")), tx.clamp_title("l").endswith("..."), F.length(tx.clamp_title("k")), tx.domain("f"), tx.domain("g"), tx.collapse("w"), tx.word_count("w")).first()
    assert tuple(r) == (2023, None, "deep learning", 200, True, 200, "cross_domain", "a", "a b", 2)
    idx = spark.createDataFrame([({"b": [1], "a": [0, 2]},), ({},), (None,), ({"x": [0], "y": [0]},)], "m map<string,array<int>>")
    assert [r[0] for r in idx.select(tx.from_inverted_index("m")).collect()] == ["a b a", "", "", "y"]
    halves = spark.createDataFrame([(0.15,), (0.25,), (0.85,), (None,)], "x double")
    assert [r[0] for r in halves.select(round_binary(F.col("x"), 1)).collect()] == [0.1, 0.2, 0.8, None]


def test_latex_golden(spark):
    text = "preamble\\section{Intro}Short.\\section*{Limitations and Scope}The \\textbf{key} gap is \\cite{x1} data.\n Scale   matters \\alpha for {all} teams, and nobody has built the shared platform that every group needs.\\subsection{Details}Not part of the parent.\\section{Conclusion}Too short.\\section{FUTURE WORK}" + "a" * 100 + "\\section{Outlook}" + "b" * 101
    got = {r.title: r.text for r in sections.latex_sections(spark.createDataFrame([("d", text), ("n", None), ("e", "")], "doc_id string, text string")).collect()}
    assert got == {"Limitations and Scope": "The key gap is x1 data. Scale matters for all teams, and nobody has built the shared platform that every group needs.", "Outlook": "b" * 101}


def test_jats_and_archives(spark):
    body = "word " * 30
    xml = f"<a xmlns='urn:x'><!-- note --><sec sec-type='discussion'><title>Talk</title><p>{body}</p><sec><title>Limitations</title><p>{body}</p></sec></sec><sec><title>Methods</title><p>{body}</p></sec></a>"
    got = {r.title: len(r.text) for r in sections.jats_sections(spark.createDataFrame([(1, xml), (2, "<broken"), (3, None)], "doc_id int, xml string")).collect()}
    assert got == {"Talk": 299, "Limitations": 149}
    buf = io.BytesIO()
    with tarfile.open(fileobj=buf, mode="w:gz") as t:
        for name, text in (("a.tex", "short"), ("b.tex", "longer but no class"), ("c.tex", "\\documentclass{x} the longest one")):
            raw = text.encode()
            info = tarfile.TarInfo(name)
            info.size = len(raw)
            t.addfile(info, io.BytesIO(raw))
    df = spark.createDataFrame([("/x/arxiv:1234.5v2.tar.gz", bytearray(buf.getvalue())), ("/x/bad.gz", bytearray(b"\x1f\x8bnope"))], "path string, content binary")
    assert {r.doc_id: r.text for r in sections.read_archives(df).collect()} == {"1234.5": "\\documentclass{x} the longest one", "bad": ""}


def test_pass_two_golden(spark):
    nodes = spark.createDataFrame([("d", "n1", "Alpha", 0), ("d", "n2", "Beta", 1)], "doc_id string, node_id string, title string, n int")
    raw = [("alpha", "BETA", "ENABLES", False, False, True), ("Alpha", "Gamma", "ENABLES", False, True, True), ("Delta", "Delta", "ENABLES", False, False, True), ("Alpha", "Eps", "BLOCKS", False, False, False), ("Gamma", "Beta", "ENABLES", False, False, False), (None, "Beta", "ENABLES", False, False, True)]
    df = spark.createDataFrame([("d", i, *r) for i, r in enumerate(raw)], "doc_id string, n int, source_title string, target_title string, type string, source_is_new boolean, target_is_new boolean, sound boolean")
    edges, stubs = extract.resolve_titles(df, nodes)
    made = stubs.orderBy("first_n", "first_side").collect()
    assert [(s.title, s.cross_field_ref) for s in made] == [("Gamma", True), ("Delta", False), ("Eps", False)]
    assert sorted((e.source_node_id, e.target_node_id) for e in edges.collect()) == sorted([("n1", "n2"), ("n1", made[0].node_id)])
    assert extract.stub_nodes(stubs).count() == 3


def test_pass_one_rules_and_defaults(spark):
    docs = spark.createDataFrame([("a", "Progress requires a shared platform for everyone. Fine."), ("b", "  "), ("c", None)], "doc_id string, text string")
    rows = extract.pass_one(docs).collect()
    assert [(r.doc_id, r.confidence, r.type) for r in rows] == [("a", 0.6, "capability_gap")]
    odd = lambda _: [{"type": "data_gap", "granularity": "L1", "title": "t" * 300, "description": ""}, {"type": "bad", "granularity": "L1", "title": "x", "description": ""}, {"type": "data_gap", "granularity": "L1", "title": "y", "description": "", "confidence": None}]
    kept = extract.pass_one(docs, odd).collect()
    assert [(len(r.title), r.confidence) for r in kept] == [(200, 0.7)]
    ctx = extract.contexts(docs, extract.pass_one(docs))
    assert ctx.first().titles == ["Progress requires a shared platform for everyone"]


def test_extractors_get_whole_texts(spark):
    filler = "Nothing of note here. " * 400
    text = f"Progress requires a shared platform one. {filler}Progress requires a shared platform two. {filler}Progress requires a shared platform three."
    docs = spark.createDataFrame([("a", text)], "doc_id string, text string")
    titles = [f"Progress requires a shared platform {k}" for k in ("one", "two", "three")]
    nodes = extract.pass_one(docs)
    assert [(r.n, r.title) for r in nodes.orderBy("n").collect()] == list(enumerate(titles))
    ctx = extract.contexts(docs, nodes)
    assert ctx.first().context.startswith(text) and ctx.first().titles == titles
    assert [(r.n, r.source_title) for r in extract.pass_two(ctx).orderBy("n").collect()] == list(enumerate(titles[:2]))
    windowed = extract.pass_one(docs, letters=6_000)
    assert [(r.n, r.title) for r in windowed.orderBy("n").collect()] == list(enumerate(titles))
    sizes = lambda c, t: [{"source_title": t[0], "target_title": c[:9] + str(len(c)), "type": "ENABLES"}, {"source_title": t[0], "target_title": t[1], "type": "ENABLES"}]
    told = [(r.n, r.target_title) for r in extract.pass_two(ctx, sizes, 4_000).orderBy("n").collect()]
    assert [n for n, _ in told] == list(range(len(told))) and sum(t == titles[1] for _, t in told) == 1
    for t in (text, "x" * 25, "", "ab " * 9):
        assert "".join(extract.windows(t, 10)) == t and max(map(len, extract.windows(t, 10))) <= 10


def test_star_clusters_and_merge_golden(spark):
    links = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (5, 6)], "i long, j long")
    stars = {}
    for r in dedup.star_clusters(links).collect():
        stars.setdefault(r.seed, []).append((r.pos, r.member))
    assert [[m for _, m in sorted(v)] for _, v in sorted(stars.items())] == [[0, 1], [2, 1, 3], [5, 6]]
    src = {0: "x", 1: "b", 2: "bc", 3: "a", 5: "d", 6: "de"}
    conf = [0.7, 0.9, 0.9, 0.5, 0.6, 0.8, 0.8, 0.9]
    nodes = spark.createDataFrame([(i, f"n{i}", conf[i], [("paper", c, "") for c in src.get(i, "")]) for i in range(8)], f"ord long, node_id string, confidence double, sources {REFS}")
    for shared, second in ((True, "bcxa"), (False, "bca")):
        rows = dedup.dedup_nodes(nodes, links, shared).orderBy("turn", "place").collect()
        assert [(r.ord, "".join(s.source_id for s in r.sources)) for r in rows] == [(4, ""), (7, ""), (1, "bx"), (2, second), (5, "de")]
    none = spark.createDataFrame([], "i long, j long")
    assert dedup.dedup_nodes(nodes, none).count() == 8
    merged = dedup.merge_clusters(nodes, dedup.star_clusters(links))
    ids = dedup.id_map(nodes, dedup.star_clusters(links), merged)
    edges = spark.createDataFrame([("n0", "n4")], "source_node_id string, target_node_id string")
    assert tuple(dedup.remap_edges(edges, ids).first()) == ("n1", "n4")


def test_stars_by_rounds_equal_the_scan(spark, monkeypatch):
    import random

    rnd = random.Random(4)
    pairs = [(i, i + 1) for i in range(9)] + [(rnd.randint(20, 45), rnd.randint(20, 45)) for _ in range(40)]
    links = spark.createDataFrame(pairs, "i long, j long")
    near = {}
    for i, j in pairs:
        if i != j:
            near.setdefault(i, set()).add(j)
            near.setdefault(j, set()).add(i)
    want, passed = set(), set()
    for i in sorted(near):
        if i not in passed:
            members = [i, *sorted(near[i])]
            want |= {(i, m, k) for k, m in enumerate(members)}
            passed |= set(members)
    for most in (2_000_000, 0):
        monkeypatch.setattr(dedup, "SCAN_PAIRS", most)
        assert {tuple(r) for r in dedup.star_clusters(links).collect()} == want
    with pytest.raises(RuntimeError):
        dedup.star_clusters(links, max_rounds=1)


def _tally(monkeypatch):
    """What is written from now on: a list of (columns, rows)."""
    put, seen = Workspace.put, []

    def counted(self, df, label, *a, **k):
        back = put(self, df, label, *a, **k)
        seen.append((back.columns, back.count()))
        return back

    monkeypatch.setattr(Workspace, "put", counted)
    return seen


def test_stars_write_links_once(spark, monkeypatch):
    links = spark.createDataFrame([(i, j) for c in range(0, 120, 12) for i in range(c, c + 12) for j in range(i + 1, min(i + 5, c + 12))] + [(200, k) for k in range(201, 25_201)], "i long, j long")
    want = {tuple(r) for r in dedup.star_clusters(links).collect()}
    assert {(200, 200 + k, k) for k in range(25_001)} == {w for w in want if w[0] == 200}
    monkeypatch.setattr(dedup, "SCAN_PAIRS", 0)
    seen = _tally(monkeypatch)
    assert {tuple(r) for r in dedup.star_clusters(links).collect()} == want
    assert sum(n for _, n in seen) <= links.count() + len(want)


def test_stars_by_joins_equal_those_by_state(spark, monkeypatch):
    links = spark.createDataFrame([(i, (i * i + 7) % 90) for i in range(90)] + [(3, 3), (1, 2), (2, 1), (None, 4)], "i long, j long")
    want = {tuple(r) for r in dedup.star_clusters(links).collect()}
    monkeypatch.setattr(dedup, "STATE_ROWS", 0)
    assert {tuple(r) for r in dedup.star_clusters(links).collect()} == want


def test_rewritten_edges_need_no_sources(spark, data, monkeypatch):
    seen = _tally(monkeypatch)
    assert upkeep.gr05_problem_dedup(spark, data).count() > 0
    assert not any("sources" in columns for columns, _ in seen)


def test_merges_carry_sources_along_a_long_run(spark):
    """70 clusters, each based on the next one's member: the last base has the sources of all."""
    n = 70
    clusters = spark.createDataFrame([(k, k, 0) for k in range(n)] + [(k, 100 + k, 1) for k in range(n)] + [(k, 99 + k, 2) for k in range(1, n)], "seed long, member long, pos long")
    rows = [(k, f"a{k}", 0.1, []) for k in range(n)] + [(100 + k, f"b{k}", 0.5 + k / 1000, [("paper", f"p{k}", "")]) for k in range(n)]
    nodes = spark.createDataFrame(rows, f"ord long, node_id string, confidence double, sources {REFS}")
    last = dedup.merge_clusters(nodes, clusters.filter("seed < 12")).filter("seed = 11").first()
    assert {s.source_id for s in last.sources} == {f"p{k}" for k in range(12)}


def test_hierarchy_of_long_chains_and_cycles(spark):
    rows = [(f"h{k:03d}", f"h{k - 1:03d}" if k else None) for k in range(71)] + [("x", "y"), ("y", "x"), ("z", "y"), ("s", "s"), ("lone", "gone"), (None, "h000")]
    df = spark.createDataFrame([(a, b, k) for k, (a, b) in enumerate(rows)], "node_id string, parent_id string, ord int")
    got = {r.node_id: (r.root_id, r.depth) for r in maintenance.hierarchy(df).collect()}
    assert got == {f"h{k:03d}": ("h000", k) for k in range(71)} | dict.fromkeys(("x", "y", "z", "s"), (None, None)) | {"lone": ("lone", 0)}
    assert maintenance.hierarchy(df.limit(0)).count() == 0


def test_answers_to_nodes_and_rejects(spark):
    good = {"type": "data_gap", "granularity": "L1", "title": "t" * 201, "description": "d", "evidence_quote": "q" * 600}
    items = [good, good | {"confidence": None}, good | {"confidence": "0.4", "fields": ["a.b"]}, good | {"type": "odd"}, {"type": "data_gap"}, good | {"confidence": "much"}]
    df = spark.createDataFrame([("a", "Sure: " + json.dumps({"nodes": items}) + " ok"), ("b", "no object"), ("c", None), ("d", "{broken"), ("e", "{}")], "doc_id string, answer string")
    ok, bad = extract.nodes_of_answers(df)
    assert [(r.n, r.confidence, len(r.title), r.fields, len(r.sources[0].evidence_quote)) for r in ok.orderBy("n").collect()] == [(0, 0.7, 200, [], 500), (2, 0.4, 200, ["a.b"], 500)]
    assert sorted((r.doc_id, r.n or 0) for r in bad.collect()) == [("a", 1), ("a", 3), ("a", 4), ("a", 5), ("b", 0), ("c", 0), ("d", 0), ("e", 0)]


def test_stubs_name_the_whole_title_and_come_first(spark):
    nodes = spark.createDataFrame([("d", "n1", "Alpha", 0)], "doc_id string, node_id string, title string, n int")
    raw = spark.createDataFrame([("d", 3, "Alpha", "G" * 250, "ENABLES", False, True, True)], "doc_id string, n int, source_title string, target_title string, type string, source_is_new boolean, target_is_new boolean, sound boolean")
    _, stubs = extract.resolve_titles(raw, nodes)
    made = extract.stub_nodes(stubs).first()
    assert made.title == "G" * 200 and made.description == f"Stub node: cross-field reference to '{'G' * 250}'. To be resolved by graph construction."
    assert [r.node_id for r in extract.node_bag(stubs, nodes).orderBy("turn", "place").collect()] == [made.node_id, "n1"]
    with pytest.raises(ValueError):
        extract.of_model("none")
    assert extract.of_model("rules")[0] is extract.rule_nodes


def test_embedder_is_made_once_and_gets_small_batches(spark):
    df = spark.createDataFrame([(k, f"word{k % 3} text") for k in range(150)] + [(200, None), (201, " ")], "id int, t string").coalesce(1)

    def make():
        made = []

        def run(texts):
            made.append(len(texts))
            assert len(texts) <= similarity.EMBED_BATCH
            return [np.array([len(made), len(t)], np.float32) for t in texts]

        return run

    rows = {r.id: r.embedding for r in similarity.embed(df, "t", make).collect()}
    assert rows[200] is None and rows[201] is None and rows[149][0] == 3.0 and rows[0][0] == 1.0
    plain = {r.id: r.embedding for r in similarity.embed(df, "t").collect()}
    assert plain[0] == plain[3] != plain[1]


def test_nearest_seeds_and_gates(spark):
    seeds = spark.createDataFrame([("s1", "Grid storage limits", "Long text one"), ("s2", "Unrelated words here", None)], "node_id string, title string, description string")
    nodes = spark.createDataFrame([("n1", "grid storage limits", "long text one"), ("n2", "Something else", "entirely"), (None, "x", "y")], "node_id string, title string, description string")
    got = {tuple(r) for r in maintenance.integrate_by_nearest(seeds, nodes).collect()}
    assert got == {("s1", "n1", "matched"), ("s2", None, "seed_only"), (None, "n2", "extracted")}
    values = spark.createDataFrame([("n_nodes", 399.0), ("orphan_pct", 15.0), ("other", 1.0)], "metric string, value double")
    assert {r.metric: r.passed for r in maintenance.gate_verdicts(values).collect()} == {"n_nodes": False, "orphan_pct": True}


def test_nearest_texts_meet_the_corpus_where_it_lies(spark, monkeypatch):
    """Queries go out in passes, and the corpus's vectors are neither shuffled nor cogrouped with them."""
    monkeypatch.setattr(similarity, "QUERIES_AT_ONCE", 7, raising=False)
    monkeypatch.setattr(similarity, "nearest", None)
    texts = [f"word{k % 17} other{k % 5} term{k % 11} end{k % 3}" for k in range(300)]
    cut = "node_id string, title string, description string"
    seeds = spark.createDataFrame([(f"s{k:03d}", t, None) for k, t in enumerate(texts[:20])] + [("s900", " ", None), ("s901", "quite apart", None)], cut)
    nodes = spark.createDataFrame([(f"n{k:03d}", t, None) for k, t in enumerate(texts[::-1])] + [("n900", None, None)], cut)
    got = {r.seed_id: r.node_id for r in maintenance.integrate_by_nearest(seeds, nodes).filter("seed_id IS NOT NULL").collect()}
    assert got == {**{f"s{k:03d}": min(f"n{j:03d}" for j, t in enumerate(texts[::-1]) if t == texts[k]) for k in range(20)}, "s900": None, "s901": None}


def test_grants_by_code_takes_pages_in_turn(spark):
    rows = [(f"g{k}", "x" if k % 2 else " ", k, "deep learning" if k < 6 else "pharmacology") for k in range(10)]
    df = spark.createDataFrame(rows, "id string, abstract string, ord int, topic string")
    got = readers.grants_by_code(df, ["pharmacology", "deep learning", "none"], F.col("topic") == F.col("code"), [F.col("ord")], 4, 3)
    assert [(r.code_pos, r.id) for r in got.collect()] == [(0, "g7"), (0, "g9"), (1, "g1")]
    assert readers.search_ids(spark.createDataFrame([("a", "Deep nets", "learning", 2020), ("b", "deep", None, 2024), ("c", "deep", "learning", None)], "id string, title string, abstract string, year int"), "deep learning", 5).collect() == [("a",), ("c",)]


def test_clusters_without_a_shared_folder_raise():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Session:
        conf, sparkContext = Conf(), Context()  # noqa: N815

    with pytest.raises(RuntimeError):
        shared_dir(Session())


def test_large_clusters_are_decided(spark):
    clusters = spark.createDataFrame([(0, m, m) for m in range(2_501)] + [(5_000, 5_000 + m, m) for m in range(2)] + [(6_000, 6_000 + m, m) for m in range(1_001)], "seed long, member long, pos long")
    nodes = clusters.select(F.col("member").alias("ord"), F.concat(F.lit("v"), "member").alias("node_id"), F.concat(F.lit("t"), "member").alias("title"), F.lit("").alias("description"))

    def rule(m):
        assert [x["pos"] for x in m] == list(range(len(m))) == [x["pos"] for x in m] and m[len(m) - 1] == m[-1] == list(m)[-1] and m[1:3] == list(m)[1:3]
        return {"decision": "MERGE" if len(m) == 2 else "HIERARCHY", "canonical_title": m[-1]["title"]}

    got = {r.seed: r for r in dedup.disambiguate(nodes, clusters, rule).collect()}
    assert {k: (r.decision, r.title, r.parent) for k, r in got.items()} == {0: ("HIERARCHY", "t2500", "v0"), 5_000: ("MERGE", "t5001", None), 6_000: ("HIERARCHY", "t7000", "v6000")}
    assert {k: r.children for k, r in got.items()} == {0: [f"v{k}" for k in range(1, 2_501)], 5_000: [], 6_000: [f"v{k}" for k in range(6_001, 7_001)]}


def test_similar_pairs_against_all_pairs(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(120, 8)) + 3 * rng.normal(size=(4, 8))[rng.integers(0, 4, 120)]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(200, None), (201, [0.0] * 8), (202, [float("nan")] + [1.0] * 7)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i, j) for i in range(120) for j in range(i + 1, 120) if u[i] @ u[j] >= 0.9}
    assert {(r.i, r.j) for r in similarity.similar_pairs(df, 0.9, "id").collect()} == want and want
    assert similarity.similar_pairs(df.limit(0), 0.9, "id").count() == 0
    near = similarity.nearest(df.filter("id < 5"), df, 2, "id").filter("rank = 1").collect()
    assert {r.id: r.match for r in near} == {i: int(np.argsort(-(u @ u[i]))[1]) for i in range(5)}


@pytest.mark.parametrize("leaders", [65_536, 300])
def test_similar_pairs_of_spread_vectors_visit_few_parts(spark, monkeypatch, leaders):
    """What is shuffled follows the matches, in whatever slices the leaders are sent."""
    import numpy as np

    monkeypatch.setattr(similarity, "BLOCK_ROWS", 50)
    monkeypatch.setattr(similarity, "LEADERS", leaders, raising=False)
    rng = np.random.default_rng(2)
    x = np.repeat(rng.normal(size=(300, 32)), 3, axis=0) + 0.2 * rng.normal(size=(900, 32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    sent, plain = [], type(df).mapInArrow

    def spy(self, function, schema, *more):
        out = plain(self, function, schema, *more)
        if "owner boolean" in schema:
            sent.append(out)
        return out

    monkeypatch.setattr(type(df), "mapInArrow", spy)
    got = {(r.i, r.j) for r in similarity.similar_pairs(df, 0.85, "id").collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert got == {(i, j) for i, j in zip(*np.nonzero(u @ u.T >= 0.85), strict=True) if i < j} and len(got) > 500
    assert sum(s.count() for s in sent) < 4 * len(x)


def test_stub_rules(spark):
    rows = [("a", 0.9, 0.6), ("b", 0.8, 0.78), ("c", 0.7, 0.6), ("d", 0.82, 0.7), ("e", 0.9, 0.75)]
    df = spark.createDataFrame([(i, k + 1, f"m{k}", s) for i, *sims in rows for k, s in enumerate(sims)], "id string, rank int, match string, sim double")
    assert {r.id: r.decision for r in maintenance.resolve_stubs(df).collect()} == {"a": "resolve", "b": "flag", "c": "promote", "d": "flag", "e": "flag"}


def test_orphans_small(spark):
    t = lambda d: dt.datetime(2025, 1, d)
    nodes = spark.createDataFrame([("A", None, t(1), t(1)), (" b ", "A", t(1), t(9)), ("C", "gone", t(1), t(1)), ("D", "C", t(2), t(2)), (None, None, t(1), t(1))], "node_id string, parent_id string, created_at timestamp_ntz, ingested_at timestamp_ntz")
    seeds = spark.createDataFrame([("s1", t(1))], "node_id string, ingested_at timestamp_ntz")
    tomb = spark.createDataFrame([("a", t(2), None), ("A", t(3), t(4)), ("x", t(1), None)], "node_id string, deleted_at timestamp_ntz, restored_at timestamp_ntz")
    edges = [("e1", "A\t", "b", t(5)), ("e1", "A\t", "b", t(5)), ("e2", "x", "s1", t(5)), ("e3", " ", None, t(5)), ("e4", "zz", "D", t(5))]
    e = spark.createDataFrame([(*r, t(3)) for r in edges], "edge_id string, source_node_id string, target_node_id string, ingested_at timestamp_ntz, created_at timestamp_ntz")
    known = orphans.known_ids([nodes, seeds], tomb)
    got = {(r.record_id, r.side, r.kind) for r in orphans.direct_orphans(orphans.edge_references(e), known, 10).collect()}
    assert got == {("e1", "target", "late"), ("e2", "source", "deleted"), ("e4", "source", "missing")}
    every = {(r.record_id, r.side, r.kind) for r in orphans.all_orphans(nodes, seeds, e, tomb).collect()}
    assert every == got | {("c", "parent", "missing"), ("d", "parent", "inherited"), ("e4", "target", "inherited")}
    assert orphans.all_orphans(nodes.limit(0), seeds.limit(0), e.limit(0), tomb.limit(0)).count() == 0


def test_spread_join_cuts_hot_keys(spark):
    big = spark.createDataFrame([("h", i) for i in range(500)] + [("c", 1), (None, 2)], "k string, v int")
    small = spark.createDataFrame([("h", "x"), ("c", "y")], "k string, w string")
    rows = skew.spread_join(big, small, "k", 502, limit=50).collect()
    assert len(rows) == 502 and sum(r.w == "x" for r in rows) == 500 and [r.w for r in rows if r.k is None] == [None]
    assert sorted(map(str, skew.spread_join(big, small, "k", 502).collect())) == sorted(map(str, rows))


def test_numbering_spreads_groups(spark):
    rows = [("h", i * 7 % 500) for i in range(500)] + [("c", 3), ("c", 1), (None, 5), (None, 4)]
    df = spark.createDataFrame(rows, "k string, v int").repartition(5)
    got = skew.numbered(df, "k", [F.col("v")]).collect()
    assert {(r.k, r.v, r.pos) for r in got} == {("h", i, i) for i in range(500)} | {("c", 1, 0), ("c", 3, 1), (None, 4, 0), (None, 5, 1)}
    assert skew.numbered(df.limit(0), "k", [F.col("v")]).count() == 0


def test_exact_copies(spark):
    df = spark.createDataFrame([(3, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [2.0, 1.0]), (4, None)], "id long, embedding array<double>")
    reps, members = similarity.exact_copies(df, "id")
    assert {r.id for r in reps.filter("embedding IS NOT NULL").collect()} == {1, 2}
    assert {(r.id, r.representative, r.n_copies) for r in members.collect()} == {(1, 1, 2), (3, 1, 2), (2, 2, 1)}


def test_copies_keep_their_links(spark, data, tmp_path):
    """Pairs of representatives and the membership make up the SQL's pairs, a third of the vectors being alike."""
    e = spark.read.parquet(f"{data}/embeddings.parquet").filter("vec_id < 60")
    one = e.filter("vec_id = 7").select(F.col("embedding").alias("same"))
    copied = e.crossJoin(one).withColumn("embedding", F.when(F.col("vec_id") % 3 == 1, F.col("same")).when(F.col("vec_id") == 50, F.transform("same", lambda x: -x)).otherwise(F.col("embedding"))).drop("same")
    copied = copied.unionByName(copied.filter("vec_id = 50").withColumn("vec_id", F.lit(60).cast(copied.schema["vec_id"].dataType)))
    copied.coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    run = lambda q: registry.QUERIES[q](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    members = run("gr01_copies")
    assert {tuple(r) for r in members.collect()} == set(con.execute(registry.SQL["gr01_copies"]).fetchall())
    assert {(r.representative, r.n_copies) for r in members.filter("n_copies > 1").collect()} == {(1, 20), (50, 2)}
    got = similarity.with_copies(run("gr01_jn04_similar_pairs"), members.withColumnRenamed("vec_id", "id")).collect()
    want = con.execute(registry.SQL["gr01_jn04_similar_pairs"]).fetchall()
    assert sorted((r.i, r.j, round(r.sim, 6)) for r in got) == sorted((i, j, round(s, 6)) for i, j, s in want) and len(want) > 190


def test_basics(spark):
    docs = spark.createDataFrame([("A b", 1, "x"), (" a B ", 2, "x"), (None, 3, None), ("", 4, "y")], "title string, ord int, lang string")
    assert sorted(r.ord for r in basics.first_per_title(docs, ["ord"]).collect()) == [1, 3]
    assert {r.phrase: r.n for r in basics.phrase_counts(docs, "title", ("a", "zz")).collect()} == {"a": 2}
    assert tuple(basics.phrase_hit_rate(docs, "title", ("a",)).first()) == (4, 2, 50)
    assert tuple(basics.phrase_hit_rate(docs.limit(0), "title", ("a",)).first()) == (0, 0, 0)
    assert {r.lang: r.n for r in basics.counts_with_total(docs, "lang").collect()} == {"x": 2, "y": 1, "(null)": 1, "TOTAL": 4}


def test_jsonl_quarantine_and_sinks(spark, tmp_path):
    p = tmp_path / "nodes"
    p.mkdir()
    good = {"node_id": "a", "type": "data_gap", "granularity": "L1", "title": "t" * 201, "description": "d"}
    (p / "x.json").write_text("\n".join([json.dumps(good), "", json.dumps(good | {"type": "odd"}), "{broken"]) + "\n")
    ok, bad = readers.read_nodes(spark, str(p))
    assert [(r.node_id, r.confidence, len(r.title), r.status) for r in ok.collect()] == [("a", 0.7, 200, "open")]
    assert bad.count() == 2
    sinks.write_jsonl(ok, str(tmp_path / "out"), single=True)
    assert readers.read_nodes(spark, str(tmp_path / "out"))[0].count() == 1


def test_raw_payloads(spark):
    works = spark.read.schema(readers.WORK).json(spark.sparkContext.parallelize([json.dumps({"id": "w", "title": None, "abstract_inverted_index": {"b": [1], "a": [0]}, "topics": [{"display_name": "T"}], "type": "Review-article", "open_access": {"oa_url": "u"}})]))
    r = readers.works_to_papers(works).first()
    assert (r.title, r.abstract, r.fields, r.is_review, r.oa_url, r.cited_by_count) == ("", "a b", ["T"], True, "u", 0)
    atom = spark.createDataFrame([("<feed><entry><id>http://x/abs/12.3v1</id><title>A\n b</title><summary> s </summary><published>2021-02-03</published></entry><entry><id>none</id></entry></feed>",)], "value string")
    assert [tuple(x)[:4] for x in readers.read_atom(atom).collect()] == [("12.3v1", "A b", "s", 2021)]
    xml = "<Set><PubmedArticle><PMID>7</PMID><ArticleTitle>T <i>x</i></ArticleTitle><AbstractText>a</AbstractText><AbstractText>b</AbstractText><PubDate><Year>2020</Year></PubDate><PublicationType>Review</PublicationType><ArticleId IdType='doi'>10/x</ArticleId></PubmedArticle></Set>"
    m = readers.read_article_sets(spark.createDataFrame([(xml,)], "value string")).first()
    assert (m.id, m.title, m.abstract, m.year, m.is_review, m.doi) == ("7", "T x", "a b", 2020, True, "10/x")
    a = spark.createDataFrame([("1", " t ", " x ", "", "1.5", "01/02/2020"), ("2", "t", "  ", None, None, None)], readers.AWARD_A)
    assert [tuple(x) for x in readers.awards_a_to_grants(a).collect()] == [("1", "t", "x", "NSF", 2020, 1.5, "nsf")]


def test_paged_source_pushes_filters(spark, tmp_path):
    pages = {"first": ([{"id": "a", "n": 1}, {"id": "b", "n": 30}], "p2"), "p2": ([{"id": "c", "n": 40}], None), "p3": ([{"id": "z", "n": 99}], None)}
    for name, (rows, nxt) in pages.items():
        (tmp_path / f"{name}.json").write_text(json.dumps({"results": rows, "meta": {"next_cursor": nxt}}))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(paged.PagedJson)
    df = spark.read.format("paged_json").schema("id string, n int").load(str(tmp_path))
    assert sorted(r.id for r in df.filter("n > 20").collect()) == ["b", "c"]
    (tmp_path / "index.json").write_text(json.dumps({"pages": ["p2", "p3"]}))
    by_uri = spark.read.format("paged_json").schema("id string, n int").load(f"file://{tmp_path}")
    assert sorted(r.id for r in by_uri.collect()) == ["c", "z"]


def test_streams(spark, data, tmp_path):
    events = ingest.stream_table(spark, f"{data}/events.parquet")
    got = ingest.drain(ingest.sessions(events).groupBy("user_id").count() if False else events.select("event_id"), "ev", str(tmp_path / "c"))
    assert got.count() == spark.read.parquet(f"{data}/events.parquet").count()
    batch = ingest.sessions(spark.read.parquet(f"{data}/events.parquet"))
    assert batch.agg(F.sum("n")).first()[0] == got.count()
    seen = []
    e = ingest.new_edges(ingest.stream_table(spark, f"{data}/edges.parquet"), "3650 days")
    ingest.refresh(e, lambda df, k: seen.append(df.count()), str(tmp_path / "d")).awaitTermination()
    assert sum(seen) == spark.read.parquet(f"{data}/edges.parquet").select("edge_id").distinct().count()
