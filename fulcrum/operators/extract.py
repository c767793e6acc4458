"""Two-pass extraction with pluggable extractors, and the resolution of edge titles.

An extractor is a function from a text to node dicts (pass 1), or from a context
and known titles to edge dicts (pass 2).  The built-in ones are rules, so that
results are repeatable; remote models can be plugged in as the same functions.
Extractors get whole texts; ``letters`` names the limit of one that has a limit, and
it then gets consecutive windows that together cover the text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fulcrum.functions.text import REVIEW_PHRASES, clamp_title, or_else, strip
from fulcrum.schemas import EDGE_TYPES, GRANULARITIES, NODE_TYPES

# The prompt limits of the two passes, the quote limit.
PASS1_LETTERS, PASS2_LETTERS, QUOTE_LETTERS = 6_000, 4_000, 500
# What a stub's description says around its title.
STUB_BEFORE, STUB_AFTER = "Stub node: cross-field reference to '", "'. To be resolved by graph construction."
_BREAKS = (re.compile(r"(?<=[.!?])\s+"), re.compile(r"\s+"))
NodeExtractor = Callable[[str], list[dict]]
EdgeExtractor = Callable[[str, list[str]], list[dict]]
_NODE_COLUMNS = "doc_id string, n int, type string, granularity string, title string, description string, confidence double, evidence_quote string, suggested_parent string"
_EDGE_COLUMNS = "doc_id string, n int, source_title string, target_title string, type string, strength double, confidence double, mechanism string, evidence_quote string, source_is_new boolean, target_is_new boolean, sound boolean"


def windows(text: str, letters: int | None) -> list[str]:
    """Consecutive pieces of at most ``letters`` letters that together are the text; one piece without a limit.

    A piece ends behind its last whole sentence, without one behind its last word,
    without one at the limit.
    """
    out, at = [], 0
    while letters and len(text) - at > letters:
        ends = ([m.end() for m in b.finditer(text, at, at + letters)] for b in _BREAKS)
        end = next((e[-1] for e in ends if e), at + letters)
        out.append(text[at:end])
        at = end
    return [*out, text[at:]]


def rule_nodes(text: str) -> list[dict]:
    """A capability gap for each sentence with dependency language."""
    out = []
    for s in re.split(r"(?<=[.!?])\s+", text):
        hit = next((p for p in REVIEW_PHRASES if p in s.lower()), None)
        if hit and len(s) > 20:
            kind = {"bottleneck": "engineering_bottleneck", "lack": "data_gap", "missing": "data_gap"}.get(hit, "capability_gap")
            out.append({"type": kind, "granularity": "L2", "title": s.rstrip(".!?"), "description": s, "confidence": 0.6, "evidence_quote": s})
    return out


def rule_edges(context: str, titles: list[str]) -> list[dict]:
    """Consecutive titles of one document enable each other."""
    return [{"source_title": a, "target_title": b, "type": "ENABLES", "mechanism": "named together"} for a, b in zip(titles, titles[1:], strict=False)]


#: Extractors of both passes by the name of their model; a remote model is added under its own.
MODELS: dict[str, tuple[NodeExtractor, EdgeExtractor]] = {"rules": (rule_nodes, rule_edges)}


def of_model(name: str) -> tuple[NodeExtractor, EdgeExtractor]:
    if name not in MODELS:
        raise ValueError(f"no extractors of model {name!r}; there are {sorted(MODELS)}")
    return MODELS[name]


def section_prompt(title: F.Column, text: F.Column) -> F.Column:  # type: ignore[name-defined]
    """Section texts carry their title, which counts within the limit."""
    return F.left(F.concat(F.lit("[Section: "), title, F.lit("]\n\n"), text), F.lit(PASS1_LETTERS))


def pass_one(docs: DataFrame, extract: NodeExtractor = rule_nodes, id_col: str = "doc_id", text_col: str = "text", letters: int | None = None) -> DataFrame:
    """Raw nodes of every whole text: blank texts are filtered before Python sees them.

    With ``letters`` the extractor gets windows of at most that many letters, blank
    ones left out.  ``n`` numbers a document's nodes over all its windows; a missing confidence is 0.7, a null one makes
    the node invalid, quotes are cut at 500 letters.
    """
    source = docs.filter(strip(F.coalesce(text_col, F.lit(""))) != "").select(F.col(id_col).cast("string"), F.col(text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int32(), *[pa.string()] * 4, pa.float64(), pa.string(), pa.string()]
        names = [c.split()[0] for c in _NODE_COLUMNS.split(", ")]
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for n, g in enumerate(g for w in windows(text, letters) if w.strip() for g in extract(w)):
                    rows.append((doc, n, g.get("type"), g.get("granularity"), g.get("title"), g.get("description"), g.get("confidence", 0.7), (g.get("evidence_quote") or "")[:QUOTE_LETTERS], g.get("suggested_parent")))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    raw = source.mapInArrow(run, _NODE_COLUMNS)
    sound = F.col("type").isin(*NODE_TYPES) & F.col("granularity").isin(*GRANULARITIES) & F.col("title").isNotNull() & F.col("description").isNotNull() & F.col("confidence").isNotNull()
    kept = raw.filter(F.coalesce(sound, F.lit(False)))
    node_id = F.concat(F.lit("temp_"), F.substring(F.sha2(F.concat_ws("\u0001", "doc_id", F.col("n").cast("string"), "title"), 256), 1, 16))
    return kept.withColumns({"title": clamp_title("title"), "node_id": node_id})


def contexts(docs: DataFrame, nodes: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, context, titles, n_letters)`` for pass 2: the whole text, ``n_letters`` long, and a bullet list of its nodes, in order."""
    listed = nodes.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("n", "title", "type"))).alias("x"))  # a text's own nodes: bounded by its length
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text")).join(listed, "doc_id")
    bullets = F.array_join(F.transform("x", lambda e: F.concat(F.lit("- "), e["title"], F.lit(" ("), e["type"], F.lit(")"))), "\n")
    return rows.select("doc_id", F.concat_ws("\n\n", "text", bullets).alias("context"), F.transform("x", lambda e: e["title"]).alias("titles"), F.length("text").alias("n_letters"))


def pass_two(context: DataFrame, extract: EdgeExtractor = rule_edges, letters: int | None = None) -> DataFrame:
    """Raw edges of every context, numbered.

    With ``letters`` the text comes in windows of at most that many letters, each
    followed by all bullets; edges are numbered over all windows, and of edges with
    the same titles and type found in several windows the first counts.  A missing
    strength is 0.5, a missing confidence 0.7, a missing mechanism ''; explicit
    nulls of these make the edge unsound.
    """

    def found(text: str, titles: list[str], size: int) -> Iterator[dict]:
        pieces = windows(text[:size], letters)
        earlier: set = set()
        for w in pieces:
            fresh = [(g, (g.get("source_title"), g.get("target_title"), g.get("type"))) for g in extract(w + text[size:], titles)]
            yield from (g for g, key in fresh if key not in earlier)
            if len(pieces) > 1:
                earlier.update(key for _, key in fresh)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int32(), *[pa.string()] * 3, pa.float64(), pa.float64(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_()]
        names = [c.split()[0] for c in _EDGE_COLUMNS.split(", ")]
        for b in batches:
            rows = []
            for doc, text, titles, size in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                for n, g in enumerate(found(text, titles, size)):
                    s, c, m = g.get("strength", 0.5), g.get("confidence", 0.7), g.get("mechanism", "")
                    sound = None not in (s, c, m) and g.get("type") in EDGE_TYPES
                    rows.append((doc, n, g.get("source_title"), g.get("target_title"), g.get("type"), s, c, m, (g.get("evidence_quote") or "")[:QUOTE_LETTERS], bool(g.get("source_is_new", False)), bool(g.get("target_is_new", False)), sound))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    return context.select("doc_id", "context", "titles", "n_letters").mapInArrow(run, _EDGE_COLUMNS)


def resolve_titles(raw_edges: DataFrame, nodes: DataFrame, group: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Edges between node ids, and the stubs made for titles that name no node.

    ``raw_edges``: group, ``n``, titles, ``type``, ``source_is_new``,
    ``target_is_new``, ``sound``; ``nodes``: group, ``node_id``, ``title``, ``n``.
    Titles match ignoring case, of equal titles the last node counts.  A title
    without a node makes one stub per group, at its first mention (source before
    target), even if its edge is then dropped; the mention's flag becomes its
    ``cross_field_ref``.  Edges that are unsound or loop are dropped; edges that
    lack a title altogether mention nothing.
    """
    known = nodes.groupBy(group, F.lower("title").alias("key")).agg(F.max_by("node_id", "n").alias("node_id"))
    named = raw_edges.filter("source_title IS NOT NULL AND target_title IS NOT NULL")
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("source_title").alias("title"), F.col("source_is_new").alias("is_new")), F.struct(F.lit(1).alias("side"), F.col("target_title").alias("title"), F.col("target_is_new").alias("is_new"))))
    mentions = named.select(group, "n", sides.alias("m")).select(group, "n", "m.*", F.lower("m.title").alias("key"))
    first = F.min(F.struct("n", "side", "title", "is_new"))
    stubs = mentions.join(known, [group, "key"], "left_anti").groupBy(group, "key").agg(first.alias("f"))
    stub_id = F.concat(F.lit("temp_"), F.substring(F.sha2(F.concat_ws("\u0001", F.col(group).cast("string"), "key"), 256), 1, 16))
    stubs = stubs.select(group, "key", stub_id.alias("node_id"), F.left("f.title", F.lit(200)).alias("title"), F.col("f.title").alias("full_title"), F.col("f.n").alias("first_n"), F.col("f.side").alias("first_side"), F.coalesce("f.is_new", F.lit(False)).alias("cross_field_ref"))
    ids = known.unionByName(stubs.select(group, "key", "node_id"))
    src, dst = (ids.select(group, F.col("key").alias(k), F.col("node_id").alias(c)) for k, c in (("_s", "source_node_id"), ("_t", "target_node_id")))
    placed = named.withColumns({"_s": F.lower("source_title"), "_t": F.lower("target_title")}).join(src, [group, "_s"]).join(dst, [group, "_t"]).drop("_s", "_t")
    return placed.filter(F.coalesce("sound", F.lit(False)) & (F.col("source_node_id") != F.col("target_node_id"))), stubs


def stub_nodes(stubs: DataFrame) -> DataFrame:
    """Full node columns of stubs; the description names the whole title."""
    return stubs.select(
        "node_id", F.lit("capability_gap").alias("type"), F.lit("L1").alias("granularity"), "title", F.concat(F.lit(STUB_BEFORE), "full_title", F.lit(STUB_AFTER)).alias("description"),
        F.lit(0.5).alias("confidence"), "cross_field_ref", F.lit("llm_extracted").alias("extraction_method"),
    )


def node_bag(stubs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(doc_id, turn, place, side, node_id, title)``: of every document first its stubs by first mention, then its nodes in order."""
    made = stubs.select("doc_id", F.lit(0).alias("turn"), F.col("first_n").alias("place"), F.col("first_side").alias("side"), "node_id", "title")
    return made.unionByName(nodes.select("doc_id", F.lit(1).alias("turn"), F.col("n").alias("place"), F.lit(0).alias("side"), "node_id", "title"))


def node_objects(text: F.Column) -> F.Column:  # type: ignore[name-defined]
    """The JSON object in a model's answer, from its first ``{`` to its last ``}``; null without one."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def nodes_of_answers(answers: DataFrame, source_type: str = "paper") -> tuple[DataFrame, DataFrame]:
    """Nodes with one source reference from ``(doc_id, answer)``, and the rejects with their text.

    The answer's object holds ``nodes``.  A missing confidence is 0.7, a null or unreadable
    one rejects the node, as do unknown types and levels and missing texts; quotes are cut
    at 500 letters.  Answers without an object hold no nodes and are rejects too.
    """
    raw = "type string, granularity string, title string, description string, fields array<string>, confidence string, evidence_quote string, suggested_parent string"
    parsed = answers.withColumn("_j", node_objects(F.col("answer")))
    items = parsed.select("doc_id", "answer", F.posexplode_outer(F.from_json(F.get_json_object("_j", "$.nodes"), "array<string>")).alias("n", "item"))
    rows = items.withColumn("r", F.from_json("item", raw)).withColumn("has", F.array_contains(F.json_object_keys("item"), "confidence"))
    confidence = F.when(F.col("has"), F.expr("try_cast(r.confidence AS double)")).otherwise(0.7)
    sound = F.col("r.type").isin(*NODE_TYPES) & F.col("r.granularity").isin(*GRANULARITIES) & F.col("r.title").isNotNull() & F.col("r.description").isNotNull() & confidence.isNotNull()
    ref = F.array(F.struct(F.lit(source_type).alias("source_type"), F.col("doc_id").alias("source_id"), F.left(F.coalesce("r.evidence_quote", F.lit("")), F.lit(QUOTE_LETTERS)).alias("evidence_quote")))
    marked = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    good = marked.filter("sound").select("doc_id", "n", "r.type", "r.granularity", clamp_title("r.title").alias("title"), "r.description", F.coalesce("r.fields", F.array().cast("array<string>")).alias("fields"), confidence.alias("confidence"), ref.alias("sources"), "r.suggested_parent")
    return good, marked.filter("NOT sound").select("doc_id", "n", F.coalesce("item", "answer").alias("rejected"))


def source_id(doi: str = "doi", other: str = "id") -> F.Column:  # type: ignore[name-defined]
    """A record's provenance id: the DOI unless empty."""
    return or_else(doi, F.col(other))
