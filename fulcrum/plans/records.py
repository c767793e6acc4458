"""Queries on papers, grants, documents and node records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fulcrum.durable import Workspace
from fulcrum.functions import text as tx
from fulcrum.operators import basics, extract, sections
from fulcrum.operators.skew import numbered, spread_join
from fulcrum.plans.tables import table
from fulcrum.schemas import EDGE, NODE, edge_is_valid, node_is_valid, split_valid
from fulcrum.sources import readers, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

def query(sql: str | None = None):  # noqa: ANN201
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def _strip_sql(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^[\\s\\pZ\\x0B\\x85]+', ''), '[\\s\\pZ\\x0B\\x85]+$', '')"


_WORDS = "CASE WHEN trim(regexp_replace({0}, '[\\s\\pZ\\x0B\\x85]+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace({0}, '[\\s\\pZ\\x0B\\x85]+', ' ', 'g')), ' ')) END"


# --- sources ---


@query("SELECT id, cited_by_count FROM papers WHERE is_review QUALIFY row_number() OVER (ORDER BY cited_by_count DESC, id, ingested_at) <= 50")
def src01_reviews(spark: SparkSession, d: str) -> DataFrame:
    return readers.reviews(table(spark, d, "papers"), 50).select("id", "cited_by_count")


@query("SELECT id, cited_by_count FROM papers WHERE NOT is_review AND cited_by_count > 20 QUALIFY row_number() OVER (ORDER BY cited_by_count DESC, id, ingested_at) <= 50")
def src02_top_cited(spark: SparkSession, d: str) -> DataFrame:
    return readers.top_cited(table(spark, d, "papers"), 50).select("id", "cited_by_count")


@query("SELECT field_tag, label FROM field_taxonomy WHERE contains(lower(label), 'learning') ORDER BY field_tag LIMIT 10")
def src03_topics(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "field_taxonomy").filter(F.lower("label").contains("learning")).orderBy("field_tag").limit(10).select("field_tag", "label")


@query("SELECT DISTINCT id FROM papers WHERE id IN (SELECT s.source_id FROM nodes, unnest(sources) t(s) WHERE s.source_type = 'paper')")
def src07_fetch_by_ids(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "nodes").select(F.explode("sources").alias("s")).filter("s.source_type = 'paper'").select(F.col("s.source_id").alias("id")).distinct()
    return table(spark, d, "papers").select("id").distinct().join(ids, "id", "left_semi")


@query(f"SELECT id, year, amount FROM grants WHERE {_strip_sql('abstract')} <> '' AND source = 'nsf'")
def src10_grants_a(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "grants").filter((F.col("source") == "nsf") & (tx.strip("abstract") != "")).select("id", "year", "amount")


@query(f"SELECT id, year, amount FROM grants WHERE {_strip_sql('abstract')} <> '' AND source = 'nih' AND year BETWEEN 2022 AND 2024")
def src11_grants_b(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "grants").filter((F.col("source") == "nih") & F.col("year").between(2022, 2024) & (tx.strip("abstract") != "")).select("id", "year", "amount")


_TERM_ROWS = f"""WITH t AS (SELECT unnest({[*readers.TERMS["ai_ml"]]!r}) AS term, unnest([0, 1, 2]) AS code_pos),
r AS (SELECT t.code_pos, g.id, g.abstract, row_number() OVER (PARTITION BY t.code_pos ORDER BY g.ingested_at, g.id) AS n FROM t JOIN grants g ON contains(lower(g.title || ' ' || coalesce(g.abstract, '')), t.term) WHERE g.source = 'nih' AND g.year BETWEEN 2022 AND 2024)
SELECT code_pos::INT AS code_pos, id FROM r WHERE n <= 15 AND {_strip_sql("coalesce(abstract, '')")} <> '' ORDER BY code_pos, n LIMIT 20"""


@query(_TERM_ROWS)
def src11_grants_b_by_term(spark: SparkSession, d: str) -> DataFrame:
    """Agency B asked by the search terms of one field: 15 rows a term, blank abstracts dropped, 20 in all."""
    g = table(spark, d, "grants").filter((F.col("source") == "nih") & F.col("year").isin(*readers.YEARS_B))
    by = F.lower(F.concat_ws(" ", "title", "abstract")).contains(F.col("code"))
    return readers.grants_by_code(g, list(readers.TERMS["ai_ml"]), by, [F.col("ingested_at"), F.col("id")], readers.PAGE_B, 20).select("code_pos", "id")


@query("SELECT id FROM papers WHERE source = 'arxiv' ORDER BY ingested_at, id LIMIT 5")
def flt13_first_preprints(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "papers").filter("source = 'arxiv'").orderBy("ingested_at", "id").limit(5).select("id")


_CODES = ", ".join(f"('{f}', '{k}', {n}, '{c}')" for k, codes in (("topic", readers.TOPICS), ("category", readers.CATEGORIES), ("programme", readers.PROGRAMMES), ("term", readers.TERMS)) for f, cs in codes.items() for n, c in enumerate(cs))


@query(f"SELECT field, kind, count(*) AS n, string_agg(code, '|' ORDER BY pos) AS codes FROM (VALUES {_CODES}) t(field, kind, pos, code) GROUP BY 1, 2")
def src16_field_codes(spark: SparkSession, d: str) -> DataFrame:
    """What each field is asked by at each kind of source."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", "code"))), lambda e: e["code"])  # a constant dimension
    return readers.field_codes(spark).groupBy("field", "kind").agg(F.count(F.lit(1)).alias("n"), F.array_join(listed, "|").alias("codes"))


_NODE_OK = "type IN ('knowledge_gap', 'capability_gap', 'data_gap', 'infrastructure_gap', 'theoretical_gap', 'engineering_bottleneck') AND granularity IN ('L0', 'L1', 'L2', 'L3') AND title IS NOT NULL AND description IS NOT NULL AND coalesce(status, 'open') IN ('open', 'partially_resolved', 'resolved', 'obsolete') AND coalesce(extraction_method, 'llm_extracted') IN ('llm_extracted', 'citation_inferred', 'pattern_matched', 'expert_curated') AND len(list_filter(coalesce(sources, []), lambda s: s IS NULL OR s.source_type IS NULL OR s.source_type NOT IN ('paper', 'patent', 'grant', 'curated_list'))) = 0"


@query(f"SELECT CASE WHEN {_NODE_OK} THEN true ELSE false END AS valid, count(*) AS n FROM nodes GROUP BY 1")
def src12_jsonl_nodes(spark: SparkSession, d: str) -> DataFrame:
    """SNK01 and SRC12: nodes written as JSON lines, read back, valid ones and quarantine counted."""
    path = Workspace(spark, "jsonl").root + "/nodes"
    sinks.write_jsonl(table(spark, d, "nodes").select(*[c for c in NODE.names]), path)
    good, bad = readers.read_nodes(spark, path)
    return good.agg(F.count(F.lit(1)).alias("n")).select(F.lit(True).alias("valid"), "n").unionByName(bad.agg(F.count(F.lit(1)).alias("n")).select(F.lit(False).alias("valid"), "n")).filter("n > 0")


@query("SELECT edge_id, type, source_node_id, strength FROM edges WHERE type IN ('ENABLES', 'PRODUCES_FOR') AND source_node_id IS NOT NULL AND target_node_id IS NOT NULL")
def src13_jsonl_edges(spark: SparkSession, d: str) -> DataFrame:
    path = Workspace(spark, "jsonl").root + "/edges"
    sinks.write_jsonl(table(spark, d, "edges").select(*EDGE.names), path)
    return readers.read_edges(spark, path)[0].select("edge_id", "type", "source_node_id", "strength")


@query("SELECT id FROM papers QUALIFY row_number() OVER (ORDER BY ingested_at, id) <= 100")
def src15_sample(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "papers").orderBy("ingested_at", "id").limit(100).select("id")


@query("SELECT 'documents' AS table_name, count(*) AS n FROM documents UNION ALL SELECT 'edges', count(*) FROM edges UNION ALL SELECT 'grants', count(*) FROM grants UNION ALL SELECT 'nodes', count(*) FROM nodes UNION ALL SELECT 'papers', count(*) FROM papers")
def snk06_manifest(spark: SparkSession, d: str) -> DataFrame:
    return basics.manifest({t: table(spark, d, t) for t in ("papers", "grants", "nodes", "edges", "documents")})


# --- projections ---


@query(r"SELECT id, trim(regexp_replace(coalesce(abstract, ''), '[\s\pZ\x0B\x85]+', ' ', 'g')) AS abstract FROM (SELECT id, arg_max(abstract, ingested_at) AS abstract FROM papers GROUP BY id)")
def prj01_inverted_index(spark: SparkSession, d: str) -> DataFrame:
    """Abstracts turned into word -> positions and back."""
    p = table(spark, d, "papers").groupBy("id").agg(F.max_by("abstract", "ingested_at").alias("abstract"))
    words = p.select("id", F.posexplode(F.split(tx.collapse(F.coalesce("abstract", F.lit(""))), " ")).alias("pos", "w")).filter("w <> ''")
    index = words.groupBy("id", "w").agg(F.collect_list("pos").alias("at")).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("w", "at"))).alias("index"))
    return p.select("id").join(index, "id", "left").select("id", tx.from_inverted_index("index").alias("abstract"))


@query("SELECT o_orderkey, year(o_orderdate)::INT AS year FROM orders")
def prj08_year_of_date(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", tx.year_of_mdy(F.date_format("o_orderdate", "MM/dd/yyyy")).alias("year"))


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events")
def prj09_safe_number(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", tx.safe_double(F.get_json_object("props", "$.k")).alias("k"))


@query("SELECT doc_id, md5(substr(coalesce(text, ''), 1, 6000)) AS pass1, md5(substr(coalesce(text, ''), 1, 4000)) AS pass2 FROM documents")
def prj14_truncated(spark: SparkSession, d: str) -> DataFrame:
    """What a remote model with the two prompt limits would get of each text."""
    cut = lambda n: F.md5(F.left(F.coalesce("text", F.lit("")), F.lit(n)))
    return table(spark, d, "documents").select("doc_id", cut(extract.PASS1_LETTERS).alias("pass1"), cut(extract.PASS2_LETTERS).alias("pass2"))


_CTX = "SELECT s.source_id AS doc_id, n.ord, n.title, n.type FROM (SELECT arg_max(struct_pack(s := sources), ingested_at).s AS sources, min(ord) AS ord, any_value(title) AS title, any_value(type) AS type FROM nodes GROUP BY node_id) n, unnest(n.sources) t(s) WHERE s.source_type = 'paper' AND s.source_id IS NOT NULL"


@query(f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ord, title) - 1 AS pos, '- ' || title || ' (' || type || ')' AS line FROM (SELECT DISTINCT * FROM ({_CTX}))")
def prj16_contexts(spark: SparkSession, d: str) -> DataFrame:
    """The bullet list of the nodes drawn from each paper, a line a row: a paper may be the source of a large part of all nodes."""
    once = table(spark, d, "nodes").groupBy("node_id").agg(F.max_by("sources", "ingested_at").alias("sources"), F.min("ord").alias("ord"), F.first("title").alias("title"), F.first("type").alias("type"))
    rows = once.select(F.explode("sources").alias("s"), "ord", "title", "type").filter("s.source_type = 'paper' AND s.source_id IS NOT NULL").select(F.col("s.source_id").alias("doc_id"), "ord", "title", "type").distinct()
    return numbered(rows, "doc_id", [F.col("ord"), F.col("title")]).select("doc_id", "pos", F.concat(F.lit("- "), "title", F.lit(" ("), "type", F.lit(")")).alias("line"))


@query("SELECT DISTINCT id, coalesce(nullif(doi, ''), id) AS source_id FROM papers")
def prj17_source_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "papers").select("id", extract.source_id().alias("source_id")).distinct()


@query("SELECT ord, title || '. ' || coalesce(description, '') AS embedding_text FROM nodes")
def prj18_embedding_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nodes").select("ord", F.concat("title", F.lit(". "), F.coalesce("description", F.lit(""))).alias("embedding_text"))


@query("SELECT ord, CASE WHEN length(title) > 200 THEN substr(title, 1, 197) || '...' ELSE title END AS title FROM nodes")
def prj19_clamped_titles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nodes").select("ord", tx.clamp_title("title").alias("title"))


@query("WITH t AS (SELECT node_id, arg_max(title, ord) AS title FROM nodes WHERE node_id IS NOT NULL GROUP BY 1) SELECT e.ord, coalesce(a.title, e.source_node_id) AS source, coalesce(b.title, e.target_node_id) AS target FROM edges e LEFT JOIN t a ON a.node_id = e.source_node_id LEFT JOIN t b ON b.node_id = e.target_node_id")
def prj21_edge_titles(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "edges").select("ord", "source_node_id", "target_node_id")
    t = table(spark, d, "nodes").filter("node_id IS NOT NULL").groupBy("node_id").agg(F.max_by("title", "ord").alias("t"))
    rows = e.count()
    one = spread_join(e, t.select(F.col("node_id").alias("source_node_id"), F.col("t").alias("a")), "source_node_id", rows)
    two = spread_join(one, t.select(F.col("node_id").alias("target_node_id"), F.col("t").alias("b")), "target_node_id", rows)
    return two.select("ord", F.coalesce("a", "source_node_id").alias("source"), F.coalesce("b", "target_node_id").alias("target"))


# --- filters ---


@query("SELECT doc_id, title, n_letters FROM (SELECT doc_id, trim(split_part(text, chr(10), 1)) AS title, length(trim(regexp_replace(substr(text, strpos(text, chr(10)) + 1), '[\\s\\pZ\\x0B\\x85]+', ' ', 'g'))) AS n_letters FROM documents WHERE contains(text, chr(10))) WHERE length(title) <= 100 AND n_letters > 100 AND regexp_matches(lower(title), 'future work|open problem|limitation|challenge|conclusion|discussion|outlook|unsolved|direction')")
def flt05_signal_sections(spark: SparkSession, d: str) -> DataFrame:
    return sections.line_sections(table(spark, d, "documents"))


@query(f"SELECT ord, CASE WHEN {_NODE_OK} THEN true ELSE false END AS valid FROM nodes")
def flt11_validity(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nodes")
    good, bad = split_valid(n, node_is_valid())
    return good.select("ord", F.lit(True).alias("valid")).unionByName(bad.select("ord", F.lit(False).alias("valid")))


@query("SELECT ord FROM edges WHERE type IN ('ENABLES', 'PRODUCES_FOR') AND source_node_id <> target_node_id")
def flt08_flt09_sound_edges(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "edges").filter(edge_is_valid() & (F.col("source_node_id") != F.col("target_node_id"))).select("ord")


@query("SELECT ord FROM edges WHERE strength * confidence >= 0.15")
def flt16_strong_edges(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "edges").filter(F.col("strength") * F.col("confidence") >= 0.15).select("ord")


# --- aggregates, windows, ranking ---


_ABSTRACTS = "SELECT abstract AS text FROM grants UNION ALL SELECT text FROM documents WHERE doc_kind ILIKE '%grant%'"
_ANY_WORD = " OR ".join(f"contains(lower(coalesce(abstract, '')), '{p}')" for p in tx.REVIEW_PHRASES)


@query(" UNION ALL ".join(f"SELECT '{p}' AS phrase, count(*) AS n FROM ({_ABSTRACTS}) WHERE contains(lower(text), '{p}') HAVING count(*) > 0" for p in tx.GRANT_PHRASES))
def agg14_phrase_counts(spark: SparkSession, d: str) -> DataFrame:
    """Grant abstracts, from both tables that hold any, per phrase."""
    texts = table(spark, d, "grants").select(F.col("abstract").alias("text")).unionByName(table(spark, d, "documents").filter(F.col("doc_kind").ilike("%grant%")).select("text"))
    return basics.phrase_counts(texts, "text", tx.GRANT_PHRASES)


@query(f"SELECT count(*) AS n_texts, count(*) FILTER (WHERE {_ANY_WORD}) AS n_hits, 100 * count(*) FILTER (WHERE {_ANY_WORD}) // greatest(count(*), 1) AS pct FROM papers")
def agg15_phrase_rate(spark: SparkSession, d: str) -> DataFrame:
    return basics.phrase_hit_rate(table(spark, d, "papers"), "abstract", tx.REVIEW_PHRASES)


@query(f"SELECT source, count(*) AS n, count(*) FILTER (WHERE t) AS with_text, 100 * count(*) FILTER (WHERE t) // greatest(count(*), 1) AS pct, (coalesce(sum(w) FILTER (WHERE t), 0) // greatest(count(*) FILTER (WHERE t), 1))::BIGINT AS avg_words FROM (SELECT source, {_strip_sql('coalesce(abstract, chr(32))')} <> '' AS t, {_WORDS.format('coalesce(abstract, chr(32))')} AS w FROM papers) GROUP BY 1")
def agg16_abstract_stats(spark: SparkSession, d: str) -> DataFrame:
    return basics.text_stats(table(spark, d, "papers"), "source", "abstract")


@query("SELECT type, count(*) AS n FROM nodes GROUP BY 1 UNION ALL SELECT 'TOTAL', count(*) FROM nodes")
def agg17_types_with_total(spark: SparkSession, d: str) -> DataFrame:
    return basics.counts_with_total(table(spark, d, "nodes"), "type")


@query(f"SELECT field, count(*) AS n, count(*) FILTER (WHERE {_strip_sql('coalesce(abstract, chr(32))')} <> '') AS with_text FROM (SELECT unnest(CASE WHEN len(coalesce(fields, [])) > 0 THEN fields ELSE ['unknown'] END) AS field, abstract FROM papers) GROUP BY 1")
def agg18_papers_per_field(spark: SparkSession, d: str) -> DataFrame:
    return basics.per_field(table(spark, d, "papers"), "abstract")


@query("SELECT field, pos, id FROM (SELECT field, id, row_number() OVER (PARTITION BY field ORDER BY ingested_at, id) AS pos FROM (SELECT unnest(fields) AS field, id, ingested_at FROM papers))")
def agg20_papers_by_field(spark: SparkSession, d: str) -> DataFrame:
    """Papers listed per field in ingest order, one row each."""
    rows = table(spark, d, "papers").select(F.explode("fields").alias("field"), "id", "ingested_at")
    return numbered(rows, "field", [F.col("ingested_at"), F.col("id")]).select("field", (F.col("pos") + 1).alias("pos"), "id")


@query(f"SELECT key AS title_key, id FROM (SELECT substr({_strip_sql('lower(title)')}, 1, 60) AS key, id, row_number() OVER (PARTITION BY substr({_strip_sql('lower(title)')}, 1, 60) ORDER BY ingested_at, id) AS k FROM papers) WHERE k = 1")
def win01_title_dedup(spark: SparkSession, d: str) -> DataFrame:
    return basics.first_per_title(table(spark, d, "papers").select("ingested_at", "id", "title"), ["ingested_at", "id"]).select("title_key", "id")


@query("WITH h AS (SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM documents WHERE lang IS NOT NULL) WHERE k <= 3), r AS (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM h) ORDER BY doc_id LIMIT 40), a AS (SELECT doc_id, 0 AS turn FROM h UNION ALL SELECT doc_id, 1 FROM r) SELECT doc_id, pick FROM (SELECT doc_id, turn, row_number() OVER (ORDER BY turn, doc_id)::INT AS pick FROM a) WHERE turn = 0 OR pick <= 40")
def win05_diverse_pick(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("place", F.col("doc_id"))
    return basics.pick_diverse(docs, "lang", "doc_id", "place", 3, 40)


@query("SELECT type, confidence_rank, node_id FROM (SELECT type, node_id, row_number() OVER (PARTITION BY type ORDER BY confidence DESC, node_id)::INT AS confidence_rank FROM (SELECT type, node_id, max(confidence) AS confidence FROM nodes WHERE confidence BETWEEN 0 AND 1 GROUP BY 1, 2)) WHERE confidence_rank <= 5")
def srt08_top_per_type(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nodes").filter("confidence BETWEEN 0 AND 1").groupBy("type", "node_id").agg(F.max("confidence").alias("confidence"))
    return basics.top_per_group(n, "type", [F.desc("confidence"), F.col("node_id")], 5).select("type", F.col("rank").alias("confidence_rank"), "node_id")


@query("SELECT phrase, n FROM (" + SQL["agg14_phrase_counts"] + ") ORDER BY n DESC, phrase LIMIT 10")
def srt06_top_phrases(spark: SparkSession, d: str) -> DataFrame:
    return agg14_phrase_counts(spark, d).orderBy(F.desc("n"), "phrase").limit(10)


@query("SELECT source, count(*) AS n FROM (SELECT source FROM papers UNION ALL SELECT source FROM grants) GROUP BY 1")
def set01_bag_union(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "papers").select("source").unionByName(table(spark, d, "grants").select("source")).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p.id, count(DISTINCT n.node_id) AS n_nodes FROM (SELECT DISTINCT id FROM papers) p LEFT JOIN (SELECT node_id, s.source_id FROM nodes, unnest(sources) t(s) WHERE s.source_type = 'paper') n ON n.source_id = p.id GROUP BY 1")
def jn07_nodes_of_papers(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nodes").select("node_id", F.explode("sources").alias("s")).filter("s.source_type = 'paper'").select("node_id", F.col("s.source_id").alias("id")).distinct().groupBy("id").agg(F.count("node_id").alias("n_nodes"))
    return table(spark, d, "papers").select("id").distinct().join(n, "id", "left").na.fill(0, ["n_nodes"])


@query("SELECT f AS field_tag, coalesce(t.domain, '(unknown)') AS domain, count(*) AS n FROM (SELECT unnest(fields) AS f FROM nodes) x LEFT JOIN field_taxonomy t ON t.field_tag = x.f WHERE f IS NOT NULL GROUP BY 1, 2")
def jn10_field_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Tags against the canonical list: grouped first, so the join sees each tag once."""
    tags = table(spark, d, "nodes").select(F.explode("fields").alias("field_tag")).filter("field_tag IS NOT NULL").groupBy("field_tag").agg(F.count(F.lit(1)).alias("n"))
    return tags.join(F.broadcast(table(spark, d, "field_taxonomy").select("field_tag", "domain")), "field_tag", "left").select("field_tag", F.coalesce("domain", F.lit("(unknown)")).alias("domain"), "n")


# --- extraction ---


_SPACE = r"[\s\pZ\x0B\x85\x1c-\x1f]"
_RULE = f"""WITH s0 AS (SELECT doc_id::VARCHAR AS doc_id, string_split(regexp_replace(text, '([.!?]){_SPACE}+', '\\1' || chr(57344), 'g'), chr(57344)) AS l FROM documents WHERE {_strip_sql("coalesce(text, '')")} <> ''),
s1 AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS k, unnest(l) AS s FROM s0),
s2 AS (SELECT *, list_filter({[*tx.REVIEW_PHRASES]!r}, lambda p: contains(lower(s), p))[1] AS hit FROM s1 WHERE length(s) > 20),
s3 AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS n, CASE hit WHEN 'bottleneck' THEN 'engineering_bottleneck' WHEN 'lack' THEN 'data_gap' WHEN 'missing' THEN 'data_gap' ELSE 'capability_gap' END AS type,
  regexp_replace(s, '[.!?]+$', '') AS full_title FROM s2 WHERE hit IS NOT NULL),
rn AS (SELECT doc_id, n::INT AS n, type, CASE WHEN length(full_title) > 200 THEN substr(full_title, 1, 197) || '...' ELSE full_title END AS title,
  'temp_' || substr(sha256(doc_id || chr(1) || n || chr(1) || full_title), 1, 16) AS node_id FROM s3)"""


@query(_RULE + " SELECT doc_id, n, type, title, node_id FROM rn")
def udf01_rule_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Pass 1 over all documents by the rule extractor."""
    return extract.pass_one(table(spark, d, "documents")).select("doc_id", "n", "type", "title", "node_id")


_RULE_EDGES = _RULE + """,
e0 AS (SELECT doc_id, n, title AS a, lead(title) OVER (PARTITION BY doc_id ORDER BY n) AS b FROM rn), known AS (SELECT doc_id, lower(title) AS key, arg_max(node_id, n) AS node_id FROM rn GROUP BY 1, 2)
SELECT e.doc_id, e.n, 'ENABLES' AS type, s.node_id AS source_node_id, t.node_id AS target_node_id, 0.5::DOUBLE AS strength, 0.7::DOUBLE AS confidence
FROM e0 e JOIN known s ON s.doc_id = e.doc_id AND s.key = lower(e.a) JOIN known t ON t.doc_id = e.doc_id AND t.key = lower(e.b) WHERE s.node_id <> t.node_id"""


@query(_RULE_EDGES)
def udf02_rule_edges(spark: SparkSession, d: str) -> DataFrame:
    """Pass 2 over all documents, titles resolved."""
    docs = table(spark, d, "documents")
    nodes = Workspace(spark, "extract").put(extract.pass_one(docs), "nodes")
    edges, _ = extract.resolve_titles(extract.pass_two(extract.contexts(docs, nodes)), nodes)
    return edges.select("doc_id", "n", "type", "source_node_id", "target_node_id", "strength", "confidence")


_TITLES = """WITH pairs AS (SELECT 10 * l_orderkey + l_linenumber AS n, p_name AS source_title, s_name AS target_title FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey),
known AS (SELECT lower(p_name) AS key, arg_max('part_' || p_partkey, p_partkey) AS node_id FROM part WHERE p_partkey % 3 > 0 GROUP BY 1),
m AS (SELECT n, 0 AS side, source_title AS t FROM pairs UNION ALL SELECT n, 1, target_title FROM pairs),
st AS (SELECT key, 'temp_' || substr(sha256('orders' || chr(1) || key), 1, 16) AS node_id, arg_min(t, 2 * n + side) AS title, min(2 * n + side) AS place FROM (SELECT n, side, t, lower(t) AS key FROM m) WHERE key NOT IN (SELECT key FROM known) GROUP BY 1),
ids AS (SELECT key, node_id FROM known UNION ALL SELECT key, node_id FROM st)"""


def _resolved(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Titles of parts and suppliers, an edge for each line item, against two thirds of the parts."""
    part, sup = table(spark, d, "part").select("p_partkey", "p_name"), table(spark, d, "supplier").select("s_suppkey", "s_name")
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    rows = li.join(part, F.col("l_partkey") == F.col("p_partkey")).join(sup, F.col("l_suppkey") == F.col("s_suppkey"))
    raw = rows.select(F.lit("orders").alias("doc_id"), (10 * F.col("l_orderkey") + F.col("l_linenumber")).alias("n"), F.col("p_name").alias("source_title"), F.col("s_name").alias("target_title"), F.lit("ENABLES").alias("type"), F.lit(False).alias("source_is_new"), F.lit(True).alias("target_is_new"), F.lit(True).alias("sound"))
    nodes = part.filter("p_partkey % 3 > 0").select(F.lit("orders").alias("doc_id"), F.concat(F.lit("part_"), "p_partkey").alias("node_id"), F.col("p_name").alias("title"), F.col("p_partkey").alias("n"))
    return (*extract.resolve_titles(raw, nodes), nodes)


@query(_TITLES + " SELECT n, s.node_id AS source_node_id, t.node_id AS target_node_id FROM pairs JOIN ids s ON s.key = lower(source_title) JOIN ids t ON t.key = lower(target_title) WHERE s.node_id <> t.node_id")
def jn01_jn02_title_resolution(spark: SparkSession, d: str) -> DataFrame:
    return _resolved(spark, d)[0].select("n", "source_node_id", "target_node_id")


@query(_TITLES + " SELECT node_id, title, 'Stub node: cross-field reference to ' || chr(39) || title || chr(39) || '. To be resolved by graph construction.' AS description, place % 2 = 1 AS cross_field_ref FROM st")
def prj13_stubs(spark: SparkSession, d: str) -> DataFrame:
    return extract.stub_nodes(_resolved(spark, d)[1]).select("node_id", "title", "description", "cross_field_ref")


@query(_TITLES + " SELECT 0 AS turn, place // 2 AS place, (place % 2)::INT AS side, node_id FROM st UNION ALL SELECT 1, p_partkey, 0, 'part_' || p_partkey FROM part WHERE p_partkey % 3 > 0")
def set02_node_bag(spark: SparkSession, d: str) -> DataFrame:
    """Stubs by first mention, then nodes."""
    _, stubs, nodes = _resolved(spark, d)
    return extract.node_bag(stubs, nodes).select("turn", "place", "side", "node_id")


@query("SELECT ord AS doc_id, 0 AS n, type, granularity, CASE WHEN length(title) > 200 THEN substr(title, 1, 197) || '...' ELSE title END AS title, CASE WHEN confidence IS NULL THEN 0.7 ELSE confidence END AS confidence FROM nodes WHERE type IN ('knowledge_gap', 'capability_gap', 'data_gap', 'infrastructure_gap', 'theoretical_gap', 'engineering_bottleneck') AND granularity IN ('L0', 'L1', 'L2', 'L3') AND title IS NOT NULL AND description IS NOT NULL AND (confidence IS NULL OR NOT isnan(confidence))")
def prj11_answers(spark: SparkSession, d: str) -> DataFrame:
    """Nodes as a model's answers, prose around a JSON object, parsed again; absent confidences take the default."""
    n = table(spark, d, "nodes").filter("confidence IS NULL OR NOT isnan(confidence)")
    item = F.struct("type", "granularity", "title", "description", "confidence")
    answer = F.concat(F.lit("Here it is:\n"), F.to_json(F.struct(F.array(item).alias("nodes"))), F.lit("\nDone."))
    good, _ = extract.nodes_of_answers(n.select(F.col("ord").alias("doc_id"), answer.alias("answer")))
    return good.select("doc_id", "n", "type", "granularity", "title", "confidence")
