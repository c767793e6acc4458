"""Queries that turn records into raw payloads or files and read them back, and small projections and joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fulcrum.durable import Workspace
from fulcrum.functions import text as tx
from fulcrum.operators import dedup, extract, sections, similarity
from fulcrum.plans.tables import PROBLEM_SQL, problem_graph, table
from fulcrum.plans.upkeep import _links, _stars_sql, _vector_nodes
from fulcrum.sources import readers, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):  # noqa: ANN201
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return keep


_COLLAPSE = r"trim(regexp_replace({0}, '[\s\pZ\x0B\x85]+', ' ', 'g'))"
_TITLE = "CASE WHEN title IS NULL THEN '' ELSE title END"


def _newest_papers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "papers").groupBy("id").agg(F.max_by(F.struct("title", "abstract", "doi", "year", "cited_by_count", "fields", "is_review", "oa_url"), "ingested_at").alias("r")).select("id", "r.*")


_NEWEST = "SELECT id, arg_max(struct_pack(title, abstract, doi, year, cited_by_count, fields, is_review, oa_url), ingested_at) AS r FROM papers GROUP BY id"


@query(f"SELECT id, {_TITLE} AS title, year, coalesce(cited_by_count, 0) AS cited_by_count, is_review, oa_url, len(coalesce(fields, [])) AS n_fields FROM (SELECT id, r.* FROM ({_NEWEST}))")
def prj02_works(spark: SparkSession, d: str) -> DataFrame:
    """Papers as raw works in JSON, parsed to papers again."""
    p = _newest_papers(spark, d)
    topics = F.transform(F.coalesce("fields", F.array().cast("array<string>")), lambda f: F.struct(f.alias("display_name")))
    raw = p.select(F.to_json(F.struct("id", "title", F.col("year").alias("publication_year"), "cited_by_count", topics.alias("topics"), F.when(F.col("is_review"), "Review").otherwise("article").alias("type"), F.struct("oa_url").alias("open_access"))).alias("j"))
    w = readers.works_to_papers(raw.select(F.from_json("j", readers.WORK).alias("w")).select("w.*"))
    return w.select("id", "title", "year", "cited_by_count", "is_review", "oa_url", F.size("fields").cast("long").alias("n_fields"))


_ESCAPED = "replace(replace(title, '&', '&amp;'), '<', '&lt;')"


def _escaped(c: str) -> F.Column:  # type: ignore[name-defined]
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


@query(f"SELECT id, {_COLLAPSE.format(_ESCAPED)} AS title, {_COLLAPSE.format(_ESCAPED.replace('title', 'coalesce(abstract, chr(32))'))} AS abstract, year FROM (SELECT id, r.* FROM ({_NEWEST}))")
def prj03_src04_atom(spark: SparkSession, d: str) -> DataFrame:
    """Papers as a preprint feed, one entry a page, parsed again; escapes stay as they stand in the feed."""
    p = _newest_papers(spark, d)
    page = F.concat(F.lit("<feed>\n<entry><id>http://x/abs/"), "id", F.lit("</id><title type='text'>\n"), _escaped("title"), F.lit("\n</title><summary> "), _escaped(F.coalesce("abstract", F.lit(" "))), F.lit(" </summary><published>"), F.coalesce(F.col("year").cast("string"), F.lit("none")), F.lit("-01-01</published></entry></feed>"))
    return readers.read_atom(p.select(page.alias("value"))).select("id", "title", "abstract", "year")


@query(f"SELECT id, {_COLLAPSE.format('title')} AS title, year, is_review, nullif(doi, '') AS doi, len(coalesce(fields, []))::INT AS n_fields FROM (SELECT id, r.* FROM ({_NEWEST}))")
def prj04_src06_articles(spark: SparkSession, d: str) -> DataFrame:
    """Papers as article sets in XML, parsed by XPath."""
    p = _newest_papers(spark, d)
    year = F.coalesce(F.concat(F.lit("<PubDate><Year>"), F.col("year").cast("string"), F.lit("</Year></PubDate>")), F.lit(""))
    doi = F.coalesce(F.concat(F.lit("<ArticleId IdType='doi'>"), _escaped("doi"), F.lit("</ArticleId>")), F.lit(""))
    headings = F.array_join(F.transform(F.coalesce("fields", F.array().cast("array<string>")), lambda f: F.concat(F.lit("<MeshHeading><DescriptorName>"), _escaped(f), F.lit("</DescriptorName></MeshHeading>"))), "")
    xml = F.concat(F.lit("<S><PubmedArticle><PMID>"), "id", F.lit("</PMID><ArticleTitle>"), _escaped("title"), F.lit("</ArticleTitle>"), year, doi, headings, F.when(F.col("is_review"), "<PublicationType>Systematic Review</PublicationType>").otherwise(""), F.lit("</PubmedArticle></S>"))
    return readers.read_article_sets(p.select(xml.alias("value"))).select("id", "title", "year", "is_review", "doi", F.size("fields").alias("n_fields"))


_FOUND = "SELECT id FROM (SELECT id, max(year) AS year FROM papers WHERE contains(lower(concat_ws(' ', title, abstract)), 'learning') AND contains(lower(concat_ws(' ', title, abstract)), 'limited') GROUP BY 1) ORDER BY year DESC NULLS LAST, id LIMIT 20"


@query(_FOUND)
def src06_src08_search(spark: SparkSession, d: str) -> DataFrame:
    """A search that finds nothing gives way to a simpler one."""
    p = table(spark, d, "papers")
    return readers.first_non_empty(readers.search_ids(p, "learning limited qqqq", 20), lambda: readers.search_ids(p, "learning limited", 20))


_XML_TEXT = r"regexp_replace(text, '[\x00-\x1f\x{FFFE}\x{FFFF}]', ' ', 'g')"


@query(f"SELECT doc_id, 'Future perspectives' AS title, length(body)::INT AS n_letters FROM (SELECT doc_id, {_COLLAPSE.format(_XML_TEXT)} AS body FROM documents WHERE text IS NOT NULL AND origin_id IN (SELECT id FROM papers)) WHERE length(body) > 100")
def src09_prj05_full_texts(spark: SparkSession, d: str) -> DataFrame:
    """Documents of known papers as JATS records, fetched by the papers' ids, their signal sections parsed."""
    ids = table(spark, d, "papers").select(F.col("id").alias("origin_id")).distinct()
    docs = table(spark, d, "documents").filter("text IS NOT NULL").join(ids, "origin_id", "left_semi")
    body = _escaped(F.regexp_replace("text", "[\\x00-\\x1f\\uFFFE\\uFFFF]", " "))
    xml = F.concat(F.lit("<article xmlns='urn:x'><body><sec><title>Methods</title><p>none</p></sec><sec><title>Future perspectives</title><p>"), body, F.lit("</p></sec></body></article>"))
    got = sections.jats_sections(docs.select("doc_id", xml.alias("xml")))
    return got.select("doc_id", "title", F.length("text").alias("n_letters"))


_AWARD = "SELECT id, trim(title) AS title, year, amount, '{0}' AS source FROM grants WHERE source = '{0}' AND trim(abstract, chr(9) || chr(10) || chr(13) || ' ') <> ''"


@query(_AWARD.format("nsf"))
def prj10_awards(spark: SparkSession, d: str) -> DataFrame:
    """Grants of agency A as raw awards in JSON, with the date as MM/DD/YYYY and the amount as text, parsed again."""
    g = table(spark, d, "grants").filter("source = 'nsf'")
    raw = g.select(F.to_json(F.struct("id", "title", F.col("abstract").alias("abstractText"), "agency", F.col("amount").cast("string").alias("fundsObligatedAmt"), F.concat(F.lit("07/01/"), F.col("year").cast("string")).alias("date"))).alias("j"))
    return readers.awards_a_to_grants(raw.select(F.from_json("j", readers.AWARD_A).alias("a")).select("a.*")).select("id", "title", "year", "amount", "source")


@query(_AWARD.format("nih"))
def prj10_awards_b(spark: SparkSession, d: str) -> DataFrame:
    """Grants of agency B as raw projects in JSON, parsed again."""
    g = table(spark, d, "grants").filter("source = 'nih'")
    raw = g.select(F.to_json(F.struct(F.col("id").alias("project_num"), F.col("title").alias("project_title"), F.col("abstract").alias("abstract_text"), F.struct(F.col("agency").alias("name")).alias("agency_ic_admin"), F.col("year").alias("fiscal_year"), F.col("amount").cast("string").alias("award_amount"))).alias("j"))
    return readers.awards_b_to_grants(raw.select(F.from_json("j", readers.AWARD_B).alias("b")).select("b.*")).select("id", "title", "year", "amount", "source")


@query("SELECT doc_id, 'Limitations' AS title, length(body)::INT AS n_letters FROM (SELECT doc_id, " + _COLLAPSE.format("regexp_replace(text, '[\\\\{}]', ' ', 'g')") + " AS body FROM documents WHERE text IS NOT NULL) WHERE length(body) > 100")
def prj06_latex(spark: SparkSession, d: str) -> DataFrame:
    """Every document as the body of a LaTeX section between two that are no signals."""
    body = F.regexp_replace("text", r"[\\{}]", " ")
    tex = F.concat(F.lit("pre \\section{Methods}none\\section*{Limitations}"), body, F.lit("\\subsection{Details}x"))
    docs = table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", tex.alias("text"))
    return sections.latex_sections(docs).select("doc_id", "title", F.length("text").alias("n_letters"))


@query("SELECT doc_id, substr('[Section: ' || source || ']' || chr(10) || chr(10) || text, 1, 6000) AS prompt FROM documents WHERE source IS NOT NULL AND text IS NOT NULL")
def prj15_section_prompts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("source IS NOT NULL AND text IS NOT NULL").select("doc_id", extract.section_prompt(F.col("source"), F.col("text")).alias("prompt"))


@query("SELECT node_id, title[1:40] AS title, coalesce(array_to_string(fields[1:2], ', '), '') AS fields FROM (SELECT node_id, any_value(title) AS title, arg_max(struct_pack(f := fields), ord).f AS fields FROM nodes GROUP BY node_id)")
def prj20_display(spark: SparkSession, d: str) -> DataFrame:
    n = problem_graph(spark, d).nodes
    return n.select("node_id", F.substring("title", 1, 40).alias("title"), F.array_join(F.slice(F.coalesce("fields", F.array().cast("array<string>")), 1, 2), ", ").alias("fields"))


@query("SELECT source, count(*) AS n FROM papers GROUP BY 1")
def src14_snk03_stages(spark: SparkSession, d: str) -> DataFrame:
    """Papers staged once, then read from the stage."""
    path = Workspace(spark, "stages").root + "/papers"
    readers.staged_or(spark, path, lambda: table(spark, d, "papers"))
    return readers.staged_or(spark, path, lambda: table(spark, d, "papers").limit(0)).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT source, agency, count(*) AS n FROM grants WHERE source IS NOT NULL GROUP BY 1, 2")
def snk04_samples(spark: SparkSession, d: str) -> DataFrame:
    """Grants written as JSON lines in a folder per source, read back with the folder as column."""
    path = Workspace(spark, "samples").root + "/grants"
    sinks.write_samples(table(spark, d, "grants").select("id", "agency", "source").filter("source IS NOT NULL"), path, "source")
    return spark.read.schema("id string, agency string, source string").json(path).groupBy("source", "agency").agg(F.count(F.lit(1)).alias("n"))


@query("WITH RECURSIVE" + PROBLEM_SQL + " SELECT src, dst, round(strength * confidence, 9) AS weight FROM ge")
def snk06_edge_list(spark: SparkSession, d: str) -> DataFrame:
    path = Workspace(spark, "edge_list").root + "/edges"
    sinks.write_edge_list(problem_graph(spark, d).edges, path)
    return spark.read.schema("src string, dst string, weight double").option("sep", "\t").csv(path).select("src", "dst", F.round("weight", 9).alias("weight"))


@query("SELECT ord FROM edges WHERE source_node_id IN (SELECT node_id FROM nodes) AND target_node_id IN (SELECT node_id FROM nodes)")
def jn03_known_ends(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "nodes").select("node_id").distinct()
    e = table(spark, d, "edges").select("ord", "source_node_id", "target_node_id")
    return e.join(ids.withColumnRenamed("node_id", "source_node_id"), "source_node_id", "left_semi").join(ids.withColumnRenamed("node_id", "target_node_id"), "target_node_id", "left_semi").select("ord")


@query(_stars_sql() + " SELECT count(DISTINCT seed) AS n_clusters, count(DISTINCT member) AS n_members, count(*) - count(DISTINCT member) AS n_overlaps, count(DISTINCT member) - count(DISTINCT seed) AS reduction FROM placed")
def agg19_cluster_totals(spark: SparkSession, d: str) -> DataFrame:
    c = dedup.star_clusters(_links(spark, d).select("i", "j"))
    per_member = c.groupBy("member").agg(F.count(F.lit(1)).alias("k"), F.max((F.col("pos") == 0).cast("int")).alias("seed"))
    got = per_member.agg(F.sum("seed").alias("n_clusters"), F.count(F.lit(1)).alias("n_members"), F.sum(F.col("k") - 1).alias("n_overlaps"))
    return got.withColumn("reduction", F.col("n_members") - F.col("n_clusters"))


@query(_stars_sql() + " SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT member FROM placed)")
def set03_untouched(spark: SparkSession, d: str) -> DataFrame:
    c = dedup.star_clusters(_links(spark, d).select("i", "j")).select(F.col("member").alias("ord")).distinct()
    return _vector_nodes(spark, d).join(c, "ord", "left_anti").select(F.col("ord").alias("vec_id"))


@query("WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS u FROM embeddings), r AS (SELECT a.vec_id AS id, b.vec_id AS match, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_dot_product(a.u, b.u), 12) DESC, b.vec_id)::INT AS rank FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id) SELECT id, rank, match FROM r WHERE rank <= 5")
def dg14_vector_search(spark: SparkSession, d: str) -> DataFrame:
    """Every fiftieth vector against all vectors."""
    v = table(spark, d, "embeddings")
    return similarity.nearest(v.filter("vec_id % 50 = 0"), v, 5, "vec_id").select("id", "rank", "match")


@query("SELECT source_node_id, target_node_id, type, count(*) AS n, min(ord) AS kept FROM edges WHERE source_node_id IS NOT NULL AND target_node_id IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) > 1")
def set07_repeated_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges that come more than once for source, target and type, and the row that is kept."""
    e = table(spark, d, "edges").filter("source_node_id IS NOT NULL AND target_node_id IS NOT NULL")
    return e.groupBy("source_node_id", "target_node_id", "type").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("kept")).filter("n > 1")
