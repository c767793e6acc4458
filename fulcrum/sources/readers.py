"""Readers for the record files and raw payloads that feed the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fulcrum.functions.text import collapse, from_inverted_index, or_else, safe_double, strip, year_of_mdy
from fulcrum.schemas import EDGE, GRANT, NODE, PAPER, edge_is_valid, node_defaults, node_is_valid, split_valid

# How each field is asked for at the four sources: topics, categories, programmes, search terms.
TOPICS = {
    "materials_science": ("T10134", "T10256", "T10891", "T11327", "T10048", "T10062"),
    "ai_ml": ("T10077", "T10210", "T10563", "T10182", "T10094"),
    "drug_discovery": ("T10011", "T10034", "T10156", "T10089", "T10201"),
}
CATEGORIES = {
    "materials_science": ("cond-mat.mtrl-sci", "cond-mat.supr-con", "physics.chem-ph"),
    "ai_ml": ("cs.LG", "cs.AI", "cs.CL", "cs.CV", "stat.ML"),
    "drug_discovery": ("q-bio.BM", "q-bio.QM", "cs.LG"),
}
PROGRAMMES = {"materials_science": ("DMR", "CMMI", "CBET"), "ai_ml": ("IIS", "CCF", "OAC"), "drug_discovery": ("MCB", "DBI", "CHEM")}
TERMS = {
    "drug_discovery": ("drug discovery", "drug design", "pharmacology"),
    "ai_ml": ("machine learning", "artificial intelligence", "deep learning"),
    "materials_science": ("materials science", "energy storage", "superconductor"),
}
# Years and kinds of award that agency B is asked for, rows per programme and per term.
YEARS_B, ACTIVITIES_B, PAGE_A, PAGE_B = (2022, 2023, 2024), ("R01", "R21", "U01"), 20, 15

WORK = "id string, title string, abstract_inverted_index map<string,array<int>>, doi string, publication_year int, cited_by_count int, topics array<struct<display_name:string>>, type string, open_access struct<oa_url:string>"
AWARD_A = "id string, title string, abstractText string, agency string, fundsObligatedAmt string, date string"
AWARD_B = "project_num string, project_title string, abstract_text string, agency_ic_admin struct<name:string>, fiscal_year int, award_amount string"


def field_codes(spark: SparkSession) -> DataFrame:
    """``(field, kind, pos, code)``: the dimension of codes per field and source."""
    kinds = {"topic": TOPICS, "category": CATEGORIES, "programme": PROGRAMMES, "term": TERMS}
    return spark.createDataFrame([(f, k, n, c) for k, table in kinds.items() for f, codes in table.items() for n, c in enumerate(codes)], "field string, kind string, pos int, code string")


def grants_by_code(awards: DataFrame, codes: list[str], by: F.Column, order: list[F.Column], per_code: int, most: int) -> DataFrame:  # type: ignore[name-defined]
    """The first ``per_code`` rows of each code in turn, ``most`` in all, then blank abstracts dropped, with ``code_pos``.

    ``by`` tells whether a row belongs to a code, given as column ``code``; a row may
    belong to several and then comes once for each.  No more than ``per_code`` times the codes are ranked.
    """
    asked = F.explode(F.array(*(F.struct(F.lit(k).alias("code_pos"), F.lit(c).alias("code")) for k, c in enumerate(codes))))
    rows = awards.withColumn("_c", asked).select(*awards.columns, "_c.*").filter(by)
    few = rows.withColumn("_n", F.row_number().over(Window.partitionBy("code_pos").orderBy(*order))).filter(F.col("_n") <= per_code)
    kept = few.filter(strip(F.coalesce("abstract", F.lit(""))) != "").orderBy("code_pos", "_n").limit(most)
    return kept.drop("_n", "code")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, strict: bool = False) -> DataFrame:
    """One record a line; blank lines are skipped.  Bad lines leave all-null rows with their text in
    ``_corrupt_record``, or raise if ``strict``."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    whole = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    return spark.read.schema(whole).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def read_nodes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Valid nodes with defaults, and the quarantine."""
    good, bad = split_valid(read_jsonl(spark, path, NODE), node_is_valid() & F.col("_corrupt_record").isNull())
    return node_defaults(good.drop("_corrupt_record")), bad


def read_edges(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    good, bad = split_valid(read_jsonl(spark, path, EDGE), edge_is_valid() & F.col("_corrupt_record").isNull())
    return good.drop("_corrupt_record"), bad


def read_papers(spark: SparkSession, path: str) -> DataFrame:
    """Staged papers: a bad line raises."""
    return read_jsonl(spark, path, PAPER, strict=True)


def read_grants(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, GRANT, strict=True)


def staged_or(spark: SparkSession, path: str, ingest) -> DataFrame:  # noqa: ANN001
    """The staged table if it exists, else what ``ingest()`` brings, staged for next time."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        ingest().write.parquet(path)
    return spark.read.parquet(path)


def first_non_empty(first: DataFrame, other) -> DataFrame:  # noqa: ANN001
    """The first result unless it is empty, then the simpler query's."""
    return other() if first.isEmpty() else first


def search_ids(papers: DataFrame, words: str, most: int) -> DataFrame:
    """``(id)`` of the papers whose title or abstract holds every word of the query, the newest first, ties by id."""
    text, hit = F.lower(F.concat_ws(" ", "title", "abstract")), F.lit(True)
    for w in words.lower().split():
        hit = hit & text.contains(w)
    return papers.filter(hit).groupBy("id").agg(F.max("year").alias("year")).orderBy(F.desc_nulls_last("year"), "id").limit(most).select("id")


def works_to_papers(works: DataFrame, source: str = "openalex") -> DataFrame:
    """Raw works to papers: abstract from the inverted index, topics to fields, falsy titles to ''."""
    return works.select(
        "id", F.coalesce("title", F.lit("")).alias("title"), from_inverted_index("abstract_inverted_index").alias("abstract"), "doi", F.col("publication_year").alias("year"),
        F.coalesce("cited_by_count", F.lit(0)).alias("cited_by_count"), F.filter(F.transform(F.coalesce("topics", F.array().cast("array<struct<display_name:string>>")), lambda t: t["display_name"]), lambda x: x.isNotNull()).alias("fields"),
        F.lower(F.coalesce("type", F.lit(""))).contains("review").alias("is_review"), F.col("open_access.oa_url").alias("oa_url"), F.lit(source).alias("source"),
    )


def reviews(papers: DataFrame, most: int) -> DataFrame:
    """Review articles, most cited first."""
    return papers.filter("is_review").orderBy(F.desc("cited_by_count"), "id").limit(most)


def top_cited(papers: DataFrame, most: int, more_than: int = 20) -> DataFrame:
    """Other articles cited more often than the bound, most cited first."""
    return papers.filter(~F.col("is_review") & (F.col("cited_by_count") > more_than)).orderBy(F.desc("cited_by_count"), "id").limit(most)


def _tag(name: str) -> F.Column:  # type: ignore[name-defined]
    """The text of an element as it stands in the feed; escapes are left as they are."""
    return F.regexp_extract("entry", rf"(?s)<{name}[^>]*>(.*?)</{name}>", 1)


def read_atom(feeds: DataFrame, text_col: str = "value") -> DataFrame:
    """Preprint feed pages (whole texts) to papers; entries without an id are skipped."""
    e = feeds.select(F.explode(F.regexp_extract_all(text_col, F.lit(r"(?s)<entry>(.*?)</entry>"), 1)).alias("entry"))
    year = F.substring(_tag("published"), 1, 4)
    return e.select(
        F.regexp_extract(_tag("id"), r"abs/(.+)$", 1).alias("id"), collapse(_tag("title")).alias("title"), collapse(_tag("summary")).alias("abstract"),
        F.when(year.rlike("^[0-9]{4}$"), year.cast("int")).alias("year"), F.lit("arxiv").alias("source"),
    ).filter("id <> ''")


def read_article_sets(texts: DataFrame, text_col: str = "value") -> DataFrame:
    """Biomedical article sets (whole XML texts) to papers, by XPath; an article without an id is skipped."""
    one = lambda p: F.trim(F.xpath_string("a", F.lit(p)))
    a = texts.select(F.explode(F.regexp_extract_all(text_col, F.lit(r"(?s)(<PubmedArticle[ >].*?</PubmedArticle>)"), 1)).alias("a"))
    year = one("//PubDate/Year")
    return a.select(
        one("//PMID").alias("id"), collapse(one("//ArticleTitle")).alias("title"), F.array_join(F.xpath("a", F.lit("//AbstractText/text()")), " ").alias("abstract"),
        F.nullif(one("//ArticleId[@IdType='doi']"), F.lit("")).alias("doi"), F.when(year.rlike("^[0-9]+$"), year.cast("int")).alias("year"),
        F.slice(F.xpath("a", F.lit("//MeshHeading/DescriptorName/text()")), 1, 10).alias("fields"),
        F.exists(F.xpath("a", F.lit("//PublicationType/text()")), lambda t: F.lower(t).contains("review")).alias("is_review"), F.lit("pubmed").alias("source"),
    ).filter("id <> ''")


def awards_a_to_grants(awards: DataFrame) -> DataFrame:
    """Agency A's awards; blank abstracts are dropped."""
    return awards.filter(strip(F.coalesce("abstractText", F.lit(""))) != "").select(
        F.coalesce("id", F.lit("")).alias("id"), strip(F.coalesce("title", F.lit(""))).alias("title"), strip("abstractText").alias("abstract"), or_else("agency", F.lit("NSF")).alias("agency"),
        year_of_mdy("date").alias("year"), safe_double("fundsObligatedAmt").alias("amount"), F.lit("nsf").alias("source"),
    )


def awards_b_to_grants(awards: DataFrame) -> DataFrame:
    """Agency B's awards; blank abstracts are dropped."""
    return awards.filter(strip(F.coalesce("abstract_text", F.lit(""))) != "").select(
        F.coalesce("project_num", F.lit("")).alias("id"), strip(F.coalesce("project_title", F.lit(""))).alias("title"), strip("abstract_text").alias("abstract"), or_else("agency_ic_admin.name", F.lit("NIH")).alias("agency"),
        F.col("fiscal_year").alias("year"), safe_double("award_amount").alias("amount"), F.lit("nih").alias("source"),
    )
