"""Counting, selecting and ranking operators over papers, grants and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fulcrum.functions.numbers import percent_of
from fulcrum.functions.text import holds_any, strip, title_key, word_count


def first_per_title(df: DataFrame, order: list[str], title: str = "title") -> DataFrame:
    """The first row of each title key in ingest order; an empty title is a key too, a null one counts as empty.

    A grouped minimum keeps one row a key before anything is shuffled.
    """
    row = F.struct(*order, *[c for c in df.columns if c not in order])
    return df.groupBy(title_key(F.coalesce(title, F.lit(""))).alias("title_key")).agg(F.min(row).alias("r")).select("title_key", "r.*")


def phrase_counts(df: DataFrame, text: str, phrases: tuple[str, ...]) -> DataFrame:
    """``(phrase, n)``: texts that hold each phrase, once per text; phrases no text holds are left out."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hits = F.explode(F.filter(F.array(*(F.when(low.contains(p), F.lit(p)) for p in phrases)), lambda x: x.isNotNull()))
    return df.select(hits.alias("phrase")).groupBy("phrase").agg(F.count(F.lit(1)).alias("n"))


def phrase_hit_rate(df: DataFrame, text: str, phrases: tuple[str, ...]) -> DataFrame:
    """One row: texts, those with any phrase, whole percent."""
    got = df.agg(F.count(F.lit(1)).alias("n_texts"), F.count_if(holds_any(text, phrases)).alias("n_hits"))
    return got.withColumn("pct", percent_of(F.col("n_hits"), F.col("n_texts")))


def text_stats(df: DataFrame, by: str, text: str) -> DataFrame:
    """Per group: rows, rows with a text, whole percent, average words of those rounded down."""
    there = strip(F.coalesce(text, F.lit(""))) != ""
    got = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if(there).alias("with_text"), F.sum(F.when(there, word_count(text)).otherwise(0)).alias("words"))
    return got.select(by, "n", "with_text", percent_of(F.col("with_text"), F.col("n")).alias("pct"), F.floor(F.col("words") / F.greatest("with_text", F.lit(1))).cast("long").alias("avg_words"))


def counts_with_total(df: DataFrame, by: str, total: str = "TOTAL") -> DataFrame:
    """Rows per value and one total row; null values count as '(null)'."""
    return df.select(F.coalesce(by, F.lit("(null)")).alias(by)).rollup(by).agg(F.count(F.lit(1)).alias("n")).select(F.coalesce(by, F.lit(total)).alias(by), "n")


def per_field(df: DataFrame, text: str) -> DataFrame:
    """Rows and rows with a text per field; rows without fields count under 'unknown'."""
    f = F.explode(F.when(F.size(F.coalesce("fields", F.array().cast("array<string>"))) > 0, F.col("fields")).otherwise(F.array(F.lit("unknown"))))
    return df.select(f.alias("field"), text).groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.count_if(strip(F.coalesce(text, F.lit(""))) != "").alias("with_text"))


def top_per_group(df: DataFrame, by: str, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group with their rank; the group limit applies before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("rank") <= k)


def pick_diverse(df: DataFrame, by: str, id_col: str, order: str, first: int, total: int) -> DataFrame:
    """``(id, pick)``: the first rows of each group, then others in order until ``total``; never fewer than the first ones."""
    head = top_per_group(df.filter(F.col(by).isNotNull()), by, [F.col(order), F.col(id_col)], first).select(id_col, order, F.lit(0).alias("turn"))
    head = head.groupBy(id_col).agg(F.min(order).alias(order), F.min("turn").alias("turn"))
    rest = df.select(id_col, order).join(head.select(id_col), id_col, "left_anti").orderBy(order, id_col).limit(total).select(id_col, order, F.lit(1).alias("turn"))
    # at most the groups' first rows and ``total`` more are ranked
    ranked = head.select(id_col, order, "turn").unionByName(rest).withColumn("pick", F.row_number().over(Window.orderBy("turn", order, id_col)))
    return ranked.filter((F.col("turn") == 0) | (F.col("pick") <= total)).select(id_col, "pick")


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """``(table_name, n)``: record counts."""
    out = None
    for name, df in sorted(tables.items()):
        part = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = part if out is None else out.unionByName(part)
    return out
