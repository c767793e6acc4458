"""Queries of this subpackage over the driver's tables: name -> f(spark, dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fulcrum.durable import Workspace
from fulcrum.llm import bpe, canonical, encodings, groups, mixing, neighbors, survivors, truncation


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbors.neighbor_pairs(neighbors.top_neighbors(_t(spark, d, "node_vectors")))


def p1_neighbors(spark: SparkSession, d: str) -> DataFrame:
    """Every vector's five nearest with their cosine."""
    return neighbors.top_neighbors(_t(spark, d, "node_vectors")).select("id", "neighbor", F.round("cosine", 6).alias("cosine"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return groups.components(groups.linking_pairs(_t(spark, d, "match_pairs")))


def p2_group_sizes(spark: SparkSession, d: str) -> DataFrame:
    return groups.group_titles(p2_found(spark, d), _t(spark, d, "nodes"))


def _cut(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    values = truncation.values_of(_t(spark, d, "nodes"), _t(spark, d, "papers"), _t(spark, d, "grants"))
    values = Workspace(spark, "truncation").put(values, "values")
    return values, truncation.cut_values(values)[0]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _cut(spark, d)[1].select("node_id", "field_name", "pos")


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return truncation.report(*_cut(spark, d))


def _merge_rows(spark: SparkSession, d: str) -> DataFrame:
    return survivors.long_rows(survivors.members(_t(spark, d, "merge_log"), _t(spark, d, "nodes")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return survivors.best_by_merit(_merge_rows(spark, d)).select("cluster_id", "field_name", "node_id")


def p5_survivors(spark: SparkSession, d: str) -> DataFrame:
    """Surviving records by trust and recency votes, with the ids of their sources."""
    won = survivors.surviving_records(survivors.best_by_votes(_merge_rows(spark, d)))
    ids = F.transform(F.from_json("sources", "array<struct<source_id:string>>"), lambda s: s["source_id"])
    return won.withColumn("sources", F.array_join(ids, ","))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    tags = _t(spark, d, "field_taxonomy")
    rows = canonical.map_values(canonical.typed_fields(_t(spark, d, "nodes"), tags), tags)
    return rows.select("node_id", "raw_value", F.coalesce("field_tag", F.lit("")).alias("field_tag"))


def p6_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Values that fit no entry and how many nodes carry them."""
    return p6_found(spark, d).filter("field_tag = ''").groupBy("raw_value").agg(F.count(F.lit(1)).alias("n_nodes"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_corpus(_t(spark, d, "documents"))


def _mix(spark: SparkSession, d: str, keep: tuple[str, ...]) -> tuple[DataFrame, mixing.Plan]:
    sized = Workspace(spark, "mix").put(mixing.sizes(_t(spark, d, "documents"), "byte_bpe_50k", keep), "sized")
    plan = mixing.plan_mix(sized, _t(spark, d, "mix_targets"))
    return mixing.mix(sized, plan), plan


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d, ("doc_id", "source", "text"))[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.report(*_mix(spark, d, ("doc_id", "source")))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return encodings.repair(_t(spark, d, "documents")).select("doc_id")


def p9_repaired(spark: SparkSession, d: str) -> DataFrame:
    rows = encodings.repair(_t(spark, d, "documents"))
    return rows.select("doc_id", F.array_join("chains", ",").alias("chains"), "n_garbled", "n_repaired", "repaired_text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_neighbors": p1_neighbors,
    "p2_found": p2_found,
    "p2_group_sizes": p2_group_sizes,
    "p3_found": p3_found,
    "p3_report": p3_report,
    "p5_found": p5_found,
    "p5_survivors": p5_survivors,
    "p6_found": p6_found,
    "p6_unmatched": p6_unmatched,
    "p7_ids": p7_ids,
    "p8_mix": p8_mix,
    "p8_shares": p8_shares,
    "p9_found": p9_found,
    "p9_repaired": p9_repaired,
}
