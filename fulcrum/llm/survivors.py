"""The best representative of each group of duplicate records, field by field.

The members' fields are unpivoted to long rows.  Each row carries the merit its
field's rule gives it and a vote, source trust times recency decay; votes are
summed over equal normalised values.  Grouped minima over ordered structs choose
each field's winner, and a pivot builds the surviving record.  Every step is a
partial aggregation, so one huge group is never gathered in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fulcrum.durable import Workspace
from fulcrum.functions.keys import same_id, trim_blanks

FIELDS = ("description", "granularity", "confidence", "sources")

# Trust in a record's best source type.
TRUST = {"curated_list": 1.2, "paper": 1.0, "grant": 0.9, "patent": 0.7}

#: A description that stands word for word in this share of all merged clusters, and in at least so many, says nothing about any of them.
STAND_IN_SHARE, STAND_IN_CLUSTERS = 0.005, 3

#: Days after which a record's vote counts half.
HALF_LIFE_DAYS = 365.0


def _bare(c: Column) -> Column:
    """Lower case without anything but letters and digits, to compare a text with its title."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " ")


def _plain(text: Column) -> Column:
    """Without markup and runs of blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"<[^>]*>|&nbsp;", " "), r"\s+", " "))


def complete_sentences(text: Column, title: Column) -> Column:
    """The different complete sentences of real content, lower case, in order.

    Markup and runs of blanks don't count; a sentence ends in one full stop,
    question or exclamation mark; the title itself is left out.  Null and blank
    texts have none.
    """
    marked = F.regexp_replace(_plain(text), r'([.!?]["”)]?) ([\p{Lu}\p{N}“"(¿¡])', "$1\u0001$2")
    name = F.trim(_bare(F.coalesce(title, F.lit(""))))
    real = lambda s: s.rlike(r'[^.!?][.!?]["”)]?$') & (F.trim(_bare(s)) != name)
    return F.array_distinct(F.filter(F.transform(F.split(marked, "\u0001"), lambda s: F.lower(F.trim(s))), real))


def members(merge_log: DataFrame, nodes: DataFrame, decision: str = "MERGE") -> DataFrame:
    """One row for each different node of each merged cluster of two or more nodes.

    Nodes that come twice count once (the later export stands); members without a
    node row have nothing to offer and are left out, but count for the two.  A
    description repeated in very many clusters is a stand-in and becomes null: a text
    that fits so many different problems carries no content.  Each such text takes a
    share of all clusters, so there are at most ``members / (clusters * STAND_IN_SHARE)`` of
    them, 200 times the mean cluster size, and their hashes may be broadcast.
    """
    rows = merge_log.filter(F.upper(trim_blanks("decision")) == decision).select("cluster_id", same_id("node_id").alias("node_id")).filter("cluster_id IS NOT NULL AND node_id IS NOT NULL").distinct()
    many = rows.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").select("cluster_id")
    columns = ("title", "description", "granularity", "confidence", "sources", "created_at", "last_validated")
    offered = nodes.select(same_id("node_id").alias("node_id"), "ingested_at", F.struct(*columns).alias("r"))
    met = rows.join(many, "cluster_id", "left_semi").join(offered, "node_id")
    once = met.groupBy("cluster_id", "node_id").agg(F.max_by("r", "ingested_at").alias("r")).select("cluster_id", "node_id", "r.*").withColumn("_text", F.xxhash64(F.lower(_plain(F.col("description")))))
    once = Workspace(nodes.sparkSession, "survivors").put(once, "members")
    clusters = once.agg(F.count_distinct("cluster_id").alias("_all"))  # one row
    said = once.filter("description IS NOT NULL").select("_text", "cluster_id").distinct().groupBy("_text").agg(F.count(F.lit(1)).alias("_n"))
    empty = said.join(F.broadcast(clusters)).filter((F.col("_n") >= STAND_IN_CLUSTERS) & (F.col("_n") >= STAND_IN_SHARE * F.col("_all"))).select("_text", F.lit(True).alias("_empty"))
    marked = once.join(F.broadcast(empty), "_text", "left")
    return marked.withColumn("description", F.when(F.col("_empty").isNull(), F.col("description"))).drop("_text", "_empty")


def long_rows(rows: DataFrame) -> DataFrame:
    """``(cluster_id, node_id, field_name, merit, value_key, value, trust, seen_at)``, usable values only."""
    level = F.upper(trim_blanks("granularity"))
    seen = F.coalesce("last_validated", "created_at")
    sentences = complete_sentences(F.col("description"), F.col("title"))
    ids = F.array_distinct(F.filter(F.transform(F.coalesce("sources", F.array()), lambda s: trim_blanks(s["source_id"])), lambda i: i != ""))
    at = F.unix_micros(seen.cast("timestamp")).cast("double")
    options = {
        "description": (F.size("_sentences") > 0, F.size("_sentences").cast("double"), F.concat_ws(" ", "_sentences"), F.col("description")),
        "granularity": (level.isin("L0", "L1", "L2", "L3"), F.coalesce(at, F.lit(-1e300)), level, level),
        "confidence": ((F.col("confidence") >= 0) & (F.col("confidence") <= 1), F.col("confidence"), F.format_string("%.6f", "confidence"), F.col("confidence").cast("string")),
        "sources": (F.size("_ids") > 0, F.size("_ids").cast("double"), F.concat_ws("\u0001", F.array_sort("_ids")), F.to_json("sources")),
    }
    trust = F.array_max(F.transform(F.coalesce("sources", F.array()), lambda s: F.coalesce(F.create_map(*(F.lit(x) for kv in TRUST.items() for x in kv))[s["source_type"]], F.lit(0.5))))
    made = [F.struct(F.lit(n).alias("field_name"), F.coalesce(ok, F.lit(False)).alias("usable"), m.alias("merit"), k.alias("value_key"), v.alias("value")) for n, (ok, m, k, v) in options.items()]
    return (
        rows.withColumns({"_sentences": sentences, "_ids": ids})
        .select("cluster_id", "node_id", F.coalesce(trust, F.lit(0.5)).alias("trust"), seen.alias("seen_at"), F.explode(F.array(*made)).alias("f"))
        .select("cluster_id", "node_id", "trust", "seen_at", "f.*")
        .filter("usable")
        .drop("usable")
    )


def best_by_merit(long: DataFrame) -> DataFrame:
    """Each field's member of greatest merit, ties to the smallest node id: ``(cluster_id, field_name, node_id, value)``."""
    first = F.min(F.struct((-F.col("merit")).alias("m"), "node_id", "value"))
    return long.groupBy("cluster_id", "field_name").agg(first.alias("w")).select("cluster_id", "field_name", "w.node_id", "w.value")


def best_by_votes(long: DataFrame, half_life_days: float = HALF_LIFE_DAYS) -> DataFrame:
    """Each field's value with the most votes, then merit, then smallest node id; also ``votes``.

    A vote is the trust of the member's best source, halved for every half-life
    between its last sighting and the latest one of the whole log; a member never
    dated votes as one ten half-lives old.
    """
    now = F.broadcast(long.agg(F.max("seen_at").alias("now")))  # one row
    age = F.coalesce(F.timestamp_diff("SECOND", F.col("seen_at"), F.col("now")) / 86_400.0, F.lit(10 * half_life_days))
    votes = long.join(now).withColumn("vote", F.col("trust") * F.pow(F.lit(0.5), age / half_life_days))
    per_value = votes.groupBy("cluster_id", "field_name", "value_key").agg(F.sum("vote").alias("votes"), F.min(F.struct((-F.col("merit")).alias("m"), "node_id", "value")).alias("b"))
    top = F.min(F.struct((-F.round("votes", 9)).alias("v"), "b"))
    return per_value.groupBy("cluster_id", "field_name").agg(top.alias("w")).select("cluster_id", "field_name", F.col("w.b.node_id").alias("node_id"), F.col("w.b.value").alias("value"), (-F.col("w.v")).alias("votes"))


def surviving_records(winners: DataFrame) -> DataFrame:
    """One row a cluster with the winning value of each field, null where no member had one."""
    return winners.groupBy("cluster_id").pivot("field_name", list(FIELDS)).agg(F.first("value"))
