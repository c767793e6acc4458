"""References to records that do not exist, direct and inherited.

A reference is orphaned when its id is tombstoned, absent, or arrives only after
the record that names it.  Records that point to an orphaned parent are orphaned
in turn: semi-joins walk down the foreign-key graph until a round finds nothing
new.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fulcrum.durable import Workspace
from fulcrum.functions.keys import same_id
from fulcrum.operators.skew import spread_join

KINDS = ("deleted", "missing", "late")


def known_ids(tables: list[DataFrame], tombstones: DataFrame) -> DataFrame:
    """``(ref_id, first_seen, deleted)``: one row for each id with a record or a tombstone.

    The tombstone with the latest ``deleted_at`` decides; of several with the same
    time one that was restored wins.  Null and blank ids are left out.
    """
    records = None
    for t in tables:
        part = t.select(same_id("node_id").alias("ref_id"), F.col("ingested_at").cast("timestamp_ntz").alias("first_seen"))
        records = part if records is None else records.unionByName(part)
    seen = records.filter("ref_id IS NOT NULL").groupBy("ref_id").agg(F.min("first_seen").alias("first_seen"), F.lit(True).alias("has_record"))
    last = F.max(F.struct("deleted_at", F.col("restored_at").isNotNull().alias("back")))
    gone = tombstones.select(same_id("node_id").alias("ref_id"), "deleted_at", "restored_at").filter("ref_id IS NOT NULL").groupBy("ref_id").agg((~last["back"]).alias("deleted"))
    return seen.join(gone, "ref_id", "full").select("ref_id", "first_seen", F.coalesce("has_record", F.lit(False)).alias("has_record"), F.coalesce("deleted", F.lit(False)).alias("deleted"))


def orphan_kind(at: str = "at") -> F.Column:  # type: ignore[name-defined]
    """The first kind that holds for a reference joined to ``known_ids``; null if it is sound."""
    absent = ~F.coalesce("has_record", F.lit(False))
    return F.when(F.coalesce("deleted", F.lit(False)), "deleted").when(absent, "missing").when(F.col("first_seen") > F.col(at), "late")


def edge_references(edges: DataFrame) -> DataFrame:
    """``(table_name, record_id, side, ref_id, at, period)`` of both ends of every edge, null and blank ends left out."""
    ends = F.explode(F.array(F.struct(F.lit("source").alias("side"), same_id("source_node_id").alias("ref_id")), F.struct(F.lit("target").alias("side"), same_id("target_node_id").alias("ref_id"))))
    rows = edges.select("edge_id", "ingested_at", "created_at", ends.alias("e"))
    return rows.select(F.lit("edges").alias("table_name"), F.col("edge_id").alias("record_id"), "e.side", "e.ref_id", F.col("ingested_at").alias("at"), _month("created_at")).filter("ref_id IS NOT NULL")


def parent_references(nodes: DataFrame) -> DataFrame:
    """The same for the parents of nodes; a node that comes twice counts once, as it first came."""
    first = F.min_by(F.struct("parent_id", "created_at", "ingested_at"), "ingested_at")
    rows = nodes.select(same_id("node_id").alias("record_id"), same_id("parent_id").alias("parent_id"), "created_at", "ingested_at").filter("record_id IS NOT NULL").groupBy("record_id").agg(first.alias("r"))
    return rows.select(F.lit("nodes").alias("table_name"), "record_id", F.lit("parent").alias("side"), F.col("r.parent_id").alias("ref_id"), F.col("r.ingested_at").alias("at"), _month("r.created_at")).filter("ref_id IS NOT NULL")


def _month(c: str) -> F.Column:  # type: ignore[name-defined]
    return F.date_format(c, "yyyy-MM").alias("period")


def direct_orphans(references: DataFrame, known: DataFrame, rows: int) -> DataFrame:
    """The references with a ``kind``; copies of a record count once, by their first kind in KINDS order."""
    joined = spread_join(references, known, "ref_id", rows).withColumn("kind", orphan_kind()).filter("kind IS NOT NULL")
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    return joined.groupBy("table_name", "record_id", "side").agg(F.min_by(F.struct("ref_id", "period", "kind"), order).alias("r")).select("table_name", "record_id", "side", "r.ref_id", "r.period", "r.kind")


def orphaned_nodes(parents: DataFrame, direct: DataFrame) -> DataFrame:
    """``(ref_id, depth)``: nodes whose parent is orphaned for good (depth 1), whose grandparent is (2), and so on.

    Late parents arrive in the end and pass nothing on.  A cycle of parents is
    entered once.  Rounds end when one finds nothing new.
    """
    work = Workspace(parents.sparkSession, "orphans")
    links = work.put(parents.select("record_id", "ref_id"), "links")
    found = work.put(direct.filter("table_name = 'nodes' AND kind <> 'late'").select(F.col("record_id").alias("ref_id"), F.lit(1).alias("depth")).distinct(), "found0")
    front = found
    for depth in count(2):
        step = links.join(front.select("ref_id"), "ref_id", "left_semi").select(F.col("record_id").alias("ref_id")).distinct().join(found.select("ref_id"), "ref_id", "left_anti").withColumn("depth", F.lit(depth))
        front = work.put(step, f"front{depth}")
        if front.isEmpty():
            break
        found = found.unionByName(front)
        if depth % 20 == 0:  # many levels are gathered in one table, so that plans stay short
            found = work.put(found, "found")
    return found


def all_orphans(nodes: DataFrame, seeds: DataFrame, edges: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Direct and inherited orphan references of edges and of node parents.

    Columns ``table_name, record_id, side, ref_id, period, kind, inherited``;
    ``kind`` is 'inherited' where only the referenced node's own ancestry is broken.
    Empty tables give no rows.
    """
    known = known_ids([nodes, seeds], tombstones)
    parents = parent_references(nodes)
    references = edge_references(edges).unionByName(parents)
    rows = 2 * edges.count() + nodes.count()
    direct = Workspace(edges.sparkSession, "orphans").put(direct_orphans(references, known, rows), "direct")
    lost = orphaned_nodes(parents, direct)
    below = spread_join(references, lost, "ref_id", rows, "inner").select("table_name", "record_id", "side", "ref_id", "period").distinct()
    inherited = below.join(direct.select("table_name", "record_id", "side"), ["table_name", "record_id", "side"], "left_anti").withColumn("kind", F.lit("inherited"))
    return direct.withColumn("inherited", F.lit(False)).unionByName(inherited.withColumn("inherited", F.lit(True)))


def report(orphans: DataFrame) -> DataFrame:
    """Orphan references per table, side, month and kind."""
    return orphans.groupBy("table_name", "side", "period", "kind").agg(F.count(F.lit(1)).alias("n_references"))
