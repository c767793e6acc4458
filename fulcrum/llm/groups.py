"""Connected groups of pairwise matches by alternating large-star and small-star.

Every round rewrites the edge list with grouped minima and joins only; state is a
written table, so a lost executor costs the current round at most.  A hub's edges
are spread over as many join keys as its degree needs.  The hub list that is
broadcast for that holds at most ``2 * edges / hub_degree`` rows, and the degree
limit rises with the edge count so that this stays below 4,000.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fulcrum.durable import Workspace
from fulcrum.functions.keys import same_id, trim_blanks

HUB_DEGREE = 100_000


def linking_pairs(pairs: DataFrame, a: str = "node_a", b: str = "node_b", decision: str = "decision", links: str = "MERGE") -> DataFrame:
    """``(hi, lo)``: normalised ids of the rows that link, larger id first, not distinct."""
    x, y = same_id(a), same_id(b)
    return (
        pairs.filter(F.upper(trim_blanks(decision)) == links)
        .select(F.greatest(x, y).alias("hi"), F.least(x, y).alias("lo"), x.alias("_a"), y.alias("_b"))
        .filter("_a IS NOT NULL AND _b IS NOT NULL AND _a <> _b")
        .select("hi", "lo")
    )


def _attach(edges: DataFrame, on: str, minima: DataFrame, limit: int) -> DataFrame:
    """``edges`` with column ``m`` of ``minima(id, m, deg)``; hub keys are salted on both sides."""
    hubs = F.broadcast(minima.filter(F.col("deg") > limit).select(F.col("id").alias(on), (F.col("deg") / limit + 1).cast("int").alias("parts")))
    other = "lo" if on == "hi" else "hi"
    salted = edges.join(hubs, on, "left").withColumn("salt", F.pmod(F.xxhash64(other), F.coalesce("parts", F.lit(1))).cast("int"))
    sides = minima.select(F.col("id").alias(on), "m", F.explode(F.sequence(F.lit(0), F.when(F.col("deg") > limit, (F.col("deg") / limit).cast("int")).otherwise(0))).alias("salt"))
    return salted.join(sides, [on, "salt"]).select("hi", "lo", "m")


def large_star(edges: DataFrame, limit: int) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour (or itself)."""
    both = edges.select(F.col("lo").alias("id"), F.col("hi").alias("n")).unionAll(edges.select(F.col("hi").alias("id"), F.col("lo").alias("n")))
    minima = both.groupBy("id").agg(F.min(F.least("id", "n")).alias("m"), F.count(F.lit(1)).alias("deg"))
    return _attach(edges, "lo", minima, limit).select("hi", F.col("m").alias("lo")).distinct()


def small_star(edges: DataFrame, limit: int) -> DataFrame:
    """Every smaller neighbour of a node, and the node, is linked to the smallest of them."""
    minima = edges.groupBy(F.col("hi").alias("id")).agg(F.min("lo").alias("m"), F.count(F.lit(1)).alias("deg"))
    rows = _attach(edges, "hi", minima, limit)
    moved = rows.filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.unionAll(rows.filter("lo = m").select("hi", "lo")).distinct()


def components(pairs: DataFrame, max_rounds: int = 64) -> DataFrame:
    """``(node_id, group_id)`` from edges ``(hi, lo)`` with ``hi > lo``.

    ``group_id`` is the smallest id reachable.  Repeated edges change nothing, an
    edge with a null side or with equal sides is left out, no edges give no rows.
    """
    spark = pairs.sparkSession
    work = Workspace(spark, "groups")
    edges = work.put(pairs.select("hi", "lo").filter("hi > lo").distinct(), "edges")

    def mark(df: DataFrame) -> tuple[int, int, int]:
        h = F.xxhash64("hi", "lo")
        r = df.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(F.shiftright(h, 24))).first()
        return r[0], r[1], r[2]

    before = mark(edges)
    for n in range(max_rounds):
        limit = max(HUB_DEGREE, before[0] // 2_000)
        wide = work.put(large_star(edges, limit), f"large{n}")
        work.drop(edges)
        edges = work.put(small_star(wide, limit), f"small{n}")
        work.drop(wide)
        after = mark(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"groups still change after {max_rounds} rounds")
    tops = edges.select(F.col("lo").alias("node_id"), F.col("lo").alias("group_id")).distinct()
    return edges.select(F.col("hi").alias("node_id"), F.col("lo").alias("group_id")).unionAll(tops)


def group_titles(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row a group: its size, how many members have a node row and how many titles they carry.

    Titles count as different after trimming and ignoring case; ids without a node
    row count as members only.
    """
    titles = nodes.select(same_id("node_id").alias("node_id"), F.nullif(F.lower(trim_blanks("title")), F.lit("")).alias("title_key")).filter("node_id IS NOT NULL").distinct()
    seen = members.join(titles, "node_id", "left").withColumn("has_row", F.col("title_key").isNotNull())
    # distinct titles through two plain groupings: nothing per group is ever collected
    per_title = seen.groupBy("group_id", "title_key").agg(F.count(F.lit(1)).alias("n"))
    counted = per_title.groupBy("group_id").agg(F.count("title_key").alias("n_titles"), F.sum(F.when(F.col("title_key").isNotNull(), F.col("n")).otherwise(0)).alias("n_with_title"))
    return members.groupBy("group_id").agg(F.count(F.lit(1)).alias("n_members")).join(counted, "group_id")
