"""Joins and numberings that stay even when one key holds a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fulcrum.durable import Workspace

#: Rows of one join key that may meet in one task.
HOT_ROWS = 100_000


def spread_join(big: DataFrame, small: DataFrame, key: str, rows: int, how: str = "left", limit: int = HOT_ROWS) -> DataFrame:
    """``big`` joined to ``small`` on ``key``, hot keys cut into several join keys.

    ``small`` has at most one row a key.  ``rows`` is an upper bound of the rows
    of ``big``; keys with more than ``max(limit, rows / 2000)`` rows are hot, so
    there are at most 2,000 of them and their list may be broadcast.  Null keys
    meet nothing.  With ``how='left'`` they stay, spread over all tasks.
    """
    limit = max(limit, rows // 2_000)
    if rows <= limit:  # no key can be hot
        return big.join(small, key, how)
    counts = big.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit)
    hot = F.broadcast(counts.select(key, F.ceil(F.col("_n") / limit).cast("int").alias("_parts")))
    mixed = F.xxhash64(*(c for c in big.columns if c != key), F.lit(7))  # the row itself, so that a retried task salts alike
    parts = F.when(F.col(key).isNull(), F.lit(1_000)).otherwise(F.coalesce("_parts", F.lit(1)))
    left = big.join(hot, key, "left").withColumn("_salt", F.pmod(mixed, parts).cast("int")).drop("_parts")
    right = small.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return left.join(right, [key, "_salt"], how).drop("_salt")


def numbered(df: DataFrame, by: str, order: list[Column], name: str = "pos") -> DataFrame:
    """``df`` with each row's place, from 0, within its group; no group is gathered in a task.

    Rows are range-partitioned by group and order, so a large group spreads over
    many partitions.  Sorted partitions are numbered and written; a group's share
    of each partition is then shifted by its rows in the partitions before, which
    takes one small row for each group and partition.
    """
    work = Workspace(df.sparkSession, "numbered")
    sorted_rows = df.repartitionByRange(F.col(by), *order).sortWithinPartitions(F.col(by), *order)
    rows = work.put(sorted_rows.withColumns({"_p": F.spark_partition_id(), "_m": F.monotonically_increasing_id()}), "rows")
    parts = rows.groupBy(by, "_p").agg(F.min("_m").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = parts.select(F.col(by).alias("_by"), "_p", (before - F.col("_first")).alias("_shift"))
    return rows.join(shift.withColumnRenamed("_p", "_q"), F.col(by).eqNullSafe(F.col("_by")) & (F.col("_p") == F.col("_q"))).withColumn(name, F.col("_m") + F.col("_shift")).drop("_p", "_q", "_m", "_by", "_shift")
