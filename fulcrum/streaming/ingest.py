"""Streaming extension: incremental ingest, windowed blocker degrees, sessions.

The batch operators define the results; these run the same questions on streams.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LATE = "7 days"


def stream_table(spark: SparkSession, path: str) -> DataFrame:
    """A folder of parquet files, or one such file, as a stream with the schema of what is there."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile():
        return reader.option("pathGlobFilter", p.getName()).parquet(p.getParent().toString())
    return reader.parquet(path)


def new_edges(edges: DataFrame, late: str = LATE) -> DataFrame:
    """Edges once each, as long as copies come within the watermark."""
    return edges.withColumn("ts", F.col("ingested_at").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["edge_id"])


def windowed_degrees(edges: DataFrame, width: str = "7 days", late: str = LATE) -> DataFrame:
    """``(src, start, n)``: ENABLES edges that arrived per source and window."""
    typed = edges.filter("type = 'ENABLES' AND source_node_id IS NOT NULL")
    return typed.groupBy(F.window("ts", width), F.col("source_node_id").alias("src")).agg(F.count(F.lit(1)).alias("n")).select("src", F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """``(user_id, start, end, n)``: bursts of activity separated by a gap."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    marked = timed.withWatermark("ts", late) if events.isStreaming else timed
    got = marked.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return got.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def refresh(edges: DataFrame, on_batch: Callable[[DataFrame, int], None], checkpoint: str):  # noqa: ANN201
    """A query that hands every batch of new edges to ``on_batch``, all that is there and then ends."""
    return edges.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def settled(df: DataFrame, keys: list[str], values: list[str], out: str, checkpoint: str) -> DataFrame:
    """Runs a streamed aggregate over all that is there: every batch writes the groups it changed, the last state of each counts."""

    def keep(batch: DataFrame, k: int) -> None:
        batch.withColumn("_batch", F.lit(k)).write.mode("append").parquet(out)

    df.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    rows = df.sparkSession.read.parquet(out)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "_batch").alias("_r")).select(*keys, "_r.*")


def kept(df: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Runs a stream over all that is there into a folder, which is read back; ``complete`` aggregates replace it each batch."""
    df.writeStream.outputMode("complete").foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.parquet(out)


def drain(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there and returns what it put out (small results, tests)."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
