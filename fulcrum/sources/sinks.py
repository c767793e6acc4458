"""Writers: JSON lines, stage tables, partitioned samples, edge lists, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, single: bool = False) -> None:
    """One record a line, overwriting; ``single`` makes one file and is for small results."""
    (df.coalesce(1) if single else df).write.mode("overwrite").json(path)


def write_stage(df: DataFrame, root: str, stage: str) -> DataFrame:
    """A stage's table, read back."""
    df.write.mode("overwrite").parquet(f"{root}/{stage}")
    return df.sparkSession.read.parquet(f"{root}/{stage}")


def write_samples(df: DataFrame, path: str, *by: str) -> None:
    """JSON lines in one folder for each value of the partition columns."""
    df.write.mode("overwrite").partitionBy(*by).json(path)


def write_edge_list(edges: DataFrame, path: str) -> None:
    """Tab-separated source, target, weight."""
    edges.select("src", "dst", (F.col("strength") * F.col("confidence")).alias("weight")).write.mode("overwrite").option("sep", "\t").csv(path)


def nested_scores(scores: DataFrame) -> DataFrame:
    """Scores as records with a ``components`` struct."""
    return scores.select("node_id", "leverage", F.struct("cascade", "cross_field", "bottleneck").alias("components"))
