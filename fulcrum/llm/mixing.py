"""Mixing sources to target weights by hash-seeded Poisson replication.

Every document draws a number of copies from a Poisson distribution cut at its
source's repeat limit, by inverting the distribution at a uniform number hashed
from the document's id.  As the rate grows, a document gains copies at fixed
rates; the size a source reaches is therefore a step function of its rate, and
the rate that meets the source's target is read off a histogram over a grid of
rates.  The histogram has ``GRID`` rows a source, whatever the corpus size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fulcrum.llm.bpe import encode_corpus

#: Rates between 1e-7 and 200 in logarithmic steps; neighbouring rates differ by half a per cent.
GRID = 4_300
RATES = np.geomspace(1e-7, 200.0, GRID)


def copies_at_least(u: np.ndarray, j: int) -> np.ndarray:
    """For uniform numbers ``u``, the first grid index at which a document has at least ``j`` copies."""
    term = np.exp(-RATES)
    below = term.copy()  # P(fewer than j copies) falls as the rate grows
    for i in range(1, j):
        term = term * RATES / i
        below += term
    return GRID - np.searchsorted(below[::-1], u, side="right")


@dataclass(frozen=True)
class Plan:
    """What a mix needs: by source its target share, repeat limit, available size and grid index."""

    total: float
    rows: list[dict]


def sizes(docs: DataFrame, tokenizer: str, keep: tuple[str, ...] = ("doc_id", "source", "text")) -> DataFrame:
    """The documents with ``n_tokens`` of a public tokenizer."""
    return encode_corpus(docs, "text", keep, tokenizer, counts_only=True)


def _uniform(id_col: str, seed: int) -> F.Column:  # type: ignore[name-defined]
    """A hashed number strictly between 0 and 1."""
    return (F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def _thresholds(sized: DataFrame, seed: int, limits: dict[str, int]) -> DataFrame:
    """``(source, cell, size)``: size gained by each source when its rate passes grid index ``cell``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            source = np.asarray(b.column(0).to_pylist(), dtype=object)
            u, n = b.column(1).to_numpy(), b.column(2).to_numpy()
            out: dict[tuple[str, int], int] = {}
            for s in set(source.tolist()):
                mine = source == s
                for j in range(1, limits[s] + 1):
                    sums = np.bincount(copies_at_least(u[mine], j), weights=n[mine], minlength=GRID + 1)
                    for c in np.nonzero(sums)[0].tolist():
                        out[s, c] = out.get((s, c), 0) + int(sums[c])
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in out], pa.string()), pa.array([k[1] for k in out], pa.int32()), pa.array(list(out.values()), pa.int64())], names=["source", "cell", "size"])

    rows = sized.select("source", _uniform("doc_id", seed).alias("u"), F.col("n_tokens").cast("double").alias("n"))
    return rows.mapInArrow(run, "source string, cell int, size long").groupBy("source", "cell").agg(F.sum("size").alias("size"))


def plan_mix(sized: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 17) -> Plan:
    """Rates that make each source hold its share of ``total``.

    Sources without tokens can't hold a share: the others' shares are scaled to
    sum to 1.  Without ``total`` the largest size is taken at which no source
    needs more than its repeat limit.  With a larger ``total`` short sources give
    all their limit allows and the report shows what is missing.  ``targets`` is a
    list of sources set by hand; a source listed twice counts once, with its first
    limit; a null or non-positive share or limit leaves the source out.
    """
    wanted: dict[str, dict] = {}
    for r in targets.select("source", F.col("target_share").cast("double").alias("share"), F.col("max_repeats").cast("int").alias("limit")).orderBy("source", "share", "limit").collect():
        if r.source is not None and r.share and r.share > 0 and r.limit and r.limit > 0:
            wanted.setdefault(r.source, {"source": r.source, "target_share": r.share, "max_repeats": r.limit})
    there = {r.source: r.n for r in sized.filter(F.col("source").isin(list(wanted))).groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    rows = [w | {"available": int(there.get(s) or 0)} for s, w in sorted(wanted.items())]
    usable = [r for r in rows if r["available"] > 0]
    whole = sum(r["target_share"] for r in usable)
    for r in rows:
        r["share"] = r["target_share"] / whole if r["available"] > 0 else 0.0
    if total is None:
        total = min((r["max_repeats"] * r["available"] / r["share"] for r in usable), default=0.0)
    limits = {r["source"]: r["max_repeats"] for r in usable}
    gained: dict[str, np.ndarray] = {s: np.zeros(GRID + 1) for s in limits}
    for g in _thresholds(sized.filter(F.col("source").isin(list(limits))), seed, limits).collect():
        gained[g.source][g.cell] = g["size"]
    for r in rows:
        r["cell"] = -1
        if r["available"] > 0:
            goal = min(r["share"] * total, r["max_repeats"] * r["available"])
            if goal >= r["max_repeats"] * r["available"] * (1 - 1e-12):
                r["cell"] = GRID  # every document as often as it may
            else:
                reached = np.cumsum(gained[r["source"]])
                k = int(np.searchsorted(reached, goal))
                r["cell"] = k if k == 0 or reached[k] - goal < goal - reached[k - 1] else k - 1
    return Plan(float(total), rows)


def mix(sized: DataFrame, plan: Plan, seed: int = 17) -> DataFrame:
    """One row per copy, in a globally shuffled order: the columns of ``sized``, ``copy_no``, ``shuffle_key``.

    Documents of unlisted or null sources take no part.  Texts without tokens may
    be drawn, they add nothing to any share.
    """
    cells = {r["source"]: (r["cell"], r["max_repeats"]) for r in plan.rows if r["cell"] >= 0}
    names = sized.columns

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            source, u = np.asarray(b.column("source").to_pylist(), dtype=object), b.column("_u").to_numpy()
            count = np.zeros(len(u), np.int32)
            for s in set(source.tolist()):
                cell, limit = cells[s]
                mine = source == s
                for j in range(1, limit + 1):
                    count[mine] += copies_at_least(u[mine], j) <= cell
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(count)], names=[*names, "_copies"])

    listed = sized.filter(F.col("source").isin(list(cells))).withColumn("_u", _uniform("doc_id", seed))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sized.schema) + ", _copies int"
    drawn = listed.mapInArrow(draw, schema).filter("_copies > 0")
    copies = drawn.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("_copies")))).drop("_copies")
    keyed = copies.withColumn("shuffle_key", F.xxhash64(F.lit(seed + 1), "doc_id", "copy_no"))
    return keyed.orderBy("shuffle_key", "doc_id", "copy_no")


def report(mixed: DataFrame, plan: Plan) -> DataFrame:
    """One row a listed source: target share, share aimed at, share reached, sizes, copies, most repeats."""
    spark = mixed.sparkSession
    schema = "source string, target_share double, share_aimed double, max_repeats int, available_tokens long"
    listed = spark.createDataFrame([(r["source"], r["target_share"], float(r["share"]), r["max_repeats"], r["available"]) for r in plan.rows], schema)
    got = mixed.groupBy("source").agg(F.sum("n_tokens").alias("mixed_tokens"), F.count(F.lit(1)).alias("n_copies"), F.max("copy_no").alias("most_repeats"))
    whole = got.agg(F.sum("mixed_tokens").alias("whole"))
    return (
        listed.join(got, "source", "left")
        .join(F.broadcast(whole))  # one row
        .select(*listed.columns, F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens"), F.coalesce("n_copies", F.lit(0)).alias("n_copies"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), F.coalesce(F.col("mixed_tokens") / F.col("whole"), F.lit(0.0)).alias("share_reached"))
    )
