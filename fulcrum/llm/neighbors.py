"""Most similar vectors of every vector: additive quantisation with exact reranking.

A tree of unit centroids, two levels deep, sends every vector to one cell (the
vector's first code) and every query to the few cells whose centroids are about as
close as its own.  Inside a cell, a vector is the cell's mean plus its gain times a
sum of full-dimensional residual codewords found by beam search, so regions of any
density are coded equally well.  Gains and reconstruction norms are stored; a
query scores the codes through lookup tables and the best ones are reranked
with the vectors themselves.

Bounds, all parameters.  There are as many cells as ``cell_rows`` rows a cell ask
for, whatever the table's size.  The coarse centroids and the codebooks are fitted on
at most ``sample_max`` rows on the driver; each coarse centroid's cells are fitted in a
task of their own, on at most ``64 * max_fine`` rows; every row is indexed.  The table of
cells that is broadcast holds at most about ``region_rows / cell_rows`` rows of 528 bytes (35 MB): a
larger collection is first cut into regions, which are written, indexed and searched
one after the other, and queries also visit the regions next to their own.  A cell that holds more
than ``block_rows`` rows is cut into blocks, one with more than ``query_rows`` queries deals
them to several tasks, so no task holds a whole dense region.  Vectors that
occur more often than ``max(64, N / 10000)`` times are answered from their group's
smallest ids: at most 10,000 such groups can exist, which bounds what is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fulcrum.durable import Workspace
from fulcrum.functions.keys import same_id


@dataclass(frozen=True)
class Params:
    dim: int = 64
    k: int = 5
    cell_rows: int = 4000
    block_rows: int = 8000
    query_rows: int = 32_000
    fine: int = 256
    max_fine: int = 1024
    coarse_probes: int = 6
    region_rows: int = 1 << 28
    region_margin: float = 0.05
    region_probes: int = 3
    margin: float = 0.05
    max_probes: int = 6
    levels: int = 6
    codewords: int = 256
    beam: int = 4
    rerank: int = 128
    sample_max: int = 131_072
    seed: int = 7


@dataclass
class Router:
    """Coarse centroids, and below each of them its cells: ``cells`` of coarse centroid c are rows ``first[c]`` to ``first[c + 1]``.

    ``cells``: unit centroids that route; ``means``: the first codewords; ``sizes``: expected rows of each cell.
    """

    coarse: np.ndarray
    first: np.ndarray
    cells: np.ndarray
    means: np.ndarray
    sizes: np.ndarray

    def probe(self, x: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
        """The ``2 * max_probes`` nearest cells of each vector below its nearest coarse centroids, nearest first, and their cosines."""
        width = min(2 * p.max_probes, len(self.cells))
        if len(self.coarse) == 1:
            s = x @ self.cells.T
            best = np.argpartition(-s, width - 1, axis=1)[:, :width]
            best = np.take_along_axis(best, np.argsort(-np.take_along_axis(s, best, 1), axis=1, kind="stable"), 1)
            return best, np.take_along_axis(s, best, 1)
        tries = min(p.coarse_probes, len(self.coarse))
        towards = x @ self.coarse.T
        top = np.argpartition(-towards, tries - 1, axis=1)[:, :tries]
        score = np.full((len(x), tries * width), -2.0, np.float32)
        cell = np.zeros((len(x), tries * width), np.int64)
        for slot in range(tries):
            order = np.argsort(top[:, slot], kind="stable")
            for rows in np.split(order, np.nonzero(np.diff(top[order, slot]))[0] + 1):
                c = top[rows[0], slot] if len(rows) else 0
                lo, hi = self.first[c], self.first[c + 1]
                s = x[rows] @ self.cells[lo:hi].T
                w = min(width, s.shape[1])
                best = np.argpartition(-s, w - 1, axis=1)[:, :w]
                score[rows, slot * width : slot * width + w] = np.take_along_axis(s, best, 1)
                cell[rows, slot * width : slot * width + w] = lo + best
        pick = np.argsort(-score, axis=1, kind="stable")[:, :width]
        return np.take_along_axis(cell, pick, 1), np.take_along_axis(score, pick, 1)

    def visits(self, cell: np.ndarray, near: np.ndarray, p: Params) -> np.ndarray:
        """Which of its probed cells a query visits: those about as near as its own, and further ones until enough rows are met."""
        close = near >= near[:, :1] - p.margin
        held = np.cumsum(self.sizes[cell], axis=1) - self.sizes[cell]  # rows of the cells visited before
        return (near > -1.5) & ((close & (np.arange(near.shape[1]) < p.max_probes)) | (held < 2 * p.rerank))


@dataclass
class Codebooks:
    """The router, the residual codebooks, and how many blocks and dealt query lots each cell has."""

    router: Router
    levels: list[np.ndarray] = field(default_factory=list)
    blocks: np.ndarray | None = None
    lots: np.ndarray | None = None


#: Sampled rows that are fitted at once: their distances to all paths and words of the beam take 16 MB an array, however large the sample is.
FIT_ROWS = 4096


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, unit: bool = False, rounds: int = 10) -> np.ndarray:
    k = max(1, min(k, len(x)))
    cents = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        half = 0.5 * (cents * cents).sum(1)
        near = np.concatenate([(x[lo : lo + FIT_ROWS] @ cents.T - half).argmax(1) for lo in range(0, len(x), FIT_ROWS)])
        count = np.bincount(near, minlength=k)
        order, there = np.argsort(near, kind="stable"), count > 0
        starts = np.concatenate([[0], np.cumsum(count)[:-1]])[there]
        cents[there] = np.add.reduceat(x[order], starts, axis=0) / count[there][:, None]
        if not there.all():
            cents[~there] = x[rng.choice(len(x), int((~there).sum()))]
        if unit:
            cents /= np.maximum(np.linalg.norm(cents, axis=1, keepdims=True), 1e-12)
    return cents.astype(np.float32)


def beam_encode(rest: np.ndarray, books: list[np.ndarray], beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes and final residuals of the best of ``beam`` code paths, level by level."""
    n, dim = rest.shape
    left, codes = rest[:, None, :], np.zeros((n, 1, 0), np.uint8)
    for book in books:
        b, k = left.shape[1], len(book)
        err = (left * left).sum(2)[:, :, None] - 2 * (left.reshape(-1, dim) @ book.T).reshape(n, b, k) + (book * book).sum(1)
        err = err.reshape(n, b * k)
        keep = min(beam, b * k)
        best = np.argpartition(err, keep - 1, axis=1)[:, :keep]
        path, word = best // k, best % k
        left = np.take_along_axis(left, path[:, :, None], 1) - book[word]
        codes = np.concatenate([np.take_along_axis(codes, path[:, :, None], 1), word[:, :, None].astype(np.uint8)], 2)
    pick = (left * left).sum(2).argmin(1)
    rows = np.arange(n)
    return codes[rows, pick], left[rows, pick]


def unit_residuals(rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    gain = np.maximum(np.linalg.norm(rest, axis=1), 1e-9).astype(np.float32)
    return rest / gain[:, None], gain


def fit_cells(x: np.ndarray, cells: int, weight: float, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit centroids, means and expected rows of the cells of sampled vectors that stand for ``weight`` rows each."""
    cents = kmeans(x, cells, np.random.default_rng(p.seed), unit=True)
    cell = np.concatenate([(x[lo : lo + FIT_ROWS] @ cents.T).argmax(1) for lo in range(0, len(x), FIT_ROWS)])
    count = np.bincount(cell, minlength=len(cents))
    means = np.stack([np.bincount(cell, weights=x[:, j], minlength=len(cents)) for j in range(x.shape[1])], axis=1)
    return cents, (means / np.maximum(count, 1)[:, None]).astype(np.float32), count * weight


def fit(x: np.ndarray, router: Router, rows: float, asked: float, p: Params) -> Codebooks:
    """Residual codebooks from sampled unit vectors; ``rows`` are indexed and ``asked`` ask, of which the sample tells how they spread."""
    n = len(router.cells)
    parts = [slice(lo, lo + FIT_ROWS) for lo in range(0, len(x), FIT_ROWS)]
    rest, held, visited = np.empty_like(x), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for part in parts:
        cell, near = router.probe(x[part], p)
        rest[part] = unit_residuals(x[part] - router.means[cell[:, 0]])[0]
        held += np.bincount(cell[:, 0], minlength=n)
        visited += np.bincount(cell[router.visits(cell, near, p)], minlength=n)
    rng = np.random.default_rng(p.seed)
    levels: list[np.ndarray] = []
    left = rest
    for _ in range(p.levels):
        levels.append(kmeans(left, min(256, p.codewords), rng, rounds=5))
        left = np.concatenate([beam_encode(rest[part], levels, p.beam)[1] for part in parts])
    own = held / len(x) * rows
    blocks = np.maximum(1, np.ceil(np.maximum(own, router.sizes) / p.block_rows)).astype(np.int64)
    visits = visited / len(x) * asked
    return Codebooks(router, levels, blocks, np.maximum(1, np.ceil(visits / p.query_rows)).astype(np.int64))


def _bytes_column(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    n, width = len(rows), rows.itemsize * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * width), pa.py_buffer(rows)])


def _matrix(column: pa.Array | pa.ChunkedArray, dtype: type, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if len(column) == 0:
        return np.zeros((0, width), dtype)
    start, stop = np.frombuffer(column.buffers()[1], np.int32)[[column.offset, column.offset + len(column)]]
    return np.frombuffer(column.buffers()[2], np.uint8)[start:stop].view(dtype).reshape(len(column), width)


def unit_vectors(batch: pa.RecordBatch, dim: int) -> tuple[pa.Array, np.ndarray]:
    """Ids and unit vectors of the usable rows: ``dim`` finite values, not all zero.

    Directions are rounded to six decimals, so copies that differ only in length
    become equal.
    """
    ids, vectors = batch.column(0), batch.column(1)
    good = pc.fill_null(pc.and_(pc.equal(pc.list_value_length(vectors), dim), pc.is_valid(ids)), False)
    ids, vectors = ids.filter(good), vectors.filter(good)
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    with np.errstate(invalid="ignore", over="ignore"):
        norm = np.sqrt((x * x).sum(1))
    usable = np.isfinite(norm) & (norm > 0)
    x = np.round(x[usable] / norm[usable][:, None], 6) + 0.0
    return ids.filter(pa.array(usable)), x.astype(np.float32)


def _digest(x: np.ndarray) -> np.ndarray:
    """128 bits a vector, as two 64-bit integers."""
    words = np.ascontiguousarray(x).view(np.uint32).astype(np.uint64)
    out = np.empty((len(x), 2), np.uint64)
    for j in range(2):
        factor = np.random.default_rng(11 + j).integers(1, 2**63, words.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        with np.errstate(over="ignore"):
            h = (words * factor).sum(1, dtype=np.uint64)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
        out[:, j] = h
    return out.view(np.int64)


def _crc(ids: pa.Array) -> np.ndarray:
    """32 bits of every id, the same on every run."""
    import zlib

    return np.fromiter((zlib.crc32(s.encode()) for s in ids.to_pylist()), np.int64, len(ids))


def _search_block(q: np.ndarray, q_ids: np.ndarray, ids: np.ndarray, x: np.ndarray, codes: np.ndarray, gains: np.ndarray, norms: np.ndarray, base: np.ndarray, levels: list[np.ndarray], p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest of the block's vectors for each query: (query row, neighbour row, cosine).

    ``ids`` must ascend; equal vectors are scored once and keep their k+1 smallest ids.
    """
    view = np.ascontiguousarray(x).view(np.dtype((np.void, x.itemsize * x.shape[1]))).ravel()
    _, first, group = np.unique(view, return_index=True, return_inverse=True)
    order = np.argsort(group, kind="stable")
    count = np.bincount(group)
    starts = np.concatenate([[0], np.cumsum(count)[:-1]])
    width = min(p.k + 1, int(count.max()))
    slot = starts[:, None] + np.arange(width)
    members = np.where(np.arange(width) < np.minimum(count, width)[:, None], order[np.minimum(slot, len(order) - 1)], -1)
    ux, ucodes = x[first], codes[first]
    scale = (1.0 / np.maximum(norms[first], 1e-9)).astype(np.float32)[:, None]
    lift = gains[first][:, None]
    n = len(ux)
    take = min(p.rerank, n)
    ux64 = ux.astype(np.float64)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, len(q), 256):
        part = q[at : at + 256]
        score = np.take(levels[0] @ part.T, ucodes[:, 0], axis=0)
        for m, book in enumerate(levels[1:], 1):
            score += np.take(book @ part.T, ucodes[:, m], axis=0)
        score *= lift
        score += part @ base
        score *= scale
        rows = np.ascontiguousarray(score.T)
        best = np.argpartition(rows, n - take, axis=1)[:, n - take :] if take < n else np.broadcast_to(np.arange(n), rows.shape)
        exact = np.einsum("qrd,qd->qr", ux64[best], part.astype(np.float64))
        keep = min(p.k + 1, take)
        top = np.argpartition(-exact, keep - 1, axis=1)[:, :keep] if keep < take else np.broadcast_to(np.arange(take), exact.shape)
        # equal cosines straddling the cut are settled by id: widen to all that tie with the last kept one
        edge = np.take_along_axis(exact, top, 1).min(1)
        if ((np.round(exact, 9) >= np.round(edge, 9)[:, None]).sum(1) > keep).any():
            top = np.broadcast_to(np.arange(take), exact.shape)
        cos = np.round(np.take_along_axis(exact, top, 1) * 1e9).astype(np.int64)
        near = members[np.take_along_axis(best, top, 1)]
        cos = np.broadcast_to(cos[:, :, None], near.shape).reshape(len(part), -1)
        near = near.reshape(len(part), -1)
        ok = (near >= 0) & (ids[near] != q_ids[at : at + 256, None])
        key = np.where(ok, -cos * (1 << 30) + near, np.iinfo(np.int64).max)
        pick = np.argsort(key, axis=1, kind="stable")[:, : p.k]
        good = np.take_along_axis(ok, pick, 1)
        rows_q = np.broadcast_to(np.arange(at, at + len(part))[:, None], pick.shape)[good]
        out.append((rows_q, np.take_along_axis(near, pick, 1)[good], np.take_along_axis(cos, pick, 1)[good]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))  # type: ignore[return-value]


PREPARED = "id string, x binary, own boolean"
FOUND = "id string, neighbor string, cosine long"


def top_neighbors(vectors: DataFrame, id_col: str = "node_id", vector_col: str = "embedding", params: Params | None = None) -> DataFrame:
    """``(id, neighbor, cosine)``: the k most similar vectors of every vector.

    A null, all-zero, wrongly sized or NaN-holding vector, or one without an id,
    takes no part.  Equal cosines go to the smaller id.  Repeated rows of one id
    count once as long as their vectors are equal.  An empty table gives no rows;
    fewer than k+1 vectors give as many neighbours as there are.
    """
    p = params or Params()
    spark = vectors.sparkSession
    source = vectors.select(same_id(id_col).alias("id"), F.col(vector_col).cast("array<float>").alias("v"))
    rows = vectors.count()
    if rows == 0:
        return spark.createDataFrame([], FOUND).select("id", "neighbor", (F.col("cosine") / 1e9).alias("cosine"))
    hot, firsts = _hot_copies(spark, source, rows, p)

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, x = unit_vectors(b, p.dim)
            if hot:
                group = [hot.get(tuple(d)) for d in _digest(x).tolist()]
                keep = np.fromiter((g is None or i in firsts[g] for g, i in zip(group, ids.to_pylist(), strict=True)), bool, len(x))
                ids, x = ids.filter(pa.array(keep)), x[keep]
            yield pa.RecordBatch.from_arrays([ids, _bytes_column(x), pa.array(np.ones(len(x), bool))], names=["id", "x", "own"])

    found = _search(source, rows, rows, prepare, p)
    best = Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbor")
    out = found.withColumn("rn", F.row_number().over(best)).filter(F.col("rn") <= p.k).drop("rn")
    if hot:
        out = out.join(F.broadcast(spark.createDataFrame([(i,) for g in firsts for i in g], "id string")), "id", "left_anti").unionByName(_of_copies(source, hot, firsts, p))
    return out.select("id", "neighbor", (F.col("cosine") / 1e9).alias("cosine"))


Prepare = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _as_is(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from batches


def _sampled(rows: DataFrame, n: int, wanted: int, prepare: Prepare, p: Params) -> np.ndarray:
    """At most ``2 * wanted`` of the indexed vectors, chosen by the hash of their ids."""
    part = F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(min(1.0, wanted / n) * 1_000_000) + 1
    sample = rows.filter(part).mapInArrow(prepare, PREPARED).filter("own").select("id", "x").limit(2 * wanted).toArrow().sort_by("id")
    return _matrix(sample.column("x"), np.float32, p.dim)


def _search(rows: DataFrame, n: int, asked: int, prepare: Prepare, p: Params) -> DataFrame:
    """Nearest indexed vectors, unmerged, of every row; ``n`` rows are indexed (``own``), ``asked`` ask."""
    if n <= p.region_rows:
        return _search_region(rows, n, asked, prepare, p)
    spark = rows.sparkSession
    x = _sampled(rows, n, p.sample_max, prepare, p)
    if len(x) == 0:
        return spark.createDataFrame([], FOUND)
    shared = spark.sparkContext.broadcast(kmeans(x, -(-2 * n // p.region_rows), np.random.default_rng(p.seed), unit=True))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in prepare(batches):
            near = _matrix(b.column(1), np.float32, p.dim) @ shared.value.T
            far = np.sort(near, axis=1)[:, -min(p.region_probes, near.shape[1])]
            r, region = np.nonzero((near >= near.max(1, keepdims=True) - p.region_margin) & (near >= far[:, None]))
            own = (near.argmax(1)[r] == region) & b.column(2).to_numpy(zero_copy_only=False)[r]
            for lo in range(0, len(r), 20_000):
                sel = pa.array(r[lo : lo + 20_000])
                yield pa.RecordBatch.from_arrays([b.column(0).take(sel), b.column(1).take(sel), pa.array(own[lo : lo + 20_000]), pa.array(region[lo : lo + 20_000].astype(np.int32))], names=["id", "x", "own", "region"])

    dealt = Workspace(spark, "regions").put(rows.mapInArrow(deal, f"{PREPARED}, region int"), "dealt", by="region")
    sizes = dealt.groupBy("region").agg(F.count_if("own").alias("n"), F.count(F.lit(1)).alias("asked")).orderBy("region").collect()  # a row a region
    out = spark.createDataFrame([], FOUND)
    for r in sizes:
        mine = dealt.filter(F.col("region") == r.region).select("id", "x", "own")
        if r.n < n:
            out = out.unionByName(_search(mine, r.n, r.asked, _as_is, p))
        else:  # a region that can't be cut any further
            out = out.unionByName(_search_region(mine, r.n, r.asked, _as_is, p))
    return out


def _fine_cells(rows: DataFrame, x: np.ndarray, n: int, prepare: Prepare, p: Params) -> Router:
    """The router: coarse centroids from the sample, each one's cells fitted by a task of its own where there are many."""
    cells = max(1, n // p.cell_rows)
    if cells <= p.fine:
        cents, means, sizes = fit_cells(x, cells, n / len(x), p)
        return Router(np.ones((1, x.shape[1]), np.float32), np.array([0, len(cents)]), cents, means, sizes)
    spark = rows.sparkSession
    coarse = kmeans(x, -(-cells // p.fine), np.random.default_rng(p.seed), unit=True)
    held = np.bincount((x @ coarse.T).argmax(1), minlength=len(coarse)) / len(x) * n
    below = np.clip(np.ceil(held / p.cell_rows), 1, p.max_fine).astype(np.int64)
    rate = np.minimum(1.0, 64 * below / np.maximum(held, 1))
    shared = spark.sparkContext.broadcast((coarse, below, rate))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, _, share = shared.value
        for b in prepare(batches):
            c = (_matrix(b.column(1), np.float32, p.dim) @ centres.T).argmax(1)
            take = b.column(2).to_numpy(zero_copy_only=False) & (_crc(b.column(0)) % (1 << 20) < share[c] * (1 << 20))
            yield pa.RecordBatch.from_arrays([pa.array(c[take].astype(np.int32)), b.column(0).filter(pa.array(take)), b.column(1).filter(pa.array(take))], names=["coarse", "id", "x"])

    def cells_of(t: pa.Table) -> pa.Table:
        t = t.combine_chunks().sort_by("id")
        c = t.column("coarse")[0].as_py()
        _, many, share = shared.value
        cents, means, sizes = fit_cells(_matrix(t.column("x"), np.float32, p.dim), int(many[c]), 1 / share[c], p)
        return pa.table({"coarse": pa.array([c] * len(cents), pa.int32()), "cell": _bytes_column(cents), "mean": _bytes_column(means), "size": pa.array(sizes, pa.float64())})

    made = rows.mapInArrow(choose, "coarse int, id string, x binary").groupBy("coarse").applyInArrow(cells_of, "coarse int, cell binary, mean binary, size double").toArrow().sort_by("coarse")
    there, first = np.unique(made.column("coarse").to_numpy(), return_index=True)
    table = lambda c: _matrix(made.column(c), np.float32, p.dim)
    return Router(coarse[there], np.append(first, made.num_rows), table("cell"), table("mean"), made.column("size").to_numpy())


def _search_region(rows: DataFrame, n: int, asked: int, prepare: Prepare, p: Params) -> DataFrame:
    spark = rows.sparkSession
    x = _sampled(rows, max(n, 1), min(p.sample_max, max(20_000, 100 * (n // p.cell_rows))), prepare, p)
    if len(x) == 0:
        return spark.createDataFrame([], FOUND)
    books = spark.sparkContext.broadcast(fit(x, _fine_cells(rows, x, n, prepare, p), n, asked, p))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = books.value
        r = c.router
        width, lots = int(c.blocks.max()), int(c.lots.max())
        for b in prepare(batches):
            for lo in range(0, b.num_rows, 10_000):
                ids, own = b.column(0).slice(lo, 10_000), b.column(2).slice(lo, 10_000).to_numpy(zero_copy_only=False)
                x = _matrix(b.column(1).slice(lo, 10_000), np.float32, p.dim)
                best, near = r.probe(x, p)
                cell = best[:, 0]
                shape, gain = unit_residuals(x - r.means[cell])
                codes, left = beam_encode(shape, c.levels, p.beam)
                norms = np.linalg.norm(x - left * gain[:, None], axis=1).astype(np.float32)
                crc = _crc(ids)
                block, lot = crc % c.blocks[cell], crc >> 12
                q, at = np.nonzero(r.visits(best, near, p))
                target = best[q, at]
                q, target, nth = _repeated(q, target, c.blocks[target])
                dealt = lot[q] % c.lots[target]
                ask = np.ones(len(q), bool)
                # an indexed vector lies with every lot of queries that its block is asked by
                if lots > 1:
                    k, home, turn = _repeated(np.nonzero(own)[0], cell[own], c.lots[cell[own]])
                    spare = turn != lot[k] % c.lots[home]
                    q, target, nth = np.append(q, k[spare]), np.append(target, home[spare]), np.append(nth, block[k[spare]])
                    dealt, ask = np.append(dealt, turn[spare]), np.append(ask, np.zeros(int(spare.sum()), bool))
                owner = own[q] & (target == cell[q]) & (nth == block[q])
                code = pa.array([None] * len(q), pa.binary()) if not owner.any() else _bytes_column(codes).take(pa.array(np.where(owner, q, 0), mask=~owner))
                part = (target * width + nth) * lots + dealt
                for at in range(0, len(q), 20_000):  # bounded batches, however often a query is sent
                    hi = min(at + 20_000, len(q))
                    sel = q[at:hi]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(part[at:hi]), pa.array(cell[sel].astype(np.int32)), ids.take(pa.array(sel)), _bytes_column(x[sel]), code[at:hi], pa.array(gain[sel]), pa.array(norms[sel]), pa.array(ask[at:hi])],
                        names=["part", "cell", "id", "x", "code", "gain", "norm", "ask"],
                    )

    def search(table: pa.Table) -> pa.Table:
        c = books.value
        table = table.combine_chunks()
        q = _matrix(table.column("x"), np.float32, p.dim)
        q_ids = table.column("id").to_numpy(zero_copy_only=False)
        there = table.column("code").is_valid().to_numpy(zero_copy_only=False)
        asks = np.nonzero(table.column("ask").to_numpy(zero_copy_only=False))[0]
        mine = np.nonzero(there)[0]
        if len(mine) and len(asks):
            _, once = np.unique(q_ids[mine], return_index=True)  # ascending ids, each once
            mine = mine[once]
            codes = _matrix(table.column("code").filter(pa.array(there)), np.uint8, len(c.levels))[once]
            gains, norms = (table.column(n).to_numpy(zero_copy_only=False)[mine] for n in ("gain", "norm"))
            _, first = np.unique(q_ids[asks], return_index=True)
            ask = asks[first]
            cell = table.column("cell").to_numpy(zero_copy_only=False)[mine[0]]
            r, n, cos = _search_block(q[ask], q_ids[ask], q_ids[mine], q[mine], codes, gains, norms, c.router.means[cell], c.levels, p)
            return pa.table({"id": pa.array(q_ids[ask][r], pa.string()), "neighbor": pa.array(q_ids[mine][n], pa.string()), "cosine": pa.array(cos, pa.int64())})
        return pa.table({"id": pa.array([], pa.string()), "neighbor": pa.array([], pa.string()), "cosine": pa.array([], pa.int64())})

    routed = rows.mapInArrow(route, "part long, cell int, id string, x binary, code binary, gain float, norm float, ask boolean")
    return routed.groupBy("part").applyInArrow(search, FOUND)


def _repeated(q: np.ndarray, target: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every entry as often as ``times`` says, with its count from 0."""
    many = np.repeat(np.cumsum(times) - times, times)
    return np.repeat(q, times), np.repeat(target, times), np.arange(len(many)) - many


def _hot_copies(spark: SparkSession, source: DataFrame, rows: int, p: Params) -> tuple[dict[tuple[int, int], int], list[list[str]]]:
    """Digests of vectors with very many copies, and each group's k+1 smallest ids."""
    limit = max(64, rows // 10_000)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, x = unit_vectors(b, p.dim)
            d = _digest(x)
            yield pa.RecordBatch.from_arrays([ids, pa.array(d[:, 0]), pa.array(d[:, 1])], names=["id", "a", "b"])

    keyed = source.mapInArrow(digests, "id string, a long, b long")
    groups = keyed.groupBy("a", "b").count().filter(F.col("count") > limit).select("a", "b").collect()
    if not groups:
        return {}, []
    hot = {(r.a, r.b): n for n, r in enumerate(groups)}
    few = F.broadcast(spark.createDataFrame([(a, b, n) for (a, b), n in hot.items()], "a long, b long, g int"))
    first = Window.partitionBy("g").orderBy("id")
    members = keyed.join(few, ["a", "b"]).select("g", "id").withColumn("rn", F.row_number().over(first)).filter(F.col("rn") <= p.k + 1)
    firsts: list[list[str]] = [[] for _ in hot]
    for r in members.orderBy("g", "rn").collect():
        firsts[r.g].append(r.id)
    return hot, firsts


def _of_copies(source: DataFrame, hot: dict[tuple[int, int], int], firsts: list[list[str]], p: Params) -> DataFrame:
    """Members of the large copy groups with the k smallest other ids of their group, cosine 1."""

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, x = unit_vectors(b, p.dim)
            a, n = [], []
            for i, d in zip(ids.to_pylist(), _digest(x).tolist(), strict=True):
                if (g := hot.get(tuple(d))) is not None:
                    others = [o for o in firsts[g] if o != i][: p.k]
                    a += [i] * len(others)
                    n += others
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(n, pa.string()), pa.array([10**9] * len(a), pa.int64())], names=["id", "neighbor", "cosine"])

    return source.mapInArrow(members, "id string, neighbor string, cosine long")


def neighbor_pairs(neighbors: DataFrame) -> DataFrame:
    """Each pair in which one is among the other's nearest, once, smaller id first."""
    return neighbors.select(F.least("id", "neighbor").alias("node_a"), F.greatest("id", "neighbor").alias("node_b")).distinct()
