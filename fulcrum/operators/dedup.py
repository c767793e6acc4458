"""Greedy star clusters of similar nodes and their merged records."""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Callable, Iterator, Sequence
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fulcrum.durable import Workspace
from fulcrum.operators.skew import numbered, spread_join


#: Undecided pairs (each in both directions) that one task decides by the plain scan: 32 MB of integers.
SCAN_PAIRS = 2_000_000


def _scan(pairs: DataFrame) -> DataFrame:
    """``(seed)`` of at most SCAN_PAIRS pairs ``(a, b)``, both directions present: rows taken upwards, each neighbour of a seed passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches]
        a, b = np.concatenate([np.zeros((2, 0), np.int64), *parts], axis=1)
        order = np.argsort(a, kind="stable")
        rows, first = np.unique(a[order], return_index=True)
        near = np.split(np.searchsorted(rows, b[order]), first[1:]) if len(rows) else []
        passed = np.zeros(len(rows), bool)
        seeds = []
        for k, others in enumerate(near):
            if not passed[k]:
                seeds.append(rows[k])
                passed[others] = True
        yield pa.RecordBatch.from_arrays([pa.array(seeds, pa.int64())], names=["seed"])

    return pairs.repartition(1).mapInArrow(run, "seed long")


def star_clusters(links: DataFrame, max_rounds: int = 10_000, once: bool = False) -> DataFrame:
    """``(seed, member, pos)`` from links ``(i, j)`` between row numbers, either order.

    The result of scanning rows upwards and opening a cluster at each row no
    earlier cluster holds, with all its neighbours: seeds are the lexicographically
    first maximal independent set, clusters are stars and may overlap.  The links are
    written once; each round reads them and shuffles nothing but what is new of each row,
    see ``_seeds_by_state``, or ``_seeds_by_joins`` where the numbers reach too far.
    Raises if ``max_rounds`` rounds leave more.  ``once`` says that no link comes
    twice.  ``pos`` 0 is the seed, then neighbours ascending.
    """
    work = Workspace(links.sparkSession, "stars")
    narrow = links.filter("i <> j").select(F.least("i", "j").cast("long").alias("i"), F.greatest("i", "j").cast("long").alias("j"))
    edges = work.put(narrow if once else narrow.distinct(), "edges", **NUMBERS)
    ends = edges.agg(F.min("i").alias("lo"), F.max("j").alias("hi")).first()
    if ends.lo is None:
        return edges.select(F.col("i").alias("seed"), F.col("j").alias("member"), F.lit(0).cast("long").alias("pos"))
    if ends.hi - ends.lo < STATE_ROWS:
        stars = _stars_of(edges, _seeds_by_state(edges, ends.lo, ends.hi - ends.lo + 1, max_rounds), ends.lo)
    else:
        seeds = _seeds_by_joins(edges, work, max_rounds)
        both = edges.unionByName(edges.select(F.col("j").alias("i"), F.col("i").alias("j")))
        stars = both.join(seeds, both.i == seeds.seed).select("seed", F.col("j").alias("member")).union(seeds.select("seed", F.col("seed").alias("member")))
    return _placed(stars, work, edges)


def _placed(stars: DataFrame, work: Workspace, spent: DataFrame) -> DataFrame:
    """``stars`` with each member's place; only stars that lie across partitions need their rows before."""
    first = F.when(F.col("member") == F.col("seed"), F.lit(-1)).otherwise(F.col("member"))
    ordered = stars.repartitionByRange(F.col("seed"), first).sortWithinPartitions(F.col("seed"), first)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, 0
        for b in batches:
            seed = b.column(0).to_numpy()
            if not len(seed):
                continue
            begin = np.nonzero(np.concatenate([[seed[0] != last], seed[1:] != seed[:-1]]))[0]
            start = np.zeros(len(seed), np.int64)
            start[begin] = begin
            pos = np.arange(len(seed)) - np.maximum.accumulate(start)
            if not len(begin) or begin[0] > 0:  # the first rows go on with the batch before
                pos[: begin[0] if len(begin) else len(seed)] += held
            last, held = seed[-1], int(pos[-1]) + 1
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(pos)], names=["seed", "member", "pos"])

    rows = work.put(ordered.mapInArrow(count, "seed long, member long, pos long").withColumn("_p", F.spark_partition_id()), "placed", **NUMBERS)
    work.drop(spent)
    parts = rows.groupBy("seed", "_p").agg(F.count(F.lit(1)).alias("_n"))
    across = parts.groupBy("seed").agg(F.collect_list(F.struct("_p", "_n")).alias("x")).filter(F.size("x") > 1)  # at most one a partition
    before = across.select("seed", F.explode(F.transform("x", lambda a: F.struct(a["_p"].alias("_p"), F.aggregate("x", F.lit(0).cast("long"), lambda n, e: n + F.when(e["_p"] < a["_p"], e["_n"]).otherwise(0)).alias("_before")))).alias("y")).select("seed", "y.*")
    return rows.join(F.broadcast(before), ["seed", "_p"], "left").select("seed", "member", (F.col("pos") + F.coalesce("_before", F.lit(0))).alias("pos"))


#: Options that keep written row numbers small: a few bits for the difference to the one before.
NUMBERS = {"compression": "zstd", "parquet.writer.version": "v2"}
#: Row numbers from the first to the last of which a bit each is sent to the executors: 8 MB of seeds and as much of passed-over rows.
STATE_ROWS, CHUNK = 1 << 26, 1 << 16


def _bit(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


def _seeds_by_state(edges: DataFrame, lo: int, n: int, max_rounds: int) -> np.ndarray:
    """The seeds as bits from row ``lo`` on, from pairs ``(i, j)`` with ``i < j``.

    Every task holds a bit for each row that is a seed and one for each that was passed
    over.  A round reads the pairs: an undecided row with a seed before it is passed over;
    one without an undecided row before it is a seed.  Tasks hand on the bits, their
    chunks are united.  Once at most SCAN_PAIRS pairs are undecided, one task scans them,
    so that a long chain of ascending rows doesn't cost a round for each of them.
    """
    spark = edges.sparkSession
    wide = -(-n // CHUNK) * CHUNK
    seed, out, linked = (np.zeros(wide, bool) for _ in range(3))
    pairs = edges.select("i", "j").coalesce(spark.sparkContext.defaultParallelism)

    def open_of(b: pa.RecordBatch, taken: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i, j = b.column(0).to_numpy() - lo, b.column(1).to_numpy() - lo
        later = ~_bit(taken, j)
        i, j = i[later], j[later]
        return i, j, ~_bit(taken, i)

    for k in range(max_rounds):
        shared = spark.sparkContext.broadcast((np.packbits(seed), np.packbits(seed | out)))

        def look(batches: Iterator[pa.RecordBatch], shared=shared, first: bool = k == 0) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            seeds, taken = shared.value
            kinds = np.zeros((3, wide), bool)  # passed over; after an undecided row; in a pair at all
            undecided = 0
            for b in batches:
                i, j, free = open_of(b, taken)
                kinds[0, j[_bit(seeds, i)]] = True
                kinds[1, j[free]] = True
                undecided += int(free.sum())
                if first:
                    kinds[2, i] = kinds[2, j] = True
            for kind in range(3):
                whole = np.packbits(kinds[kind]).reshape(-1, CHUNK // 8)
                for c in np.nonzero(whole.any(1))[0].tolist():
                    yield pa.RecordBatch.from_pydict({"kind": pa.array([kind], pa.int32()), "chunk": pa.array([c], pa.int64()), "bits": pa.array([whole[c].tobytes()], pa.binary()), "n": pa.array([0], pa.int64())})
            yield pa.RecordBatch.from_pydict({"kind": pa.array([3], pa.int32()), "chunk": pa.array([0], pa.int64()), "bits": pa.array([b""], pa.binary()), "n": pa.array([undecided], pa.int64())})

        met = pairs.mapInArrow(look, "kind int, chunk long, bits binary, n long").groupBy("kind", "chunk").applyInArrow(_united, "kind int, chunk long, bits binary, n long").toArrow()
        passed, blocked, undecided = np.zeros(wide, bool), np.zeros(wide, bool), 0
        for kind, chunk, bits, many in zip(*(met.column(c).to_pylist() for c in ("kind", "chunk", "bits", "n")), strict=True):
            if kind == 3:
                undecided = many
            else:
                (passed, blocked, linked)[kind][chunk * CHUNK : (chunk + 1) * CHUNK] = np.unpackbits(np.frombuffer(bits, np.uint8))
        shared.unpersist()
        out |= passed
        seed |= linked & ~seed & ~out & ~blocked
        if not (linked & ~seed & ~out).any():
            return np.packbits(seed)
        if 0 < undecided <= SCAN_PAIRS:
            now = spark.sparkContext.broadcast(np.packbits(seed | out))
            near = spark.sparkContext.broadcast(np.packbits(seed))

            def still(batches: Iterator[pa.RecordBatch], now=now, near=near) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
                for b in batches:
                    i, j, free = open_of(b, now.value)
                    # a row with a seed before it is passed over: the pair with the seed says so
                    use = free | _bit(near.value, i)
                    i, j = i[use] + lo, j[use] + lo
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([i, j])), pa.array(np.concatenate([j, i]))], names=["a", "b"])

            found = _scan(pairs.mapInArrow(still, "a long, b long")).toArrow().column("seed").to_numpy() - lo
            seed[found] = True
    raise RuntimeError(f"rows are undecided after {max_rounds} rounds")


def _united(t: pa.Table) -> pa.Table:
    """The bits of one chunk from all tasks, or the sum of what they counted."""
    bits = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in t.column("bits").to_pylist()])
    return pa.table({"kind": t.column("kind")[:1], "chunk": t.column("chunk")[:1], "bits": pa.array([bits.tobytes()], pa.binary()), "n": pa.array([sum(t.column("n").to_pylist())], pa.int64())})


def _stars_of(edges: DataFrame, seeds: np.ndarray, lo: int) -> DataFrame:
    """``(seed, member)``: seeds, given as bits, with all their neighbours and themselves."""
    spark = edges.sparkSession
    shared = spark.sparkContext.broadcast(seeds)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i, j = b.column(0).to_numpy(), b.column(1).to_numpy()
            up, down = _bit(shared.value, i - lo), _bit(shared.value, j - lo)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([i[up], j[down]])), pa.array(np.concatenate([j[up], i[down]]))], names=["seed", "member"])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in b.column(0).to_pylist():
                at = pa.array(np.nonzero(np.unpackbits(shared.value[c * CHUNK // 8 : (c + 1) * CHUNK // 8]))[0] + c * CHUNK + lo)
                yield pa.RecordBatch.from_arrays([at, at], names=["seed", "member"])

    selves = spark.range(0, len(seeds) * 8 // CHUNK).mapInArrow(own, "seed long, member long")
    return edges.mapInArrow(near, "seed long, member long").unionByName(selves)


def _seeds_by_joins(edges: DataFrame, work: Workspace, max_rounds: int) -> DataFrame:
    """``(seed)``: the same in joins.  Each round selects every undecided row without a smaller undecided neighbour and rules out its neighbours."""
    edges = work.put(edges.select(F.explode(F.array(F.struct(F.col("i").alias("a"), F.col("j").alias("b")), F.struct(F.col("j").alias("a"), F.col("i").alias("b")))).alias("e")).select("e.*"), "both")
    open_edges, seeds = edges, None
    for _ in range(max_rounds):
        if open_edges.count() <= SCAN_PAIRS:
            break
        chosen = work.put(open_edges.groupBy("a").agg(F.min("b").alias("m")).filter("a < m").select(F.col("a").alias("seed")), "chosen")
        # rows whose undecided neighbours all went are seeds themselves, found below as lone rows
        out = edges.join(chosen, edges.a == chosen.seed, "left_semi").select(F.col("b").alias("x")).union(chosen.select("seed")).distinct()
        alive = work.put(open_edges.join(out, open_edges.a == out.x, "left_anti"), "alive")
        left = work.put(alive.join(out, alive.b == out.x, "left_anti"), "open")
        lone = alive.select(F.col("a").alias("seed")).distinct().join(left.select(F.col("a").alias("seed")).distinct(), "seed", "left_anti")
        seeds = work.put(chosen.union(lone) if seeds is None else seeds.union(chosen).union(lone), "seeds")
        if open_edges is not edges:
            work.drop(open_edges)
        work.drop(alive)
        open_edges = left
    else:
        raise RuntimeError(f"more than {SCAN_PAIRS} pairs are undecided after {max_rounds} rounds")
    rest = _scan(open_edges)
    seeds = work.put(rest if seeds is None else seeds.union(rest), "seeds")
    work.drop(edges)
    return seeds


def _union_sources(clusters: DataFrame, base: DataFrame, listed: DataFrame) -> DataFrame:
    """``(seed, sources)``: the base's list as it is, then each source id new to it, by member order.

    ``listed``: ``(seed, pos, node_id, sources)`` of the members.
    """
    rows = listed.join(base.select("seed", F.col("base_pos"), F.col("node_id").alias("base_id")), "seed")
    flat = rows.select("seed", "pos", "node_id", "base_pos", "base_id", F.posexplode("sources").alias("k", "s"))
    own = flat.filter("pos = base_pos").select("seed", F.lit(0).alias("turn"), F.lit(0).cast("long").alias("pos"), "k", "s")
    others = flat.filter("pos <> base_pos AND node_id <> base_id")
    first = others.groupBy("seed", F.col("s.source_id").alias("source_id")).agg(F.min(F.struct("pos", "k", "s")).alias("f"))
    fresh = first.join(own.select("seed", F.col("s.source_id").alias("source_id")).distinct(), ["seed", "source_id"], "left_anti").select("seed", F.lit(1).alias("turn"), "f.pos", "f.k", "f.s")
    merged = own.unionByName(fresh).groupBy("seed").agg(F.array_sort(F.collect_list(F.struct("turn", "pos", "k", "s"))).alias("x"))
    return clusters.select("seed").distinct().join(merged, "seed", "left").select("seed", F.coalesce(F.transform("x", lambda e: e["s"]), F.array().cast("array<struct<source_type:string,source_id:string,evidence_quote:string>>")).alias("sources"))


def bases(nodes: DataFrame, clusters: DataFrame) -> DataFrame:
    """``(seed, node_id)`` of each cluster's base: what ``merge_clusters`` gives without the united sources."""
    sure = clusters.join(nodes.select(F.col("ord").alias("member"), F.coalesce("confidence", F.lit(float("-inf"))).alias("confidence")), "member")
    best = sure.groupBy("seed").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "pos", "member")).alias("b")).select("seed", F.col("b.member").alias("ord"))
    return best.join(nodes.select("ord", "node_id"), "ord").select("seed", "node_id")


def merge_clusters(nodes: DataFrame, clusters: DataFrame, shared_lists: bool = True) -> DataFrame:
    """One merged record a cluster: ``(seed, ord, node_id, confidence, sources)`` of its base.

    The base has the largest confidence, the seed first among equals, then the
    smaller row.  Sources are united by id, the first one stands; members that
    share the base's node id add none.  With ``shared_lists`` a merge changes its
    base's own list, so a base that is a member of a later cluster carries the
    earlier union along, as the original system's results do; without it every
    merge sees the original lists.  Rounds go on until no list changes, which takes as
    many as the longest run of clusters that are each based on the next one's member.
    A merged record holds its sources in one row, as the record type has it.
    """
    work = Workspace(nodes.sparkSession, "merge")
    members = clusters.join(nodes.select(F.col("ord").alias("member"), "node_id", F.coalesce("confidence", F.lit(float("-inf"))).alias("confidence"), "sources"), "member")
    members = work.put(members, "members")
    base = work.put(members.groupBy("seed").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "pos", "member", "node_id")).alias("b")).select("seed", F.col("b.member").alias("base_row"), F.col("b.pos").alias("base_pos"), F.col("b.node_id").alias("node_id"), (-F.col("b.c")).alias("confidence")), "base")
    lists = work.put(_union_sources(clusters, base, members.select("seed", "pos", "node_id", "sources")), "lists0")
    # what each member carried when its cluster was merged: the union of the last earlier cluster based on it
    carried = members.select("seed", "pos", "member").join(base.select(F.col("base_row").alias("member"), F.col("seed").alias("earlier")), "member").filter("earlier < seed").groupBy("seed", "pos").agg(F.max("earlier").alias("earlier"))
    carried = work.put(carried, "carried")
    same = not shared_lists or carried.isEmpty()
    while not same:
        seen = members.join(carried, ["seed", "pos"], "left").join(lists.select(F.col("seed").alias("earlier"), F.col("sources").alias("grown")), "earlier", "left")
        again = work.put(_union_sources(clusters, base, seen.select("seed", "pos", "node_id", F.coalesce("grown", "sources").alias("sources"))), "lists")
        same = again.join(lists.withColumnRenamed("sources", "old"), "seed").filter("sources <> old").isEmpty()
        work.drop(lists)
        lists = again
    return base.join(lists, "seed").select("seed", F.col("base_row").alias("ord"), "node_id", F.when(F.col("confidence") > float("-inf"), F.col("confidence")).alias("confidence"), "sources")


def dedup_nodes(nodes: DataFrame, links: DataFrame, shared_lists: bool = True) -> DataFrame:
    """``(out_ord, ord, node_id, confidence, sources)``: untouched nodes in order, then the merged ones by seed.

    Without links the input comes back unchanged.
    """
    clusters = star_clusters(links)
    merged = merge_clusters(nodes, clusters, shared_lists)
    free = nodes.join(clusters.select(F.col("member").alias("ord")).distinct(), "ord", "left_anti").select(F.lit(0).alias("turn"), F.col("ord").alias("place"), "ord", "node_id", "confidence", "sources")
    return free.unionByName(merged.select(F.lit(1).alias("turn"), F.col("seed").alias("place"), "ord", "node_id", "confidence", "sources"))


def id_map(nodes: DataFrame, clusters: DataFrame, merged: DataFrame) -> DataFrame:
    """``(old_id, new_id)``: merged-away ids and what they became; of several clusters the first seed's."""
    earliest = clusters.groupBy("member").agg(F.min("seed").alias("seed"))  # numbers are united before ids are joined
    kept = earliest.join(merged.select("seed", F.col("node_id").alias("new_id")), "seed").join(nodes.select(F.col("ord").alias("member"), F.col("node_id").alias("old_id")), "member")
    return kept.groupBy("old_id").agg(F.min_by("new_id", "seed").alias("new_id")).filter("old_id <> new_id")


def remap_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends rewritten; ends without a new id stay.  An end that very many edges share is spread."""
    out, rows = edges, edges.count()
    for end in ("source_node_id", "target_node_id"):
        out = spread_join(out, ids.select(F.col("old_id").alias(end), F.col("new_id").alias("_new")), end, rows).withColumn(end, F.coalesce("_new", end)).drop("_new")
    return out.select(*edges.columns)


#: Members of a cluster that a task holds in memory; the others lie in a file.
HELD = 1_000


class Members(Sequence):
    """All members of a large cluster in order, read from a stream; those after the first HELD come from a file each time."""

    def __init__(self, rows: Iterator[dict]) -> None:
        self._head = list(islice(rows, HELD))
        self._rest, self._size = tempfile.TemporaryFile(), len(self._head)
        for r in rows:
            pickle.dump(r, self._rest)
            self._size += 1

    def __len__(self) -> int:
        return self._size

    def __iter__(self) -> Iterator[dict]:
        yield from self._head
        at = 0
        for _ in range(self._size - len(self._head)):
            self._rest.seek(at)
            row = pickle.load(self._rest)  # noqa: S301
            at = self._rest.tell()
            yield row

    def __getitem__(self, k):  # noqa: ANN001, ANN204
        if isinstance(k, slice):
            lo, hi, step = k.indices(self._size)
            return list(islice(self, lo, hi, step)) if step > 0 else list(self)[k]
        k = k + self._size if k < 0 else k
        if not 0 <= k < self._size:
            raise IndexError(k)
        return self._head[k] if k < len(self._head) else next(islice(self, k, None))


Decision = Callable[[Sequence[dict]], dict]


def decisions(nodes: DataFrame, clusters: DataFrame, decide: Decision) -> tuple[DataFrame, DataFrame]:
    """``(seed, decision, title, description, parent)`` of every cluster, and ``(seed, pos, child)`` of those under HIERARCHY.

    ``decide`` gets a cluster's members in order, as dicts, and returns
    ``decision`` (MERGE, HIERARCHY, DISTINCT) and, for MERGE, a canonical title and
    description; the title is cut at 200 letters.  Clusters of more than HELD
    members come as Members, a sequence of all of them that is streamed from the
    sorted partition to a file.  Under HIERARCHY all members but the first become
    its children, by a join.
    """
    work = Workspace(nodes.sparkSession, "decide")
    named = nodes.select(F.col("ord").alias("member"), "node_id", "title", "description")
    rows = work.put(clusters.join(named, "member").select("seed", "pos", "node_id", "title", "description"), "members")
    schema = pa.schema([("seed", pa.int64()), *((c, pa.string()) for c in ("decision", "title", "description", "parent")), ("first", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (r for b in batches for k in range(0, b.num_rows, HELD) for r in b.slice(k, HELD).to_pylist())
        for seed, own in groupby(stream, lambda r: r["seed"]):
            few = list(islice(own, HELD + 1))
            members = few if len(few) <= HELD else Members(r for part in (few, own) for r in part)
            got = decide(members)
            kind, first = got.get("decision", "MERGE"), members[0]
            row = {"seed": seed, "decision": kind, "title": (got.get("canonical_title") or first["title"] or "")[:200], "description": got.get("canonical_description") or first["description"], "parent": first["node_id"] if kind == "HIERARCHY" and len(members) > 1 else None, "first": first["pos"]}
            yield pa.RecordBatch.from_pylist([row], schema=schema)

    ordered = rows.repartition("seed").sortWithinPartitions("seed", "pos")
    decided = work.put(ordered.mapInArrow(run, "seed long, decision string, title string, description string, parent string, first long"), "decided")
    parents = decided.filter("decision = 'HIERARCHY'").select("seed", "first")
    children = spread_join(rows.select("seed", "pos", "node_id"), parents, "seed", rows.count(), "inner").filter("pos > first")
    return decided.drop("first"), children.select("seed", "pos", F.col("node_id").alias("child"))


def disambiguate(nodes: DataFrame, clusters: DataFrame, decide: Decision) -> DataFrame:
    """``decisions`` with each cluster's ``children`` as one array, in order; take the two tables where clusters are huge."""
    decided, children = decisions(nodes, clusters, decide)
    listed = children.groupBy("seed").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "child"))), lambda e: e["child"]).alias("children"))
    return decided.join(listed, "seed", "left").withColumn("children", F.coalesce("children", F.array().cast("array<string>")))
