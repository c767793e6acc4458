"""Free-entered values to a canonical list: BK-trees over reference forms under edit distance.

A reference entry is known under several forms (its tag, its parts in either
order, its label, its aliases).  A value is reduced to its letters and digits
and looked up in a BK-tree under Levenshtein distance, a true metric: a subtree
is skipped only if the triangle inequality rules out every entry below it, so
every form within the threshold is found.  The tree is walked once for a whole
batch of values; at each node the distances to all values still in play are
computed together, bit-parallel.

A list of at most ``SHARD_FORMS`` forms (its forms are counted first) makes one tree,
which is broadcast.  A longer one is dealt into shards of about that many forms by the
hash of their entries, and never gathered anywhere: each shard meets the different
values in lots of ``LOT_VALUES``, and of the shards' nearest entries the nearest count.
Each shard gives its first and last tag at its smallest distance, so that a tie between
entries is seen wherever they lie.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fulcrum.durable import Workspace
from fulcrum.functions.keys import same_id, trim_blanks
from fulcrum.operators.skew import spread_join

SHARD_FORMS = 50_000
LOT_VALUES = 50_000
CACHE_VALUES = 200_000


class Form(NamedTuple):
    key: str
    tag: str


class Match(NamedTuple):
    distance: int
    key: str
    tag: str


class Nearest(NamedTuple):
    """The best of a shard for a value: abbreviations spelled out come first (turn 0), then the distance; the tags there."""

    turn: int
    distance: int
    first: str
    last: str


def words(value: str) -> list[str]:
    """Lower-case words; an abbreviating full stop stays on its word; camel case is split."""
    v = unicodedata.normalize("NFKC", value)
    v = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", v) if not v.isupper() else v
    return re.findall(r"[^\W_]+(?:\.(?![^\W_]))?", v.lower())


def squeeze(value: str) -> str:
    """Only the letters and digits, lower case."""
    return "".join(ch for ch in unicodedata.normalize("NFKC", value).lower() if ch.isalnum())


def threshold(length: int) -> int:
    """Edits allowed for a value of so many letters: about one in six, four at most, none below four letters."""
    return min(4, length // 6 + (length >= 4))


def levenshtein(a: str, b: str) -> int:
    """Plain edit distance of any two strings (the reference for the vectorised form)."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diag, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diag, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diag + (x != y))
    return row[-1]


class Texts:
    """Strings as a padded matrix of letter codes."""

    def __init__(self, strings: list[str], alphabet: dict[str, int]) -> None:
        self.length = np.array([len(s) for s in strings], np.int64)
        self.codes = np.zeros((len(strings), int(self.length.max(initial=0))), np.uint8 if len(alphabet) < 256 else np.uint32)
        for n, s in enumerate(strings):
            self.codes[n, : len(s)] = [alphabet.get(ch, 0) for ch in s]


def distances(pattern: str, texts: Texts, rows: np.ndarray, alphabet: dict[str, int]) -> np.ndarray:
    """Edit distance of one pattern to the chosen texts, bit-parallel over pattern positions.

    Patterns of more than 64 letters are cut into the plain routine.
    """
    m = len(pattern)
    length = texts.length[rows]
    if m == 0:
        return length
    if m > 64:
        back = {v: k for k, v in alphabet.items()}
        return np.array([levenshtein(pattern, "".join(back.get(c, "\0") for c in texts.codes[r, :n])) for r, n in zip(rows.tolist(), length.tolist(), strict=True)], np.int64)
    one = np.uint64(1)
    at = np.zeros(len(alphabet) + 1, np.uint64)
    for j, ch in enumerate(pattern):
        at[alphabet[ch]] |= one << np.uint64(j)
    at[0] = 0
    top = one << np.uint64(m - 1)
    pv = np.full(len(rows), np.uint64(0xFFFFFFFFFFFFFFFF))
    mv = np.zeros(len(rows), np.uint64)
    score = np.full(len(rows), m, np.int64)
    codes = texts.codes[rows]
    for j in range(int(length.max(initial=0))):
        eq = at[codes[:, j]]
        xv = eq | mv
        with np.errstate(over="ignore"):
            xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv)
        mh = pv & xh
        live = j < length
        score += (((ph & top) != 0) & live).astype(np.int64) - (((mh & top) != 0) & live)
        ph = (ph << one) | one
        pv = (mh << one) | ~(xv | ph)
        mv = ph & xv
    return score


class BKTree:
    """Forms in a metric tree; equal keys share a node."""

    def __init__(self, forms: list[Form]) -> None:
        by_key: dict[str, set[str]] = {}
        for f in forms:
            by_key.setdefault(f.key, set()).add(f.tag)
        self.keys = sorted(by_key)
        self.tags = [sorted(by_key[k]) for k in self.keys]
        letters = sorted({ch for k in self.keys for ch in k})
        self.alphabet = {ch: n + 1 for n, ch in enumerate(letters)}
        self.children: list[dict[int, int]] = [{} for _ in self.keys]
        texts = Texts(self.keys, self.alphabet)
        # place all keys level by level: those at one node are split by their distance to it
        self.root = 0 if self.keys else -1
        todo = [(0, np.arange(1, len(self.keys)))] if self.keys else []
        while todo:
            node, rest = todo.pop()
            if len(rest) == 0:
                continue
            d = distances(self.keys[node], texts, rest, self.alphabet)
            for far in np.unique(d).tolist():
                mine = rest[d == far]
                self.children[node][far] = int(mine[0])
                todo.append((int(mine[0]), mine[1:]))

    def search(self, values: list[str], most: list[int]) -> list[list[Match]]:
        """For each value every entry within its threshold, nearest first."""
        texts, limit = Texts(values, self.alphabet), np.array(most, np.int64)
        found: list[list[Match]] = [[] for _ in values]
        todo = [(self.root, np.arange(len(values)))] if self.root >= 0 and values else []
        while todo:
            node, rows = todo.pop()
            d = distances(self.keys[node], texts, rows, self.alphabet)
            for r in np.nonzero(d <= limit[rows])[0].tolist():
                found[rows[r]] += [Match(int(d[r]), self.keys[node], t) for t in self.tags[node]]
            for edge, child in self.children[node].items():
                near = rows[np.abs(d - edge) <= limit[rows]]
                if len(near):
                    todo.append((child, near))
        return [sorted(f) for f in found]


class Reference:
    """One shard of the reference list: its tree, and its forms by word for abbreviations."""

    def __init__(self, entries: list[tuple[str, list[str]]]) -> None:
        """``entries``: tag and phrases; a phrase is a sequence of words."""
        self.tree = BKTree([Form(squeeze(p), tag) for tag, phrases in entries for p in phrases if squeeze(p)])
        self.by_size: dict[int, set[tuple[tuple[str, ...], str]]] = {}
        for tag, phrases in entries:
            for p in phrases:
                w = tuple(x.rstrip(".") for x in words(p))
                self.by_size.setdefault(len(w), set()).add((w, tag))
        self.longest = max((len(k) for k in self.tree.keys), default=0)

    def spelled_out(self, value: str) -> list[str]:
        """The tags of the phrases that a value with abbreviated words can stand for, sorted."""
        w = words(value)
        if not any(x.endswith(".") and len(x) > 3 for x in w):
            return []
        fits = lambda x, y: y.startswith(x[:-1]) if x.endswith(".") else x == y
        return sorted({tag for p, tag in self.by_size.get(len(w), ()) if all(map(fits, w, p))})

    def lookup(self, values: list[str]) -> list[Nearest | None]:
        """The nearest entries of each value, None if nothing is near."""
        best: list[Nearest | None] = [None] * len(values)
        asked: list[str] = []
        owner: list[int] = []
        for n, v in enumerate(values):
            meant = self.spelled_out(v)
            key = squeeze(v)
            if meant:
                best[n] = Nearest(0, 0, meant[0], meant[-1])
            elif key and len(key) <= self.longest + 4:
                asked.append(key)
                owner.append(n)
        for n, found in zip(owner, self.tree.search(asked, [threshold(len(k)) for k in asked]), strict=True):
            if found:
                near = [m.tag for m in found if m.distance == found[0].distance]
                best[n] = Nearest(1, found[0].distance, min(near), max(near))
        return best


def entry_phrases(tag: str, domain: str, subdomain: str, label: str, aliases: list[str]) -> list[str]:
    """Every way an entry is usually written, as word sequences."""
    spaced = lambda s: re.sub(r"[_.]+", " ", s or "").strip()
    dom, sub = spaced(domain), spaced(subdomain)
    out = {spaced(tag), spaced(label)}
    names = [sub] if sub and sub != "general" else []
    names += [spaced(a) for a in aliases or [] if a]
    for name in names:
        out |= {name, f"{dom} {name}", f"{name} {dom}"}
        *first, last = name.split() or [""]
        if first:
            out.add(" ".join([last, *first]))  # "b, a" for "a b"
    if sub == "general":
        out |= {f"{dom} {sub}", f"{sub} {dom}"}
    return sorted(p for p in out if p)


def entry_forms(taxonomy: DataFrame) -> DataFrame:
    """``(field_tag, phrases)`` of the canonical list, each entry once; made on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(r["field_tag"], entry_phrases(r["field_tag"], r["domain"], r["subdomain"], r["label"], r["aliases"])) for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows], pa.string()), pa.array([p for _, p in rows], pa.list_(pa.string()))], names=["field_tag", "phrases"])

    once = taxonomy.filter("field_tag IS NOT NULL").select("field_tag", "domain", "subdomain", "label", "aliases").distinct()
    return once.mapInArrow(run, "field_tag string, phrases array<string>")


NEAREST = "turn int, distance int, first string, last string"


def _columns(got: list[Nearest | None]) -> list[pa.Array]:
    kinds = (pa.int32(), pa.int32(), pa.string(), pa.string())
    return [pa.array([m and m[k] for m in got], t) for k, t in enumerate(kinds)]


def _by_one_tree(rows: DataFrame, entries: list[tuple[str, list[str]]], value_col: str) -> DataFrame:
    """``rows`` with the columns of Nearest, null where nothing is near."""
    shared = rows.sparkSession.sparkContext.broadcast(entries)
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ref = Reference(shared.value)
        known: dict[str, Nearest | None] = {}
        for b in batches:
            values = b.column(value_col).to_pylist()
            new = sorted({v for v in values if v is not None and v not in known})
            if len(known) + len(new) > CACHE_VALUES:
                known, new = {}, sorted({v for v in values if v is not None})
            known.update(zip(new, ref.lookup(new), strict=True))
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), *_columns([known.get(v) for v in values])], names=[*names, "turn", "distance", "first", "last"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{schema}, {NEAREST}")


def _by_shards(values: DataFrame, forms: DataFrame, n_forms: int, value_col: str) -> DataFrame:
    """``value_col`` and the columns of Nearest: every lot of different values meets every shard, the shards' best are merged."""
    shards, lots = -(-n_forms // SHARD_FORMS), max(1, values.count() // LOT_VALUES)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = values.withColumn("_lot", F.pmod(F.xxhash64(value_col), F.lit(lots)).cast("int")).withColumn("_shard", every(shards))
    listed = forms.withColumn("_shard", F.pmod(F.xxhash64("field_tag"), F.lit(shards)).cast("int")).withColumn("_lot", every(lots))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        ref = Reference(list(zip(b.column("field_tag").to_pylist(), b.column("phrases").to_pylist(), strict=True)))
        mine = a.column(value_col).to_pylist()
        got = [(v, m) for v, m in zip(mine, ref.lookup(mine), strict=True) if m]
        return pa.table([pa.array([v for v, _ in got], pa.string()), *_columns([m for _, m in got])], names=[value_col, "turn", "distance", "first", "last"])

    met = asked.groupBy("_shard", "_lot").cogroup(listed.groupBy("_shard", "_lot")).applyInArrow(run, f"`{value_col}` string, {NEAREST}")
    level = met.groupBy(value_col, "turn", "distance").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    best = level.groupBy(value_col).agg(F.min(F.struct("turn", "distance", "first", "last")).alias("m"))
    return best.select(value_col, "m.*")


def map_values(rows: DataFrame, taxonomy: DataFrame, value_col: str = "raw_value") -> DataFrame:
    """``rows`` with ``field_tag`` and ``distance`` of the nearest canonical entry, null if none fits.

    A value as near to two different entries fits neither, however the list is dealt
    into shards.  Null and blank values fit nothing.  An empty list matches nothing.
    """
    forms = Workspace(rows.sparkSession, "canonical").put(entry_forms(taxonomy), "forms")
    n_forms = forms.agg(F.sum(F.size("phrases"))).first()[0] or 0
    if n_forms <= SHARD_FORMS:
        entries = sorted((r.field_tag, list(r.phrases)) for r in forms.collect())  # at most SHARD_FORMS forms
        found = _by_one_tree(rows, entries, value_col)
    else:
        best = _by_shards(rows.select(value_col).filter(F.col(value_col).isNotNull()).distinct(), forms, n_forms, value_col)
        found = spread_join(rows, best, value_col, rows.count())
    sole = F.col("first") == F.col("last")
    return found.select(*rows.columns, F.when(sole, F.col("first")).alias("field_tag"), F.when(sole, F.col("distance")).alias("distance"))


def typed_fields(nodes: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """``(node_id, raw_value)``: each node's different field values that are not canonical tags already.

    Null and blank (spaces, tabs) values don't count; a node that comes twice counts once.
    """
    tags = taxonomy.filter("field_tag IS NOT NULL").select(F.col("field_tag").alias("raw_value"), F.lit(True).alias("_listed")).distinct()
    values = nodes.select(same_id("node_id").alias("node_id"), F.explode("fields").alias("raw_value")).filter(F.col("node_id").isNotNull() & (trim_blanks("raw_value") != ""))
    if tags.count() <= SHARD_FORMS:
        other = values.join(F.broadcast(tags), "raw_value", "left_anti")
    else:
        values = values.distinct()
        other = spread_join(values, tags, "raw_value", values.count()).filter("_listed IS NULL")
    return other.select("node_id", "raw_value").distinct()
