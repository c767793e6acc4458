"""Exact byte-pair encoding of whole corpora by per-prefix dynamic programming.

For every prefix of a word's bytes exactly one token can end the encoding of that
prefix.  An automaton over the vocabulary with suffix links (built by the
Aho-Corasick rule, in place of a suffix automaton) lists the tokens that end at a position; the one that follows its prefix's last token without BPE wanting to
merge across the seam is stored, and the ids are read off the back-pointers.
Work is linear in the text, whatever the word length.

The vocabulary file is read on the driver (its path is a parameter) and sent to
the executors: a file of at most some 100,000 entries, so its size is bounded.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

if TYPE_CHECKING:
    from pyspark import Broadcast

TOKENIZERS = os.environ.get("FULCRUM_TOKENIZERS", "/opt/tokenizers")

# Fixed value: the public pattern that splits text into words before byte merges.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Distinct words remembered per Python worker; beyond it the memory is started anew.
CACHE_WORDS = 300_000
#: Longer words are encoded each time they occur.
CACHE_BYTES = 64


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabulary files, letter -> byte."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {**{chr(b): b for b in shown}, **{chr(256 + n): b for n, b in enumerate(hidden)}}


class Encoder:
    """A byte-level BPE vocabulary, ready to encode words.

    ``json_text`` is a public vocabulary file with ``model.vocab`` and
    ``model.merges``.  Merge priority is the order of the merges.
    """

    def __init__(self, json_text: str) -> None:
        import ahocorasick
        import regex

        model = json.loads(json_text)["model"]
        letters = byte_letters()
        plain = {t: i for t, i in model["vocab"].items() if all(ch in letters for ch in t)}
        to_text = lambda t: bytes(letters[ch] for ch in t).decode("latin-1")
        self.token = {i: to_text(t) for t, i in plain.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int, int]] = {}  # id -> left, right, rank of the merge that made it
        for n, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            left, right, made = plain[a], plain[b], plain[a + b]
            self.rank[left, right] = n
            self.halves.setdefault(made, (left, right, n))
        self.words = regex.compile(WORD_PATTERN)
        self.ends = ahocorasick.Automaton()
        self.single: dict[str, int] = {}
        for i, t in self.token.items():
            if len(t) == 1:
                self.single[t] = i
            if len(t) == 1 or i in self.halves:
                self.ends.add_word(t, (len(t), i))
        self.ends.make_automaton()
        self.fits: dict[tuple[int, int], bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether the bytes of ``a`` then ``b`` encode to exactly these two tokens.

        Both tokens are undone merge by merge, latest first.  At each step the two
        pieces that touch at the seam must not form a merge that would have run
        before the one just undone.
        """
        got = self.fits.get((a, b))
        if got is None:
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            got = self.fits[a, b] = self._compatible(a, b)
        return got

    def _compatible(self, a: int, b: int) -> bool:
        never = 1 << 60
        limit, strict = never, True
        while True:
            across = self.rank.get((a, b))
            if across is not None and (across < limit or (across == limit and not strict)):
                return False
            ha, hb = self.halves.get(a), self.halves.get(b)
            if ha is None and hb is None:
                return True
            # undo the later merge; of equal ranks BPE applies the left one first, so the right one is undone first
            if hb is None or (ha is not None and ha[2] > hb[2]):
                # a merge across the seam lies right of the one inside a: at equal rank the inner one runs first
                a, limit, strict = ha[1], ha[2], True
            else:
                # it lies left of the one inside b: at equal rank the one across runs first
                b, limit, strict = hb[0], hb[2], False

    def encode_bytes(self, word: str) -> tuple[int, ...]:
        """Ids of one word, given as latin-1 text of its bytes.  Raises if a byte has no token."""
        n = len(word)
        last, size = [-1] * (n + 1), [0] * (n + 1)
        at, candidates = 0, []
        for end, found in self.ends.iter(word):
            if end != at:
                self._settle(at, candidates, last, size)
                at, candidates = end, []
            candidates.append(found)
        if n:
            self._settle(at, candidates, last, size)
        out = []
        while n:
            if not size[n]:
                raise ValueError(f"the vocabulary can't end a token after byte {n} of {word[:80]!r}")
            out.append(last[n])
            n -= size[n]
        out.reverse()
        return tuple(out)

    def _settle(self, end: int, candidates: list[tuple[int, int]], last: list[int], size: list[int]) -> None:
        for length, token in candidates:
            before = end + 1 - length
            if before == 0 or (last[before] >= 0 and self.compatible(last[before], token)):
                last[end + 1], size[end + 1] = token, length
                return

    def encode(self, text: str) -> list[int]:
        known, out = self.known, []
        for w in self.words.findall(text):
            ids = known.get(w)
            if ids is None:
                ids = self.encode_bytes(w.encode("utf-8").decode("latin-1"))
                if len(w) <= CACHE_BYTES:
                    if len(known) >= CACHE_WORDS:
                        known.clear()
                    known[w] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        return "".join(self.token[i] for i in ids).encode("latin-1").decode("utf-8")


_READY: dict[int, Encoder] = {}


def _encoder(shared: Broadcast[str]) -> Encoder:
    """One encoder a Python worker and vocabulary."""
    key = hash(shared.value)
    if key not in _READY:
        _READY.clear()
        _READY[key] = Encoder(shared.value)
    return _READY[key]


def _vocabulary(df: DataFrame, tokenizer: str) -> Broadcast[str]:
    path = tokenizer if os.path.isabs(tokenizer) else os.path.join(TOKENIZERS, f"{tokenizer}.json")
    with open(path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode_corpus(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), tokenizer: str = "byte_bpe_50k", counts_only: bool = False) -> DataFrame:
    """The ``keep`` columns and ``ids array<int>``, or ``n_tokens int`` with ``counts_only``.

    No special tokens.  A null or empty text has no ids: an empty list, count 0.
    Every row comes out once, in whatever order it came; whole texts are encoded.
    Strings that look like special tokens are ordinary text.
    """
    shared = _vocabulary(docs, tokenizer)
    source = docs.select(*keep, docs[text_col].alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(shared)
        for b in batches:
            rows, start = b.num_rows, 0
            texts = b.column(len(keep))
            while start < rows:
                flat: list[int] = []
                offsets = [0]
                stop = start
                while stop < rows and len(flat) < 4_000_000:  # bounded output batches
                    t = texts[stop].as_py()
                    if t:
                        flat += enc.encode(t)
                    offsets.append(len(flat))
                    stop += 1
                ends = np.asarray(offsets, np.int32)
                made = pa.array(np.diff(ends), pa.int32()) if counts_only else pa.ListArray.from_arrays(pa.array(ends), pa.array(np.asarray(flat, np.int32)))
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(start, stop - start) for k in range(len(keep))), made], names=[*keep, "n_tokens" if counts_only else "ids"])
                start = stop

    return source.mapInArrow(run, f"{schema}, " + ("n_tokens int" if counts_only else "ids array<int>"))
