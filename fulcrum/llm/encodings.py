"""Text decoded with the wrong character encoding: find it and restore it.

A multinomial classifier over hashed byte bigrams tells clean sentences from
those garbled by a known chain of wrong decodings, and names the chain.  It is
trained on all sentences, garbled on purpose by every
chain.  The named chain is then inverted; a repair counts only if every byte
sequence decodes strictly and the result reads as clean to the same classifier.

Chains work character by character, so pairs of characters are counted once for all
of them.  All documents, in full, train the classifier and are classified.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fulcrum.durable import Workspace

#: Counts of more sentences are scaled to so many, which smoothing and LEAST_SEEN are meant for.
RATED = 12_000
BUCKETS = 1 << 15
#: Log odds that a sentence is garbled by one given chain, before looking at it: byte
#: sequences of UTF-8 prove themselves when they decode, one-byte confusions do not.
PRIOR_UTF8, PRIOR_OTHER = -3.0, -7.0
#: A repair may keep this share of the sentence's log odds (rare but sound characters have some).
CLEANER = 0.2
#: One-byte confusions are judged by bigrams from this many foreign characters in a sentence on, below that by whether known words come out.
LEAST_FOREIGN = 3
#: Log odds from which an undecodable sentence counts as garbled beyond repair.
HOPELESS = 14.0
#: A foreign word counts as known if the clean sentences hold it so often, or as often among more than RATED.
LEAST_SEEN = 3
LOST = "�"

# Chains of wrong decodings, each step (true encoding, encoding it was read with).
CHAINS: dict[str, tuple[tuple[str, str], ...]] = {
    **{f"utf8>{w}": (("utf8", w),) for w in ("latin1", "cp1252", "cp1250", "cp1251", "iso8859_2", "iso8859_15", "cp437", "cp850", "cp866", "koi8_r", "mac_roman", "cp1254")},
    **{f"utf8>{a}>utf8>{b}": (("utf8", a), ("utf8", b)) for a in ("latin1", "cp1252") for b in ("latin1", "cp1252")},
    "utf8>cp1251>utf8>cp1251": (("utf8", "cp1251"), ("utf8", "cp1251")),
    **{
        f"{r}>{w}": ((r, w),)
        for r, w in (
            ("cp1250", "cp1252"), ("cp1250", "latin1"), ("iso8859_2", "cp1252"), ("iso8859_2", "latin1"), ("cp1250", "iso8859_2"), ("iso8859_2", "cp1250"),
            ("cp1251", "cp1252"), ("cp1251", "latin1"), ("koi8_r", "cp1252"), ("koi8_r", "latin1"), ("koi8_r", "cp1251"), ("cp1251", "koi8_r"), ("cp866", "cp1251"), ("cp1251", "cp866"),
            ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1252", "mac_roman"), ("mac_roman", "cp1252"), ("cp850", "cp1252"), ("cp437", "cp1252"), ("cp1252", "cp1251"), ("cp1252", "cp1250"), ("cp1252", "koi8_r"),
            ("shift_jis", "cp1252"), ("shift_jis", "latin1"), ("euc_jp", "latin1"), ("euc_jp", "cp1252"), ("gb18030", "latin1"),
        )
    },
}
NAMES = ["clean", *CHAINS]
PRIORS = np.array([PRIOR_UTF8 if c.startswith("utf8") else PRIOR_OTHER for c in CHAINS], np.float32)


@lru_cache(maxsize=64)
def letters_of(codec: str) -> str:
    """The 256 characters of a one-byte encoding; bytes it leaves open pass through as controls."""
    return "".join(bytes([b]).decode(codec, "ignore") or chr(b) for b in range(256))


@lru_cache(maxsize=64)
def bytes_of(codec: str) -> dict[str, int]:
    return {ch: b for b, ch in enumerate(letters_of(codec))}


def garble(text: str, chain: str) -> str | None:
    """The text as the chain would have left it; None if the true encoding cannot write it."""
    for right, wrong in CHAINS[chain]:
        try:
            raw = text.encode(right)
        except UnicodeEncodeError:
            return None
        table = letters_of(wrong)
        text = "".join([table[b] for b in raw])
    return text


def restore(text: str, chain: str) -> str | None:
    """The inverse of ``garble``, strictly: None unless every byte fits."""
    for right, wrong in reversed(CHAINS[chain]):
        table = bytes_of(wrong)
        try:
            text = bytes([table[ch] for ch in text]).decode(right)
        except (KeyError, UnicodeDecodeError):
            return None
    return text


@lru_cache(maxsize=64)
def multibyte(codec: str) -> re.Pattern[str]:
    """Runs of UTF-8 sequences as they look when read with a one-byte encoding."""
    t = letters_of(codec)
    some = lambda lo, hi: "[" + re.escape(t[lo : hi + 1]) + "]"
    c = some(0x80, 0xBF)
    return re.compile(f"(?:{some(0xC2, 0xDF)}{c}|{some(0xE0, 0xEF)}{c}{c}|{some(0xF0, 0xF4)}{c}{c}{c})+")


def restore_runs(text: str, chain: str) -> str | None:
    """Inverts a UTF-8 chain only where whole sequences stand, leaving other characters; None if there are none."""
    for right, wrong in reversed(CHAINS[chain]):
        if right != "utf8":
            return None
        table, done = bytes_of(wrong), 0

        def back(m: re.Match[str]) -> str:
            nonlocal done
            try:
                out = bytes([table[ch] for ch in m.group()]).decode("utf-8")  # noqa: B023
            except UnicodeDecodeError:
                return m.group()
            done += 1
            return out

        text = multibyte(wrong).sub(back, text)
        if not done:
            return None
    return text


SENTENCE = re.compile(r"[^\n.!?。]*(?:[.!?]+(?![\s.!?]|\Z)[^\n.!?。]*)*[\n.!?。]*")
# Characters beyond ASCII, without blanks and marks that have no width.
FOREIGN = re.compile("[^\x00-\x7f\xa0\xad\u2000-\u200f\u2028-\u202f\u2060\ufeff]")
# Characters named as an example: a short run after words that announce one, or alone between quotation marks.
CITED = re.compile(
    r"(?P<pre>\b(?:strings?|sequences?|characters?|symbols?|glyphs?|such as|lists?|like|reads?|shows?)\s+)[“\"«'‘]?(?P<run>[^\x00-\x7f“”]{1,8})[”\"»'’]?(?=[\s,;.])"
    r"|[“\"](?P<quoted>[^\x00-\x7f“”]{1,8})[”\"]"
)


def uncited(sentence: str) -> str:
    """The sentence without characters it only cites."""
    return CITED.sub(lambda m: m.group("pre") or "", sentence)


def restore_around(sentence: str, chain: str) -> str | None:
    """The sentence restored but for the characters it only cites; None if nothing changes."""
    out, at = [], 0
    spans = [(m.start() + len(m.group("pre") or ""), m.end()) for m in CITED.finditer(sentence)]
    for a, b in [*spans, (len(sentence), len(sentence))]:
        piece = sentence[at:a]
        fixed = restore(piece, chain)
        out += [piece if fixed is None and (fixed := restore_runs(piece, chain)) is None else fixed, sentence[a:b]]
        at = b
    whole = "".join(out)
    return whole if whole != sentence else None


def foreign_words(sentence: str) -> list[tuple[int, str]]:
    """The words that hold letters beyond ASCII, with their places."""
    words = ((n, w.strip(".,;:!?()[]\"'“”«»„‘’").lower()) for n, w in enumerate(sentence.split(" ")))
    return [(n, w) for n, w in words if FOREIGN.search(w)]


def sentences(text: str) -> list[tuple[int, int]]:
    """Bounds of the sentences that hold characters beyond ASCII."""
    return [m.span() for m in SENTENCE.finditer(text) if m.end() > m.start() and not m.group().isascii()]


def _bigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte bigrams that touch a byte beyond ASCII, and the text each belongs to."""
    raw = np.frombuffer(("\0".join(t.replace("\0", " ") for t in texts) + "\0").encode("utf-8", "replace"), np.uint8)
    a, b = raw[:-1], raw[1:]
    use = ((a >= 0x80) | (b >= 0x80)) & (a != 0) & (b != 0)
    key = a[use].astype(np.uint32) << np.uint32(8) | b[use]
    bucket = (key * np.uint32(2654435761)) >> np.uint32(17)
    return bucket.astype(np.int32), np.cumsum(raw == 0)[:-1][use]


@dataclass
class Classifier:
    """Log rates (bucket, class); class 0 is clean text.  ``words``: the known foreign words."""

    logp: np.ndarray
    names: list[str]
    words: frozenset[str] = frozenset()
    _mended: dict[str, frozenset[str]] = field(default_factory=dict)

    def mended_by(self, word: str) -> frozenset[str]:
        """The one-byte chains whose inverse makes an unknown word a known one."""
        if word not in self._mended:
            if len(self._mended) > 100_000:
                self._mended.clear()
            one_byte = [] if word in self.words else [n for n, p in zip(CHAINS, PRIORS, strict=True) if p == PRIOR_OTHER]
            self._mended[word] = frozenset(n for n in one_byte if (w := restore(word, n)) != word and w in self.words)
        return self._mended[word]

    def scores(self, texts: list[str]) -> np.ndarray:
        """Log odds against clean of every chain: (texts, chains)."""
        out = np.zeros((len(texts), len(self.names)), np.float32)
        for at in range(0, len(texts), 2_000):
            bucket, owner = _bigrams(texts[at : at + 2_000])
            if len(bucket) == 0:
                continue
            starts = np.concatenate([[0], np.nonzero(np.diff(owner))[0] + 1])
            for lo in range(0, len(starts), 500):  # bounded gathers
                part = starts[lo : lo + 500]
                stop = starts[lo + 500] if lo + 500 < len(starts) else len(bucket)
                out[at + owner[part]] = np.add.reduceat(self.logp[bucket[part[0] : stop]], part - part[0], axis=0)
        return out[:, 1:] - out[:, :1] + PRIORS


#: True encodings of the chains: bit r of a sentence's mask says that the r-th can write it.
RIGHT = list(dict.fromkeys(steps[0][0] for steps in CHAINS.values()))


@lru_cache(maxsize=200_000)
def _written_by(ch: str) -> int:
    mask = 0
    for r, codec in enumerate(RIGHT):
        try:
            ch.encode(codec)
        except UnicodeEncodeError:
            continue
        mask |= 1 << r
    return mask


def character_pairs(texts: list[str], times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(mask, pair, n)``: how often two characters follow each other, at least one of them beyond ASCII, in sentences of each mask.

    ``times``: what each text counts.  A pair is ``first << 21 | second``; the second is 0 at the end of a text.
    """
    cp = np.frombuffer("".join(t.replace("\0", " ") + "\0" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    if len(cp) == 0:
        return (np.zeros(0, np.int64),) * 3
    owner = np.cumsum(cp == 0) - (cp == 0)
    beyond = np.nonzero(cp >= 0x80)[0]
    chars, which = np.unique(cp[beyond], return_inverse=True)
    mask = np.full(len(texts), (1 << len(RIGHT)) - 1, np.int64)
    np.bitwise_and.at(mask, owner[beyond], np.array([_written_by(chr(c)) for c in chars.tolist()], np.int64)[which])
    use = np.nonzero(((cp[:-1] >= 0x80) | (cp[1:] >= 0x80)) & (cp[:-1] != 0))[0]
    both = np.stack([mask[owner[use]], cp[use] << 21 | cp[use + 1]])
    kinds, which = np.unique(both, axis=1, return_inverse=True)
    return kinds[0], kinds[1], np.bincount(which.ravel(), weights=times[owner[use]], minlength=kinds.shape[1]).astype(np.int64)


@lru_cache(maxsize=500_000)
def _as_left_by(ch: str, k: int) -> bytes:
    return (ch if k == 0 else garble(ch, NAMES[k]) or "").encode("utf-8", "replace")


def class_counts(mask: np.ndarray, pair: np.ndarray, n: np.ndarray) -> np.ndarray:
    """(bucket, class): the byte bigrams of the sentences that the pairs were counted in, as every chain would have left them.

    All chains work character by character, so the bigrams inside a character's bytes
    and those from one character to the next say what a whole garbled sentence holds.
    """
    pairs, which = np.unique(pair, return_inverse=True)
    first, second = pairs >> 21, pairs & ((1 << 21) - 1)
    chars = np.unique(np.concatenate([first, second]))
    at, to, ends = np.searchsorted(chars, first), np.searchsorted(chars, second), second == 0
    counts = np.zeros((BUCKETS, len(NAMES)), np.float64)

    def add(k: int, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> None:
        use = ((a >= 0x80) | (b >= 0x80)) & (a != 0) & (b != 0) & (w > 0)
        key = (a[use].astype(np.uint32) << np.uint32(8) | b[use].astype(np.uint32)) * np.uint32(2654435761) >> np.uint32(17)
        counts[:, k] += np.bincount(key.astype(np.int64), weights=w[use], minlength=BUCKETS)

    for k in range(len(NAMES)):
        there = n if k == 0 else n * (mask >> RIGHT.index(CHAINS[NAMES[k]][0][0]) & 1)
        weight = np.bincount(which, weights=there, minlength=len(pairs))
        left = [_as_left_by(chr(c), k) for c in chars.tolist()]
        size = np.array([len(x) for x in left], np.int64)
        raw = np.frombuffer(b"".join(left) + b"\0", np.uint8)
        start = np.cumsum(size) - size
        owner = np.repeat(np.arange(len(chars)), size)
        own = np.bincount(at, weights=weight, minlength=len(chars))  # every character is the first of one pair each time it is there
        inside = np.nonzero(owner[:-1] == owner[1:])[0]
        add(k, raw[inside], raw[inside + 1], own[owner[inside]])
        across = np.nonzero(~ends & (size[at] > 0) & (size[to] > 0))[0]
        add(k, raw[start[at[across]] + size[at[across]] - 1], raw[start[to[across]]], weight[across])
    return counts


def classifier(counts: np.ndarray, total: int, words: frozenset[str] = frozenset()) -> Classifier:
    """From the counts of ``total`` sentences.

    Every class holds the same sentences, so counts are rates per sentence and need no
    class total: bigrams that a chain leaves alone weigh exactly nothing.
    """
    return Classifier(np.log(counts * min(1.0, RATED / max(total, 1)) + 0.05).astype(np.float32), NAMES, words)


def teaches(t: str) -> bool:
    """Whether a sentence may be in the clean class: it holds no decodable sequences, lost characters or citations."""
    return LOST not in t and uncited(t) == t and not any(restore_runs(t, c) not in (None, t) for c in ("utf8>cp1252", "utf8>latin1", "utf8>cp1251", "utf8>cp1250", "utf8>cp437", "utf8>mac_roman") if c in CHAINS)


def known_words(texts: list[str], times: np.ndarray) -> Counter[str]:
    seen: Counter[str] = Counter()
    for t, n in zip(texts, times.tolist(), strict=True):
        for _, w in foreign_words(t):
            if w.isalpha() and len(w) > 2:
                seen[w] += n
    return seen


def least_seen(total: int) -> float:
    return LEAST_SEEN * max(1.0, total / RATED)


def train(texts: list[str]) -> Classifier:
    """A classifier from sentences at hand; ``fit_classifier`` does the same with a table of any size.

    The clean class holds the sentences that may teach; a second round also leaves
    out those the first one can repair.
    """
    clean = [t for t in texts if teaches(t)]
    model = classifier(class_counts(*character_pairs(clean, np.ones(len(clean)))), len(clean))
    clean = [t for t, f in zip(clean, inspect(clean, model), strict=True) if not any(x.repaired for x in f)]
    words = known_words(clean, np.ones(len(clean), np.int64))
    return classifier(class_counts(*character_pairs(clean, np.ones(len(clean)))), len(clean), frozenset(w for w, n in words.items() if n >= least_seen(len(clean))))


def suspicion(model: Classifier, texts: list[str]) -> np.ndarray:
    """Log odds of every chain; one-byte confusions are out of the question here in texts with few foreign characters."""
    odds = model.scores(texts)
    few = np.array([len(FOREIGN.findall(t)) < LEAST_FOREIGN for t in texts], bool)
    odds[np.ix_(few, PRIORS == PRIOR_OTHER)] = -1e9
    return odds


def by_known_words(sentence: str, model: Classifier) -> tuple[str, str] | None:
    """The one-byte chain whose inverse turns every foreign word, none of them known, into a known one; None if there is none or several that differ."""
    strange = foreign_words(sentence)
    chains = frozenset.intersection(*(model.mended_by(w) for _, w in strange)) if strange else frozenset()
    found = {fixed: name for name in sorted(chains) if (fixed := restore(sentence, name)) is not None}
    return next(((name, fixed) for fixed, name in found.items()), None) if len(found) == 1 else None


@dataclass
class Finding:
    """One garbled sentence: its bounds, the chain (or 'lost'), and its repair if there is one."""

    start: int
    stop: int
    chain: str
    repaired: str | None


def inspect(texts: list[str | None], model: Classifier) -> list[list[Finding]]:
    """The garbled sentences of each text."""
    owner: list[int] = []
    spans: list[tuple[int, int]] = []
    bare: list[str] = []
    for n, t in enumerate(texts):
        if not t or t.isascii():
            continue
        for a, b in sentences(t):
            s = uncited(t[a:b])
            if not s.isascii():
                owner.append(n)
                spans.append((a, b))
                bare.append(s)
    found: list[list[Finding]] = [[] for _ in texts]
    if not bare:
        return found
    odds = suspicion(model, bare)
    suspects = np.nonzero((odds.max(axis=1) > 0) | np.array([LOST in s for s in bare]))[0].tolist()
    tries: list[tuple[int, str, str]] = []
    for k in suspects:
        for c in np.argsort(-odds[k]).tolist():
            if odds[k, c] <= 0:
                break
            name = NAMES[c + 1]
            fixed = restore(bare[k], name)
            if fixed is None:
                fixed = restore_runs(bare[k], name)
            if fixed is not None and fixed != bare[k]:
                tries.append((k, name, fixed))
    after = suspicion(model, [t[2] for t in tries]) if tries else np.zeros((0, 1))
    good: dict[int, tuple[str, str]] = {}
    for (k, name, fixed), left in zip(tries, after.max(axis=1, initial=-1e9).tolist(), strict=True):
        if k not in good and left <= max(0.0, CLEANER * odds[k].max()) and LOST not in fixed:
            good[k] = (name, fixed)
    rest = (k for k in range(len(bare)) if model.words and k not in good and LOST not in bare[k] and len(FOREIGN.findall(bare[k])) < LEAST_FOREIGN)
    meant = {k: w for k in rest if (w := by_known_words(bare[k], model))}
    good |= meant
    for k in sorted({*suspects, *meant}):
        a, b = spans[k]
        if k in good:
            name, fixed = good[k]
            whole = texts[owner[k]][a:b]  # type: ignore[index]
            # cited characters stay as they are
            found[owner[k]].append(Finding(a, b, name, fixed if whole == bare[k] else restore_around(whole, name)))
        elif LOST in bare[k]:
            found[owner[k]].append(Finding(a, b, "lost", None))
        elif odds[k].max() > HOPELESS and len(FOREIGN.findall(bare[k])) >= LEAST_FOREIGN:
            found[owner[k]].append(Finding(a, b, NAMES[int(odds[k].argmax()) + 1], None))
    return found


COUNTED = "mask long, pair long, word string, n long"


def _counted(sentences_: DataFrame, model: Broadcast | None) -> DataFrame:
    """``(mask, pair, word, n)`` over all ``(s, n)``, or those ``model`` can't repair: pairs of characters, known words (mask -1), and the number of sentences (mask -2)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Classifier(*model.value) if model is not None else None
        for b in batches:
            for lo in range(0, b.num_rows, 5_000):
                texts, times = b.column(0).slice(lo, 5_000).to_pylist(), b.column(1).slice(lo, 5_000).to_numpy()
                words: Counter[str] = Counter()
                if m is not None:
                    keep = np.array([not any(x.repaired for x in f) for f in inspect(texts, m)], bool)
                    texts, times = [t for t, k in zip(texts, keep.tolist(), strict=True) if k], times[keep]
                    words = known_words(texts, times)
                mask, pair, n = character_pairs(texts, times)
                w = len(words)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([mask, np.full(w, -1), [-2]]).astype(np.int64)),
                        pa.array(np.concatenate([pair, np.zeros(w + 1)]).astype(np.int64)),
                        pa.array([*[None] * len(mask), *words, None], pa.string()),
                        pa.array(np.concatenate([n, list(words.values()), [times.sum()]]).astype(np.int64)),
                    ],
                    names=["mask", "pair", "word", "n"],
                )

    return sentences_.mapInArrow(count, COUNTED).groupBy("mask", "pair", "word").agg(F.sum("n").alias("n"))


def _from_counted(counted: DataFrame) -> Classifier:
    """At most a row for each bucket and class, and the words of a fixed rate, reach the driver."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = class_counts(*(b.column(c).to_numpy() for c in range(3)))
            bucket, k = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(np.rint(counts[bucket, k]).astype(np.int64))], names=["bucket", "k", "n"])

    total = (counted.filter("mask = -2").agg(F.sum("n")).first() or [0])[0] or 0
    t = counted.filter("mask >= 0").select("mask", "pair", "n").mapInArrow(spread, "bucket int, k int, n long").groupBy("bucket", "k").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((BUCKETS, len(NAMES)), np.float64)
    counts[t.column("bucket").to_numpy(), t.column("k").to_numpy()] = t.column("n").to_numpy()
    words = counted.filter((F.col("mask") == -1) & (F.col("n") >= least_seen(total))).select("word").toArrow()
    return classifier(counts, total, frozenset(words.column(0).to_pylist()))


def fit_classifier(docs: DataFrame, text_col: str = "text") -> Classifier:
    """Trained on every sentence of every document, counted on the executors; equal sentences are looked at once and count as often as they occur."""
    spark = docs.sparkSession
    work = Workspace(spark, "encodings")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1_000):
                yield pa.RecordBatch.from_arrays([pa.array([t[x:y] for t in b.column(0).slice(lo, 1_000).to_pylist() for x, y in sentences(t)], pa.string())], names=["s"])

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([teaches(t) for t in b.column(0).to_pylist()], pa.bool_()))

    foreign = docs.filter(F.col(text_col).rlike("[^\\x00-\\x7f]")).select(text_col)
    once = foreign.mapInArrow(cut, "s string").groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    clear = work.put(once.mapInArrow(clean, "s string, n long"), "clean")
    first = _from_counted(work.put(_counted(clear, None), "counted"))
    return _from_counted(work.put(_counted(clear, spark.sparkContext.broadcast((first.logp, first.names))), "counted"))


def repair(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", model: Classifier | None = None) -> DataFrame:
    """One row per affected document.

    ``keep`` columns, ``chains`` (the different chains found, sorted; 'lost' where
    characters were replaced for good), ``n_garbled`` and ``n_repaired`` sentences,
    ``repaired_text`` (the text with all repairs).  Null and empty texts, and texts
    that only cite garbled characters, give no row.  Repeated texts give one row
    each.
    """
    model = model or fit_classifier(docs, text_col)
    shared = docs.sparkSession.sparkContext.broadcast((model.logp, model.names, model.words))
    source = docs.select(*keep, docs[text_col].alias("_text")).filter(F.col("_text").rlike("[^\\x00-\\x7f]"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Classifier(*shared.value)
        for b in batches:
            for lo in range(0, b.num_rows, 1_000):
                part = b.slice(lo, 1_000)
                texts = part.column(len(keep)).to_pylist()
                found = inspect(texts, m)
                hit = [n for n, f in enumerate(found) if f]
                fixed = []
                for n in hit:
                    out, at = [], 0
                    for f in found[n]:
                        out += [texts[n][at : f.start], f.repaired if f.repaired is not None else texts[n][f.start : f.stop]]
                        at = f.stop
                    fixed.append("".join([*out, texts[n][at:]]))
                took = part.take(pa.array(hit, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(took.column(k) for k in range(len(keep))),
                        pa.array([sorted({f.chain for f in found[n]}) for n in hit], pa.list_(pa.string())),
                        pa.array([len(found[n]) for n in hit], pa.int32()),
                        pa.array([sum(f.repaired is not None for f in found[n]) for n in hit], pa.int32()),
                        pa.array(fixed, pa.string()),
                    ],
                    names=[*keep, "chains", "n_garbled", "n_repaired", "repaired_text"],
                )

    return source.mapInArrow(run, f"{schema}, chains array<string>, n_garbled int, n_repaired int, repaired_text string")
