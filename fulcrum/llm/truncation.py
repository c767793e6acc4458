"""Values cut off by field limits or mid-transfer, and how often each feed cuts.

Per feed and column, histograms of character and byte lengths are searched for
spikes: lengths far more frequent than their neighbours.  A spike need not be the
longest length, since only part of a feed passes through the limit.  A value at a spike
that ends without terminal punctuation is a suspect, title or quote.  Whole values
of one length (titles from one pattern) make spikes too, so two statistics of the
whole corpus judge the suspects, and find the values cut mid-transfer at any length:
how often sentences that begin alike are terminated, and how often the last
words end a value, go on, or are the beginning of a longer word.  ``decided_by`` says what
made a value a cut one: 'spike', or else 'mark', 'opening' or 'ending'.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fulcrum.durable import Workspace
from fulcrum.functions.keys import same_id, trim_blanks
from fulcrum.operators.skew import spread_join

#: A length is a spike if it occurs this often, this many times its neighbours' mean, and this many
#: standard deviations above it.
SPIKE_COUNT, SPIKE_FACTOR, SPIKE_SIGMAS = 8, 2.5, 6.0
#: A word's beginning may stand alone in mid-sentence in this share of the longer word's occurrences, by misspelling.
SLIPS = 0.02
#: Neighbours on either side.
SPIKE_WINDOW = 10
#: A whole last word that ends this share of its occurrences or less was cut from what followed.
RARE_END = 0.012
#: At a spike length most values are cut: there this share suffices.
RARE_END_AT_SPIKE = 0.2

MARKED = r"(\.\.|…|\[(\.\.\.|…)\]|\((\.\.\.|…)\)?|-)\s*$"
TERMINATED = r"""[.!?。]["”»'’)\]]*\s*$"""
LEADING_MARK = r"^\s*(\[?(\.\.\.|…)\]?\s*)+"
BEFORE_LAST_SENTENCE = r"""(?s)^.*[.!?。]["”»'’)\]]?\s+(?=\S)"""


def values_of(nodes: DataFrame, papers: DataFrame, grants: DataFrame) -> DataFrame:
    """``(node_id, field_name, pos, feed, text)``: titles (pos -1) and source quotes of every different node.

    The feed is the ``source`` of the paper or grant, else the source type; a
    title's feed is that of its node's first source, '(none)' without one.  Null
    and blank texts, null items and nodes without an id are left out.
    """
    newest = nodes.select(same_id("node_id").alias("node_id"), "ingested_at", F.struct("title", "sources").alias("r")).filter("node_id IS NOT NULL")
    once = newest.groupBy("node_id").agg(F.max_by("r", "ingested_at").alias("r")).select("node_id", "r.title", "r.sources")
    first = F.try_element_at(F.filter(F.transform(F.coalesce("sources", F.array()), lambda s, k: F.struct(k.alias("k"), s.alias("s"))), lambda x: x["s"].isNotNull()), F.lit(1))
    items = F.transform(F.coalesce("sources", F.array()), lambda s, k: F.struct(F.lit("evidence_quote").alias("field_name"), k.cast("int").alias("pos"), s["source_type"].alias("source_type"), s["source_id"].alias("source_id"), s["evidence_quote"].alias("text")))
    title = F.struct(F.lit("title").alias("field_name"), F.lit(-1).alias("pos"), first["s"]["source_type"].alias("source_type"), first["s"]["source_id"].alias("source_id"), F.col("title").alias("text"))
    rows = once.withColumn("_first", first).select("node_id", F.explode(F.concat(F.array(title), items)).alias("v")).select("node_id", "v.*").filter(F.trim(F.regexp_replace("text", r"\s+", " ")) != "")
    key = F.concat_ws("\u0001", "source_type", "source_id")
    rows = Workspace(nodes.sparkSession, "quotes").put(rows.withColumn("source_id", trim_blanks("source_id")).withColumn("key", key).drop("source_id"), "raw")
    feeds = papers.select(F.lit("paper").alias("source_type"), trim_blanks("id").alias("source_id"), "source").unionByName(grants.select(F.lit("grant").alias("source_type"), trim_blanks("id").alias("source_id"), "source"))
    feeds = feeds.filter("source_id IS NOT NULL").groupBy(key.alias("key")).agg(F.min("source").alias("feed"))
    placed = spread_join(rows, feeds, "key", rows.count())  # one paper may be quoted by a large part of all nodes
    return placed.select("node_id", "field_name", "pos", F.coalesce("feed", "source_type", F.lit("(none)")).alias("feed"), "text")


def spikes(values: DataFrame) -> DataFrame:
    """``(feed, field_name, unit, length, n, expected)``: lengths that occur out of all proportion.

    Works on the histogram, one row for each length that occurs.
    """
    sizes = F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.length("text").alias("length")), F.struct(F.lit("bytes").alias("unit"), F.octet_length("text").alias("length"))))
    histogram = values.select("feed", "field_name", sizes.alias("s")).groupBy("feed", "field_name", "s.unit", "s.length").agg(F.count(F.lit(1)).alias("n"))
    near = Window.partitionBy("feed", "field_name", "unit").orderBy("length").rangeBetween(-SPIKE_WINDOW, SPIKE_WINDOW)
    around = histogram.withColumn("expected", (F.sum("n").over(near) - F.col("n")) / (2.0 * SPIKE_WINDOW))
    return around.filter((F.col("n") >= SPIKE_COUNT) & (F.col("n") > SPIKE_FACTOR * F.col("expected")) & (F.col("n") > F.col("expected") + SPIKE_SIGMAS * F.sqrt(F.col("expected") + 1)))


def _opening(words: Column, n: int) -> Column:
    return F.array_join(F.slice(words, 1, n), " ")


def _endings(rows: DataFrame) -> DataFrame:
    """``(key, e, i, p)`` of word sequences of one to three words: how often a value ends with
    them, goes on after them, or holds them with a longer last word.

    ``rows``: ``words`` (two pad words first) and ``whole``; of a value that may be
    cut the last word is not used.  A word is cut into the beginnings that are as
    long as some last word, as no others are asked for.
    """
    at = F.sequence(F.lit(3), F.when(F.col("whole"), F.size("words")).otherwise(F.size("words") - 1))
    grams = rows.filter(F.size("words") > F.when(F.col("whole"), 2).otherwise(3)).select("words", "whole", F.explode(at).alias("j"))
    word = lambda k: F.element_at("words", F.col("j") - k)
    counted = grams.groupBy(word(2).alias("a"), word(1).alias("b"), word(0).alias("w"), (F.col("whole") & (F.col("j") == F.size("words"))).alias("end")).agg(F.count(F.lit(1)).alias("n"))
    levels = F.explode(F.array(F.concat_ws(" ", "a", "b"), F.col("b"), F.lit("")))
    per_key = counted.select(levels.alias("ctx"), "w", "end", "n").groupBy("ctx", "w").agg(F.sum(F.when(F.col("end"), F.col("n")).otherwise(0)).alias("e"), F.sum(F.when(~F.col("end"), F.col("n")).otherwise(0)).alias("i"))
    key = lambda w: F.ltrim(F.concat_ws(" ", "ctx", w))
    # a longer word counts for its beginnings; words that only ever end one value may be cut themselves
    lengths = rows.agg(F.array_sort(F.collect_set(F.length(F.element_at("words", -1)))).alias("lengths"))  # one row: the lengths of last words
    shorter = F.filter("lengths", lambda k: (k > 0) & (k < F.length("w")))
    longer = (F.col("i") > 0) | (F.col("e") >= 3)
    forms = F.concat(F.array(F.struct(F.col("w").alias("w"), F.col("e").alias("e"), F.col("i").alias("i"), F.lit(0).cast("long").alias("p"))), F.when(longer, F.transform(shorter, lambda k: F.struct(F.substring(F.col("w"), F.lit(1), k).alias("w"), F.lit(0).cast("long").alias("e"), F.lit(0).cast("long").alias("i"), (F.col("e") + F.col("i")).alias("p")))).otherwise(F.array()))
    every = per_key.join(F.broadcast(lengths)).select("ctx", F.explode(forms).alias("f"))
    return every.groupBy(key(F.col("f.w")).alias("key")).agg(F.sum("f.e").alias("e"), F.sum("f.i").alias("i"), F.sum("f.p").alias("p"))


def _verdicts(rows: DataFrame, stats: DataFrame, work: Workspace, n: int) -> DataFrame:
    """``(tail, plain, at_spike, once)`` for every different last three words of ``rows``: whether they betray a cut anywhere or at a spike, and whether they end one value only."""
    tails = rows.select("tail").distinct().withColumn("w", F.split("tail", " "))
    asked = tails.select("tail", F.explode(F.array(F.struct(F.lit(3).alias("k"), F.col("tail").alias("key")), F.struct(F.lit(2).alias("k"), F.concat_ws(" ", F.element_at("w", 2), F.element_at("w", 3)).alias("key")), F.struct(F.lit(1).alias("k"), F.element_at("w", 3).alias("key")))).alias("q")).select("tail", "q.*")
    met = spread_join(work.put(asked, "asked"), stats, "key", n).na.fill(0, ["e", "i", "p"])  # very many tails may end in one word
    wide = met.groupBy("tail").agg(*(F.max(F.when(F.col("k") == k, F.col(c))).alias(f"{c}{k}") for k in (1, 2, 3) for c in ("e", "i", "p")))
    n3, n2 = F.col("e3") + F.col("i3") + F.col("p3"), F.col("e2") + F.col("i2") + F.col("p2")
    use = lambda c: F.when(n3 >= 8, F.col(f"{c}3")).when(n2 >= 3, F.col(f"{c}2")).otherwise(F.col(f"{c}1"))
    s = wide.select("tail", use("e").alias("e"), use("i").alias("i"), use("p").alias("p"), "e1", "i1", (n2 < 3).alias("single"), (F.col("e3") <= 1).alias("once"))
    all_n = F.col("e") + F.col("i") + F.col("p")
    rate = F.when(all_n > 0, F.col("e") / all_n).otherwise(1.0)
    # a few slips of the pen leave a word's beginning in mid-sentence; their number grows with the corpus, their share doesn't
    part = (F.col("i") <= SLIPS * F.col("p")) & (F.col("p") >= F.when(F.col("single"), 20).otherwise(3)) & (F.col("e") * 4 <= F.col("p"))
    goes_on = (F.col("i") >= 50) & (rate <= RARE_END)
    never_last = (F.col("i1") >= 50) & (F.col("e1") <= RARE_END * (F.col("e1") + F.col("i1")))
    return s.select("tail", (part | goes_on | never_last).alias("plain"), (part | never_last | ((all_n > 0) & (rate < RARE_END_AT_SPIKE))).alias("at_spike"), "once")


def cut_values(values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The cut values, ``(node_id, field_name, pos, at_spike, decided_by)``, and the spikes found.

    Values end properly if terminal punctuation closes them; a late beginning or a
    left-out middle doesn't matter.  An empty table gives empty results.
    """
    spark = values.sparkSession
    work = Workspace(spark, "truncation")
    words = F.split(F.lower(F.trim(F.regexp_replace("text", r"[\s ]+", " "))), " ")
    body = F.trim(F.regexp_replace("text", LEADING_MARK, ""))
    last = F.regexp_replace("body", BEFORE_LAST_SENTENCE, "")
    opening = F.lower(F.regexp_extract("last", r"^(\S+(?:\s+\S+)?)", 1))
    ended = values.withColumns({"marked": F.rlike("text", F.lit(MARKED)), "body": body}).withColumn("terminated", ~F.col("marked") & F.rlike("text", F.lit(TERMINATED)))
    # only what lacks terminal punctuation is looked at word by word
    base = ended.withColumn("last", F.when(F.col("field_name") == "evidence_quote", last)).select(
        *values.columns, "marked", "terminated", F.when(~F.col("terminated"), F.concat(F.array(F.lit("^"), F.lit("^")), words)).alias("words"), (F.col("last") != F.col("body")).alias("many"), F.regexp_replace(opening, r"\s+", " ").alias("opening")
    )
    found = work.put(spikes(values), "spikes")
    limits = F.broadcast(  # a handful of lengths for each feed and column; byte limits may fall inside a character
        found.groupBy("feed", "field_name").agg(F.collect_set(F.when(F.col("unit") == "chars", F.col("length"))).alias("char_spikes"), F.collect_set(F.when(F.col("unit") == "bytes", F.col("length"))).alias("byte_spikes"))
    )
    near = F.array_contains("char_spikes", F.length("text")) | F.exists("byte_spikes", lambda b: (F.octet_length("text") <= b) & (F.octet_length("text") > b - 3) & (F.octet_length("text") > F.length("text")))
    placed = base.join(limits, ["feed", "field_name"], "left").withColumn("at_spike", F.coalesce(near, F.lit(False))).drop("char_spikes", "byte_spikes", "feed")
    placed = work.put(placed.withColumn("tail", F.array_join(F.slice("words", -3, 3), " ")).drop("text"), "placed")

    # how often do quote sentences that begin alike end with punctuation?
    quotes = placed.filter("field_name = 'evidence_quote'").withColumn("opening1", F.substring_index("opening", " ", 1))
    shares = quotes.select(F.explode(F.array("opening", "opening1")).alias("opening"), "terminated").groupBy("opening").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("terminated").cast("double")).alias("share"))
    asked = quotes.filter("NOT terminated").select("node_id", "field_name", "pos", "at_spike", "marked", "many", "tail", "words", "opening", "opening1")
    # openings of one and two words never collide: the latter hold a blank, or are the whole sentence
    s2, s1 = shares.select("opening", F.col("n").alias("n2"), F.col("share").alias("share2")), shares.select(F.col("opening").alias("opening1"), F.col("n").alias("n1"), F.col("share").alias("share1"))
    rows = placed.count()
    judged = spread_join(spread_join(asked, s2, "opening", rows), s1, "opening1", rows)
    usual = F.when(F.coalesce("n2", F.lit(0)) >= 5, F.col("share2")).otherwise(F.coalesce("share1", F.lit(0.0)))
    judged = judged.withColumn("sentence", F.col("many") | (usual >= 0.5)).select("node_id", "field_name", "pos", "at_spike", "marked", "tail", "words", "sentence")

    titles = placed.filter("field_name = 'title' AND NOT terminated").select("node_id", "field_name", "pos", "at_spike", "marked", "tail", "words", F.lit(False).alias("sentence"))
    loose = work.put(judged.unionByName(titles), "loose")  # everything without terminal punctuation
    headed = loose.filter("NOT sentence")
    # most titles at a spike are cut, so they don't say how whole ones end; headline-like quotes are of much the same length by nature
    doubtful = F.col("at_spike") & (F.col("field_name") == "title")
    stats = _endings(headed.select("words", (~F.col("marked") & ~doubtful).alias("whole")))
    verdict = work.put(_verdicts(headed, stats, work, 3 * rows), "verdicts")
    weighed = spread_join(loose.drop("words"), verdict.withColumnRenamed("at_spike", "spike_cut"), "tail", rows)
    agreed = F.col("sentence") | F.col("plain") | (F.col("spike_cut") & ((F.col("field_name") == "title") | F.col("once")))
    reason = F.when(F.col("at_spike") & (F.col("marked") | F.coalesce(agreed, F.lit(False))), "spike").when(F.col("marked"), "mark").when(F.col("sentence"), "opening").when(F.col("plain"), "ending")
    return weighed.withColumn("decided_by", reason).filter("decided_by IS NOT NULL").select("node_id", "field_name", "pos", "at_spike", "decided_by"), found


def report(values: DataFrame, cut: DataFrame) -> DataFrame:
    """One row a feed and column: values, cut ones, those that a length spike gave away, and the share that is cut."""
    whole = values.groupBy("feed", "field_name").agg(F.count(F.lit(1)).alias("n_values"))
    marked = cut.join(values.select("node_id", "field_name", "pos", "feed"), ["node_id", "field_name", "pos"])
    hit = marked.groupBy("feed", "field_name").agg(F.count(F.lit(1)).alias("n_cut"), F.sum((F.col("decided_by") == "spike").cast("int")).alias("n_by_spike"))
    return whole.join(hit, ["feed", "field_name"], "left").na.fill(0, ["n_cut", "n_by_spike"]).withColumn("share_cut", F.col("n_cut") / F.col("n_values"))
