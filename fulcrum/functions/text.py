"""Text expressions with Unicode-aware blanks and falsy defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases that mark dependency language in grants, the shorter list used for abstracts, and the
# words that mark a section as a signal in LaTeX headings and in JATS titles and types.
GRANT_PHRASES = (
    "requires", "bottleneck", "lack of", "lacking", "challenge", "missing", "needed", "limited by", "unable to", "open question", "no existing", "absence of", "developing a", "current methods fail",
    "barrier", "gap", "insufficient", "fundamental challenge", "critical need", "to address", "to overcome", "to enable",
)
REVIEW_PHRASES = ("requires", "bottleneck", "lack", "challenge", "missing", "needed", "limited by", "unable to", "open question")
SIGNAL_WORDS = ("future work", "open problem", "limitation", "challenge", "conclusion", "discussion", "outlook", "unsolved", "direction")
JATS_WORDS = ("conclusions", "conclusion", "discussion", "future", "limitations", "challenges", "outlook", "open problems", "future directions")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without leading and trailing blanks of any script (``trim`` knows the ASCII space only)."""
    return F.regexp_replace(F.regexp_replace(col(c), r"(?U)^\s+", ""), r"(?U)\s+$", "")


def collapse(c: Column | str) -> Column:
    """Runs of blanks become one space, ends are stripped."""
    return F.trim(F.regexp_replace(col(c), r"(?U)\s+", " "))


def or_else(c: Column | str, default: Column | str) -> Column:
    """``c`` unless it is null or empty."""
    return F.coalesce(F.nullif(col(c), F.lit("")), col(default) if isinstance(default, str) else default)


def clamp_title(c: Column | str, most: int = 200) -> Column:
    c = col(c)
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 3), F.lit("..."))).otherwise(c)


def title_key(c: Column | str) -> Column:
    """Lower case, stripped, first 60 letters: titles with one key are one title."""
    return F.substring(strip(F.lower(col(c))), 1, 60)


def domain(c: Column | str) -> Column:
    """A field tag's part before its first dot."""
    return F.substring_index(col(c), ".", 1)


def domains(c: Column | str) -> Column:
    """The different domains of a list of tags; null tags name none."""
    return F.array_distinct(F.transform(F.array_compact(F.coalesce(col(c), F.array().cast("array<string>"))), domain))


def year_of_mdy(c: Column | str) -> Column:
    """The year of MM/DD/YYYY: at least three parts, the last a number; else null."""
    parts = F.split(col(c), "/")
    return F.when(F.size(parts) >= 3, F.try_element_at(parts, F.lit(-1)).try_cast("int"))


def safe_double(c: Column | str) -> Column:
    return col(c).try_cast("double")


def word_count(c: Column | str) -> Column:
    t = collapse(F.coalesce(col(c), F.lit("")))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))


def holds_any(c: Column | str, phrases: tuple[str, ...]) -> Column:
    text, hit = F.lower(F.coalesce(col(c), F.lit(""))), F.lit(False)
    for p in phrases:
        hit = hit | text.contains(p)
    return hit


def is_signal_title(c: Column | str) -> Column:
    return holds_any(c, SIGNAL_WORDS)


def from_inverted_index(index: Column | str) -> Column:
    """Text of a word -> positions map: words by position, the later word wins a clash; null or empty gives ''."""
    entries = F.flatten(F.transform(F.map_entries(col(index)), lambda e, k: F.transform(F.coalesce(e["value"], F.array().cast("array<int>")), lambda p: F.struct(p.alias("p"), k.alias("k"), e["key"].alias("w")))))
    ranked = F.array_sort(entries)
    after = F.slice(F.concat(ranked, F.slice(ranked, -1, 1)), 2, F.greatest(F.size(ranked), F.lit(0)))
    last = F.size(ranked) - 1
    paired = F.zip_with(ranked, after, lambda a, b: F.struct(a["p"].alias("p"), a["w"].alias("w"), b["p"].alias("q")))
    kept = F.filter(paired, lambda x, k: (x["p"] != x["q"]) | (k == last))
    return F.coalesce(F.array_join(F.transform(kept, lambda x: x["w"]), " "), F.lit(""))
