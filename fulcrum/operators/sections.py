"""High-signal sections of LaTeX and JATS documents."""

from __future__ import annotations

import io
import re
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fulcrum.functions.text import JATS_WORDS, col, collapse, is_signal_title

HEADING = r"(?i)\\(?:sub)*section\*?\{([^}]*)\}"
LEAST_LETTERS = 100


def clean_latex(c: Column | str) -> Column:
    """Commands with an argument leave the argument, others a space; braces go, blanks collapse."""
    t = F.regexp_replace(col(c), r"\\[a-zA-Z]+\*?\{([^}]*)\}", "$1")
    t = F.regexp_replace(t, r"\\[a-zA-Z]+\*?", " ")
    return collapse(F.regexp_replace(t, r"[{}]", ""))


def latex_sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, pos, title, text)`` of the signal sections.

    A section ends at the next heading of any level, text before the first one is
    dropped.  Kept are bodies whose own heading names a signal and whose cleaned
    text exceeds 100 letters; of equal titles the last stands.  Null texts have none.
    """
    titles = F.regexp_extract_all(text_col, F.lit(HEADING), 1)
    bodies = F.split(text_col, HEADING)
    pairs = docs.select(id_col, F.posexplode(F.arrays_zip(titles.alias("t"), F.slice(bodies, F.lit(2), F.size(bodies)).alias("b"))).alias("pos", "s")).filter("s.t IS NOT NULL")
    kept = pairs.select(id_col, "pos", F.trim("s.t").alias("title"), clean_latex("s.b").alias("text")).filter(is_signal_title("title") & (F.length("text") > LEAST_LETTERS))
    return kept.groupBy(id_col, "title").agg(F.max_by(F.struct("pos", "text"), "pos").alias("x")).select(id_col, "x.pos", "title", "x.text")


def main_tex(files: list[tuple[str, str]]) -> str | None:
    """The first .tex file, replaced by a later one only if that declares a class and is longer."""
    best: str | None = None
    for name, text in files:
        if name.endswith(".tex") and (best is None or ("\\documentclass" in text and len(text) > len(best))):
            best = text
    return best


def archive_text(data: bytes) -> str:
    """The main LaTeX text of a (compressed) tar archive or of plain bytes; '' where there is none."""
    import gzip

    try:
        with tarfile.open(fileobj=io.BytesIO(data)) as tar:
            files = [(m.name, f.read().decode("utf-8", "replace")) for m in tar if m.isfile() and m.name.endswith(".tex") and (f := tar.extractfile(m))]
        return main_tex(files) or ""
    except (tarfile.TarError, EOFError, OSError):
        try:
            text = gzip.decompress(data).decode("utf-8", "replace") if data[:2] == b"\x1f\x8b" else data.decode("utf-8", "replace")
        except (OSError, EOFError):
            return ""
        return text if "\\" in text else ""


def read_archives(files: DataFrame) -> DataFrame:
    """``(doc_id, text)`` of ``binaryFile`` rows; the id is the file name without version, prefix and ending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                name = re.sub(r"v\d+$", "", re.sub(r"\.(tar\.gz|tgz|tar|gz|tex)$", "", path.rsplit("/", 1)[-1])).removeprefix("arxiv:")
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([archive_text(data)])], names=["doc_id", "text"])

    return files.select("path", "content").mapInArrow(run, "doc_id string, text string")


def jats_of(xml: str) -> list[tuple[str, str]]:
    """``(title, text)`` of every signal section at any depth, namespaces and comments ignored."""
    import xml.etree.ElementTree as ET

    local = lambda e: e.tag.rsplit("}", 1)[-1] if isinstance(e.tag, str) else ""
    try:
        root = ET.fromstring(xml)
    except ET.ParseError:
        return []
    out: dict[str, str] = {}
    for sec in (e for e in root.iter() if local(e) == "sec"):
        title = next((" ".join("".join(c.itertext()).split()) for c in sec if local(c) == "title"), "")
        kind = sec.get("sec-type") or ""
        if any(w in x.lower() for w in JATS_WORDS for x in (title, kind)):
            text = " ".join(" ".join("".join(p.itertext()) for p in sec.iter() if local(p) == "p").split())
            if len(text) > LEAST_LETTERS:
                out[title or kind] = text
    return list(out.items())


def jats_sections(docs: DataFrame, id_col: str = "doc_id", xml_col: str = "xml") -> DataFrame:
    """``(id, title, text)``; a nested section counts in its parent's text and on its own.  Broken XML has none."""
    field = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, t, x) for i, xml in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if xml for t, x in jats_of(xml)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], b.schema.field(0).type), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], names=[id_col, "title", "text"])

    return docs.select(id_col, xml_col).mapInArrow(run, f"{id_col} {field}, title string, text string")


def line_sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, title, n_letters)``: plain texts cut at their first line, where that names a signal and the rest is long enough."""
    title, rest = F.substring_index(text_col, "\n", 1), F.expr(f"substring({text_col}, locate('\\n', {text_col}) + 1)")
    rows = docs.filter(F.col(text_col).contains("\n")).select(id_col, F.trim(title).alias("title"), collapse(rest).alias("body"))
    return rows.filter(is_signal_title("title") & (F.length("title") <= 100) & (F.length("body") > LEAST_LETTERS)).select(id_col, "title", F.length("body").alias("n_letters"))
