"""Normal forms of identifiers and labels, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_blanks(c: Column | str) -> Column:
    """Without surrounding spaces and tabs; null stays null."""
    return F.btrim(_col(c), F.lit(" \t"))


def same_id(c: Column | str) -> Column:
    """Identifier key: surrounding blanks removed, lower case; blank becomes null."""
    return F.nullif(F.lower(trim_blanks(c)), F.lit(""))
