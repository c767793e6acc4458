"""Numeric expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def percent_of(part: Column, whole: Column) -> Column:
    """Whole percent, rounded down; an empty whole counts as one."""
    return F.floor(100 * part / F.greatest(whole, F.lit(1))).cast("long")


def round_binary(c: Column, digits: int) -> Column:
    """Rounded by the double's exact binary value, ties to even.

    The built-in rounding works on the shortest decimal form (0.15 -> 0.2), so this
    is an Arrow function; it is meant for results of a few rows.
    """

    @F.pandas_udf("double")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: round(v, digits), na_action="ignore")

    return run(c.cast("double"))


def min_max(value: Column, lo: Column, hi: Column) -> Column:
    """Scaled to 0..1; all 0 where the range is empty."""
    return F.when(hi == lo, F.lit(0.0)).otherwise((value - lo) / (hi - lo))
