"""Numeric column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def steady_round(x: Column, digits: int = 4) -> Column:
    """Half-even rounding after a nudge of 1e-6 of the last digit, so that decimal ties do not hang on the order of
    summation; never gives -0.0. SQL twin: ``steady_sql``."""
    s = float(10**digits)
    return F.rint(x * s + 1e-6) / s + 0.0


def steady_sql(x: str, digits: int = 4) -> str:
    return f"(round_even(({x}) * 1e{digits}::DOUBLE + 1e-6::DOUBLE, 0) / 1e{digits}::DOUBLE + 0.0)"


def finite(x: Column) -> Column:
    """NaN becomes null."""
    return F.nanvl(x.cast("double"), F.lit(None))
