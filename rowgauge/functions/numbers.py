"""Rounding and interpolation as floating-point tools do them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(c: Column, digits: int) -> Column:
    """Nearest decimal of the binary value, ties to even.

    ``round`` would round the printed form: 0.00015 to 0.0002, although the
    double lies below the tie.
    """
    scale = F.lit(float(10**digits))
    return F.rint(c * scale) / scale


def interpolated(lower: Column, upper: Column, share: Column) -> Column:
    """Linear interpolation, measured from the nearer end."""
    gap = upper - lower
    return F.when(share >= 0.5, upper - gap * (1 - share)).otherwise(lower + gap * share)
