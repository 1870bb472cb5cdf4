"""Turning one-row wide aggregates into small long tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import rounded


def rows_from_wide(df: DataFrame, rows: Sequence[Mapping[str, Column]]) -> DataFrame:
    """One output row per mapping, for each (few, wide) input row."""
    return df.select(
        F.inline(
            F.array(*[F.struct(*[c.alias(k) for k, c in row.items()]) for row in rows])
        )
    )


def pct(part: Column, whole: Column) -> Column:
    """Percentage with two decimals; 0.0 of nothing."""
    return F.coalesce(rounded(F.try_divide(F.lit(100.0) * part, whole), 2), F.lit(0.0))
