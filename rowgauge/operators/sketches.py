"""Opt-in approximations that keep: mergeable sketches per split and column.

An audit may keep one row per split and column instead of counting again: sketches
of new data merge with those of old data, and the merged ones say what one sketch of
everything would say. Distinct values come with a relative error of at most
``DISTINCT_ERROR`` (three standard deviations), quantiles with an error of at most
``RANK_ERROR`` in rank, whatever the number of rows. The checks of an audit stay exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import clean, column, missing, numeric_columns, value_key

#: Registers (as a power of two) and items per level; errors follow from them.
REGISTERS, ITEMS = 14, 1600
DISTINCT_ERROR = 3 * 1.04 / 2 ** (REGISTERS / 2)
RANK_ERROR = 0.005


def column_sketches(df: DataFrame, split_col: str | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """(split, column, rows, present, distinct, quantiles): one scan for all columns.
    ``quantiles`` is null for columns that are no numbers."""
    names = [c for c in (columns if columns is not None else df.columns) if c != split_col]
    numbers = set(numeric_columns(df))
    split = column(split_col).cast("string") if split_col else F.lit("all")
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(names):
        key = F.when(~missing(df, c), value_key(df, c).cast("string"))
        value = F.when(~missing(df, c), clean(df, c).cast("double")) if c in numbers else F.lit(None).cast("double")
        aggs += [
            F.count(key).alias(f"n{i}"), F.hll_sketch_agg(key, REGISTERS).alias(f"d{i}"),
            F.kll_sketch_agg_double(value, ITEMS).alias(f"q{i}"),
        ]
    wide = df.groupBy(split.alias("split")).agg(*aggs)
    rows = F.array(*[
        F.struct(
            F.lit(c).alias("column"), F.col("rows").alias("rows"), F.col(f"n{i}").alias("present"), F.col(f"d{i}").alias("distinct"),
            (F.col(f"q{i}") if c in numbers else F.lit(None).cast("binary")).alias("quantiles"),
        )
        for i, c in enumerate(names)
    ])
    return wide.select("split", F.inline(rows))


def merged(sketches: DataFrame, by: Sequence[str] = ("column",)) -> DataFrame:
    """Sketches of several splits, or of old and new data, as those of all their rows."""
    return sketches.groupBy(*by).agg(
        F.sum("rows").alias("rows"), F.sum("present").alias("present"),
        F.hll_union_agg("distinct").alias("distinct"), F.when(F.count("quantiles") > 0, F.kll_merge_agg_double("quantiles")).alias("quantiles"),
    )


def approximate_cardinality(sketches: DataFrame) -> DataFrame:
    """(column, present, unique) from merged sketches."""
    return sketches.select("column", "present", F.hll_sketch_estimate("distinct").alias("unique"))


def approximate_quantiles(sketches: DataFrame, shares: Sequence[float]) -> DataFrame:
    """(column, share, value) of number columns with values."""
    wanted = F.array(*[F.lit(float(p)) for p in shares])
    filled = sketches.filter(F.col("quantiles").isNotNull() & (F.col("present") > 0)).select(
        "column", wanted.alias("share"),
        F.when(F.kll_sketch_get_n_double("quantiles") > 0, F.kll_sketch_get_quantile_double("quantiles", wanted)).alias("value"),
    )
    return filled.select("column", F.inline(F.arrays_zip("share", "value")))
