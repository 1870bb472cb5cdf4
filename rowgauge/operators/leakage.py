"""Rows of other splits that also occur in the training split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.bloom import bloom, may_match
from ..functions.canonical import column
from .shape import pct, rows_from_wide


def training_split(names: Sequence[str]) -> str | None:
    """The first split that is named like a training split."""
    return next((s for s in names if "train" in s.lower()), None)


def split_leakage(
    df: DataFrame, text_col: str, splits: Sequence[str], split_col: str = "split"
) -> DataFrame:
    """(split, leaked_rows, leaked_pct) of every split but the training one.

    Percentages are of all rows of a split, with text or without.
    """
    keys = df.select(
        column(split_col).alias("split"), text.normal_hash(column(text_col)).alias("key")
    )
    return leaked_keys(keys, splits)


def leaked_keys(keys: DataFrame, splits: Sequence[str]) -> DataFrame:
    """The same from (split, key) rows.

    One grouping by key answers for all splits at once, and a text copied into a
    third of the rows is merged in each task before anything is shuffled. Training
    keys that no other split can hold are stopped at the scan by a Bloom filter of
    the other splits' keys, so what moves follows the small splits.
    """
    train = training_split(splits)
    others = [s for s in splits if s != train]
    if train is None or not others:
        return keys.sparkSession.createDataFrame(
            [], "split string, leaked_rows bigint, leaked_pct double"
        )
    is_train = F.col("split") == train
    evals = keys.filter(F.col("split").isin(others))
    trained = may_match(keys.filter(is_train), F.col("key"), bloom(evals, "key"))
    per_text = trained.unionByName(evals).groupBy("key").agg(
        F.bool_or(is_train).alias("in_train"),
        *[F.count_if(F.col("split") == s).alias(f"n{i}") for i, s in enumerate(others)],
    )
    leaks = F.col("in_train") & F.col("key").isNotNull()
    totals = per_text.agg(
        *[F.coalesce(F.sum(f"n{i}"), F.lit(0)).alias(f"rows{i}") for i in range(len(others))],
        *[
            F.coalesce(F.sum(F.when(leaks, F.col(f"n{i}"))), F.lit(0)).alias(f"leaked{i}")
            for i in range(len(others))
        ],
    )
    return rows_from_wide(
        totals,
        [
            {
                "split": F.lit(s),
                "leaked_rows": F.col(f"leaked{i}"),
                "leaked_pct": pct(F.col(f"leaked{i}"), F.col(f"rows{i}")),
            }
            for i, s in enumerate(others)
        ],
    )
