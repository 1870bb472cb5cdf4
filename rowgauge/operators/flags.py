"""Row flags, their counts, evidence rows and the rows behind a flag."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import DEFAULT, AuditConfig
from ..functions import safety, text
from ..functions.canonical import column
from ..functions.numbers import rounded
from .shape import rows_from_wide


def text_flags(c: Column, cfg: AuditConfig = DEFAULT) -> dict[str, Column]:
    """Every boolean flag of one text column, by its flag name."""
    flags = dict(text.quality_flags(c, cfg))
    flags.update({f"pii_{k}": v for k, v in safety.pii_flags(c, cfg).items()})
    flags.update({f"toxicity_{k}": v for k, v in safety.keyword_flags(c, cfg.keywords).items()})
    flags.update({k: build(c) for k, build in cfg.extra_flags.items()})
    return flags


def row_flags(
    df: DataFrame,
    text_col: str,
    keep: Sequence[str] = (),
    cfg: AuditConfig = DEFAULT,
    repetition: bool = True,
) -> DataFrame:
    """All flags of one text column in a single projection over the rows."""
    c = column(text_col)
    flags = text_flags(c, cfg)
    flags["over_budget"] = text.token_estimate(c, cfg) > cfg.token_budget
    if repetition:
        flags["repetitive"] = text.is_repetitive(c, cfg)
    return df.select(
        *[column(k) for k in keep],
        F.length(c).cast("bigint").alias("chars"),
        text.token_estimate(c, cfg).alias("tokens"),
        *[F.coalesce(v, F.lit(False)).alias(k) for k, v in flags.items()],
    )


def flag_counts(
    df: DataFrame, text_cols: Sequence[str], cfg: AuditConfig = DEFAULT, flags: Sequence[str] | None = None
) -> DataFrame:
    """(column, flag, rows) for all text columns from one pass over the data.

    ``flags`` names the flags to count; the others are not worked out.
    """
    counts, rows = [], []
    for i, name in enumerate(text_cols):
        for flag, expr in text_flags(column(name), cfg).items():
            if flags is not None and flag not in flags:
                continue
            key = f"{i}_{flag}"
            counts.append(F.count_if(expr).alias(key))
            rows.append(
                {"column": F.lit(name), "flag": F.lit(flag), "rows": F.col(key)}
            )
    return rows_from_wide(df.agg(*counts), rows)


def text_quality(
    df: DataFrame, text_cols: Sequence[str], cfg: AuditConfig = DEFAULT
) -> DataFrame:
    """Text count, length range and quality-flag counts per text column."""
    aggs, rows = [], []
    for i, name in enumerate(text_cols):
        c = column(name)
        measures = {
            "count": F.count(c),
            "min_chars": F.min(F.length(c)).cast("bigint"),
            "max_chars": F.max(F.length(c)).cast("bigint"),
            "mean_chars": rounded(F.avg(F.length(c)), 1),
            **{k: F.count_if(v) for k, v in text.quality_flags(c, cfg).items()},
        }
        aggs += [v.alias(f"{i}_{k}") for k, v in measures.items()]
        rows.append({"column": F.lit(name), **{k: F.col(f"{i}_{k}") for k in measures}})
    return rows_from_wide(df.agg(*aggs), rows)


def evidence(
    flagged: DataFrame,
    row_id: str,
    flags: Sequence[str],
    max_examples: int = DEFAULT.max_examples,
) -> DataFrame:
    """(check, row_id, position): the first flagged ids of each flag.

    Only flagged rows become rows of the long form, and the rank limit is
    applied in every task before the shuffle, so one flag that hits a third of
    the table still sends only a few rows per task.
    """
    hits = flagged.select(
        column(row_id).alias("row_id"),
        F.explode(
            F.array_compact(F.array(*[F.when(column(f), F.lit(f)) for f in flags]))
        ).alias("check"),
    )
    order = W.partitionBy("check").orderBy("row_id")
    return (
        hits.withColumn("position", F.row_number().over(order))
        .filter(F.col("position") <= max_examples)
        .select("check", "row_id", F.col("position").cast("bigint").alias("position"))
    )


def example_lists(found: DataFrame) -> DataFrame:
    """One row per check with its few evidence ids in order."""
    return found.groupBy("check").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("position", "row_id"))), lambda e: e["row_id"]
        ).alias("example_rows")
    )


def flagged_rows(df: DataFrame, found: DataFrame, row_id: str) -> DataFrame:
    """The full rows behind the evidence. Spark broadcasts the evidence where it is small."""
    ids = found.withColumnRenamed("row_id", "__row_id")
    return df.join(ids, column(row_id) == F.col("__row_id")).drop("__row_id", "position")
