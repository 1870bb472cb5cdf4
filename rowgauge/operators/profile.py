"""Column and table profile: schema, missing values, cardinality, duplicates,
class balance."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT, AuditConfig
from ..functions import text
from ..functions.canonical import (
    FLOATING,
    NESTED,
    canonical,
    clean,
    column,
    missing,
    row_hash,
    type_of,
    value_key,
)
from ..functions.numbers import rounded
from .shape import pct, rows_from_wide


def text_columns(df: DataFrame, cfg: AuditConfig = DEFAULT) -> list[str]:
    """String columns whose values are long enough on average, in schema order.

    The answer is a list of names, so it takes one small aggregate here; name
    the columns in the configuration to save that pass.
    """
    if cfg.text_columns is not None:
        return list(cfg.text_columns)
    return _roles(df, cfg, texts=True, labels=False)[0]


def column_roles(df: DataFrame, cfg: AuditConfig = DEFAULT) -> tuple[list[str], list[str]]:
    """(text columns, columns that may be labels), both from the same pass."""
    texts, labels = _roles(df, cfg, texts=cfg.text_columns is None, labels=True)
    return (list(cfg.text_columns) if cfg.text_columns is not None else texts), labels


def _roles(df: DataFrame, cfg: AuditConfig, texts: bool, labels: bool):
    """One aggregate: average lengths of strings, distinct sketches of flat columns.

    k values fill at most k of a sketch's registers, so its small-range estimate
    m*ln(m/empty) has a known ceiling for k values: a column above it is certain
    to have more, and none with fewer is lost. The sketch has several registers
    per class, however many classes are asked for. That a column varies at all
    is told by its ends, not by the sketch.
    """
    most = cfg.max_classes
    bits = max(9, math.ceil(math.log2(2 * most + 1)))
    registers, error = 2**bits, 1.106 / math.sqrt(2**bits) * 1.0001
    strings = [f.name for f in df.schema if texts and isinstance(f.dataType, T.StringType)]
    flat = [f.name for f in df.schema if labels and not isinstance(f.dataType, NESTED)]
    aggs = [F.avg(F.length(column(c))) for c in strings]
    for c in flat:
        short = value_key(df, c)
        aggs += [F.approx_count_distinct(short, error), F.min(short) != F.max(short)]
    if not aggs:
        return [], flat
    row = df.agg(*[a.alias(f"x{i}") for i, a in enumerate(aggs)]).first()
    found = [c for c, v in zip(strings, row) if v is not None and v >= cfg.min_avg_length]
    ceiling = registers * math.log(registers / (registers - most)) + 1
    seen = row[len(strings) :]
    flat = [c for i, c in enumerate(flat) if seen[2 * i + 1] and seen[2 * i] <= ceiling]
    return found, flat


def _missing_agg(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count("*").alias("n"),
        *[F.count_if(missing(df, c)).alias(f"m{i}") for i, c in enumerate(df.columns)],
    )


def missingness(df: DataFrame) -> DataFrame:
    """(column, null_count, null_pct), NaN counted as missing."""
    return rows_from_wide(
        _missing_agg(df),
        [
            {
                "column": F.lit(c),
                "null_count": F.col(f"m{i}"),
                "null_pct": pct(F.col(f"m{i}"), F.col("n")),
            }
            for i, c in enumerate(df.columns)
        ],
    )


def fully_empty_rows(df: DataFrame) -> DataFrame:
    """One row: how many rows miss every column."""
    every = F.lit(True)
    for c in df.columns:
        every = every & missing(df, c)
    return df.agg(F.count_if(every).alias("fully_empty_rows"))


def correlated_missingness(df: DataFrame, cfg: AuditConfig = DEFAULT) -> DataFrame:
    """(col_a, col_b, corr): columns whose gaps go together.

    Two scans, however many columns: one counts each column's gaps, one groups
    rows by which columns they miss. There are few such patterns. Correlation of two 0/1
    masks needs nothing but counts: each mask alone and both together.
    """
    gaps = F.array_compact(
        F.array(*[F.when(missing(df, c), F.lit(i)) for i, c in enumerate(df.columns)])
    )
    patterns = df.groupBy(gaps.alias("gaps")).agg(F.count("*").alias("k"))
    together = (
        patterns.select("k", "gaps", F.explode("gaps").alias("a"))
        .select("k", "a", F.explode("gaps").alias("b"))
        .filter("a < b")
        .groupBy("a", "b").agg(F.sum("k").alias("both"))
    )
    totals = _missing_agg(df).first()
    n, gappy = totals["n"], [i for i in range(len(df.columns)) if totals[i + 1] > 0]
    rows = []
    for at, i in enumerate(gappy):
        for j in gappy[at + 1 :]:
            pa, pb = totals[i + 1] / n, totals[j + 1] / n
            rows.append((i, j, df.columns[i], df.columns[j], pa * pb, math.sqrt(pa * (1 - pa) * pb * (1 - pb))))
    pairs = df.sparkSession.createDataFrame(
        rows, "a int, b int, col_a string, col_b string, by_chance double, spread double"
    )
    r = F.try_divide(F.coalesce("both", F.lit(0)) / F.lit(float(n)) - F.col("by_chance"), F.col("spread"))
    return (
        pairs.join(together, ["a", "b"], "left")
        .select("col_a", "col_b", r.alias("r"))
        .filter(F.abs("r") >= cfg.co_missing_from)
        .select("col_a", "col_b", rounded(F.col("r"), 2).alias("corr"))
    )


def _long_keys(df: DataFrame, key, names: Sequence[str]) -> DataFrame:
    cells = [F.struct(F.lit(c).alias("column"), key(df, c).alias("key")) for c in names]
    return df.select(F.inline(F.array(*cells)))


def _typed_cell(df: DataFrame, name: str) -> Column:
    """The cell as whole number, fraction or text key; numbers are not formatted."""
    dtype, c = type_of(df, name), clean(df, name)
    whole, real, key = F.lit(None), F.lit(None), F.lit(None)
    if isinstance(dtype, T.TimestampType):
        whole = F.unix_micros(c)
    elif isinstance(dtype, T.IntegralType):
        whole = c
    elif isinstance(dtype, FLOATING):
        real = c
    else:
        key = value_key(df, name)
    return F.struct(
        F.lit(name).alias("column"),
        whole.cast("bigint").alias("whole"),
        real.cast("double").alias("real"),
        key.cast("string").alias("key"),
    )


def distinct_counts(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """(column, n, unique): exact, missing values not counted as a value.

    All columns share one scan and one shuffle of short keys, and equal keys
    are merged in each task first, so a value that fills a third of the rows
    crosses the network once per task.
    """
    cells = [_typed_cell(df, c) for c in (df.columns if names is None else names)]
    counted = (
        df.select(F.inline(F.array(*cells)))
        .groupBy("column", "whole", "real", "key")
        .agg(F.count("*").alias("n"))
    )
    present = F.col("whole").isNotNull() | F.col("real").isNotNull() | F.col("key").isNotNull()
    return counted.groupBy("column").agg(
        F.sum("n").alias("n"), F.count_if(present).alias("unique")
    )


def schema_report(df: DataFrame) -> DataFrame:
    """(column, dtype, non_null, null_count, null_pct, unique)."""
    gaps = rows_from_wide(
        _missing_agg(df),
        [
            {
                "column": F.lit(c),
                "dtype": F.lit(type_of(df, c).simpleString()),
                "non_null": F.col("n") - F.col(f"m{i}"),
                "null_count": F.col(f"m{i}"),
                "null_pct": pct(F.col(f"m{i}"), F.col("n")),
            }
            for i, c in enumerate(df.columns)
        ],
    )
    unique = distinct_counts(df).select("column", "unique")
    return gaps.join(unique, "column", "left").fillna(0, ["unique"])


def cardinality(df: DataFrame, cfg: AuditConfig = DEFAULT) -> DataFrame:
    """(column, unique, unique_ratio, high_cardinality, constant)."""
    names = df.sparkSession.createDataFrame([(c,) for c in df.columns], "column string")
    ratio = F.coalesce(F.try_divide(F.col("unique").cast("double"), F.col("n")), F.lit(0.0))
    return (
        names.join(distinct_counts(df), "column", "left")
        .fillna(0, ["unique", "n"])
        .select(
            "column",
            "unique",
            rounded(ratio, 4).alias("unique_ratio"),
            ((ratio >= cfg.high_cardinality_from) & (F.col("n") > 1)).alias("high_cardinality"),
            (F.col("unique") <= 1).alias("constant"),
        )
    )


def duplicates(
    df: DataFrame, text_cols: Sequence[str], exclude: Sequence[str] = ()
) -> DataFrame:
    """(kind, column, duplicate_rows, duplicate_pct).

    ``exact`` compares whole rows (without the ``exclude`` columns), ``near``
    the normalised text of one column. Both shuffle hashes, never texts, in
    one pass; percentages are of all rows.
    """
    whole = row_hash(df, [c for c in df.columns if c not in exclude])
    near = {c: text.normal_hash(column(c)) for c in text_cols}
    return repeated_keys(df, whole, near)


def repeated_keys(df: DataFrame, whole: Column, near: Mapping[str, Column]) -> DataFrame:
    """Duplicate counts from a key per row and keys per text column."""
    keys = [F.struct(F.lit("exact").alias("kind"), F.lit("").alias("column"), whole.alias("key"))]
    keys += [
        F.struct(F.lit("near").alias("kind"), F.lit(c).alias("column"), key.alias("key"))
        for c, key in near.items()
    ]
    per_kind = (
        df.select(F.inline(F.array(*keys)))
        .groupBy("kind", "column", "key")
        .agg(F.count("*").alias("n"))
        .groupBy("kind", "column")
        .agg(
            F.sum("n").alias("rows"),
            F.sum(F.when(F.col("key").isNotNull(), F.col("n") - 1)).alias("duplicate_rows"),
        )
    )
    return per_kind.select(
        "kind",
        "column",
        F.coalesce("duplicate_rows", F.lit(0)).cast("bigint").alias("duplicate_rows"),
        pct(F.coalesce("duplicate_rows", F.lit(0)), F.col("rows")).alias("duplicate_pct"),
    )


# --- Fixed values: class-balance verdicts ------------------------------------
VERDICTS = (
    ("balanced", "none"),
    ("moderate_imbalance", "class weights or mild oversampling"),
    ("severe_imbalance", "oversample minority / undersample majority / focal loss"),
)


def class_balance(
    df: DataFrame, cfg: AuditConfig = DEFAULT, columns: Sequence[str] | None = None
) -> DataFrame:
    """One row per label-like column with its largest and smallest class.

    A column counts as label-like with 2 to ``max_classes`` values. Only
    ``columns`` are looked at, by default those that may have so few; their
    label texts are counted per task before they are shuffled.
    """
    names = list(columns) if columns is not None else column_roles(df, cfg)[1]
    if not names:
        cells = df.limit(0).select(
            F.lit("").alias("column"), F.lit("").alias("label"), F.lit(0).cast("bigint").alias("n")
        )
    else:
        cells = (
            _long_keys(df, canonical, names)
            .groupBy("column", F.col("key").alias("label"))
            .agg(F.count("*").alias("n"))
        )
    n, label = F.col("n"), F.col("label")
    known = label.isNotNull()
    order = F.when(known, F.struct(-n, label))
    per_column = cells.groupBy("column").agg(
        F.sum(n).alias("rows"),
        F.count(label).alias("classes"),
        F.min_by(label, order).alias("majority_label"),
        F.max(F.when(known, n)).alias("majority_count"),
        F.max_by(label, order).alias("minority_label"),
        F.min(F.when(known, n)).alias("minority_count"),
    )
    ratio = F.col("majority_count") / F.col("minority_count")

    def by_ratio(at: int) -> Column:
        return (
            F.when(ratio < cfg.balanced_below, VERDICTS[0][at])
            .when(ratio < cfg.severe_from, VERDICTS[1][at])
            .otherwise(VERDICTS[2][at])
        )

    return per_column.filter(F.col("classes").between(2, cfg.max_classes)).select(
        "column",
        "classes",
        "majority_label",
        "majority_count",
        pct(F.col("majority_count"), F.col("rows")).alias("majority_pct"),
        "minority_label",
        "minority_count",
        pct(F.col("minority_count"), F.col("rows")).alias("minority_pct"),
        rounded(ratio, 2).alias("imbalance_ratio"),
        by_ratio(0).alias("verdict"),
        by_ratio(1).alias("recommended_strategy"),
    )
