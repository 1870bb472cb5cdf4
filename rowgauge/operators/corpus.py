"""Token lengths, vocabulary, repetition and shared openings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import DEFAULT, WORD, AuditConfig
from ..functions import text
from ..functions.canonical import column
from ..functions.numbers import interpolated, rounded
from .shape import rows_from_wide

PERCENTS = (5, 25, 50, 75, 95, 99)


def length_counts(
    df: DataFrame, text_cols: Sequence[str], cfg: AuditConfig = DEFAULT
) -> DataFrame:
    """(column, tokens, n): texts per token length.

    Lengths repeat, so this is small whatever the number of rows; quantiles
    and histogram both come from it.
    """
    cells = [
        F.struct(F.lit(c).alias("column"), text.token_estimate(column(c), cfg).alias("tokens"))
        for c in text_cols
    ]
    return (
        df.select(F.inline(F.array(*cells)))
        .filter(F.col("tokens").isNotNull())
        .groupBy("column", "tokens")
        .agg(F.count("*").alias("n"))
    )


def token_distribution(
    df: DataFrame, text_cols: Sequence[str], cfg: AuditConfig = DEFAULT
) -> DataFrame:
    """One row per text column: count, range, mean, exact percentiles, total."""
    lengths = length_counts(df, text_cols, cfg)
    return length_summary(lengths, cfg)


def length_summary(lengths: DataFrame, cfg: AuditConfig = DEFAULT) -> DataFrame:
    """Token distribution from counts per length; the windows see lengths, not rows."""
    every = W.partitionBy("column")
    ranked = lengths.withColumn("cum", F.sum("n").over(every.orderBy("tokens"))).withColumn(
        "total", F.sum("n").over(every)
    )

    def at_rank(rank):
        return F.min(F.when(F.col("cum") > rank, F.col("tokens"))).cast("double")

    last = (F.col("total") - 1).cast("double")
    ends = []
    for p in PERCENTS:
        place = F.lit(p / 100) * last
        ends += [
            at_rank(F.floor(place)).alias(f"low{p}"),
            at_rank(F.ceil(place)).alias(f"high{p}"),
        ]
    per_column = ranked.groupBy("column").agg(
        F.sum("n").alias("count"),
        F.min("tokens").alias("min"),
        F.max("tokens").alias("max"),
        F.sum(F.col("tokens") * F.col("n")).alias("total_tokens"),
        *ends,
    )
    last = (F.col("count") - 1).cast("double")
    quantiles = []
    for p in PERCENTS:
        place = F.lit(p / 100) * last
        value = interpolated(F.col(f"low{p}"), F.col(f"high{p}"), place - F.floor(place))
        quantiles.append(rounded(value, 1).alias(f"p{p}"))
    return per_column.select(
        "column",
        F.lit(cfg.tokenizer_name).alias("tokenizer"),
        "count",
        "min",
        "max",
        rounded(F.col("total_tokens") / F.col("count"), 1).alias("mean"),
        *quantiles,
        "total_tokens",
    )


def length_histogram(
    df: DataFrame, text_col: str, cfg: AuditConfig = DEFAULT, bins: int | None = None
) -> DataFrame:
    """(bin, range, count): equal-width bins over token lengths, empty ones kept.

    Bins are closed on the right; the lowest edge is lowered by a thousandth of
    the range so the shortest text falls inside.
    """
    most = cfg.histogram_bins if bins is None else bins
    every = W.partitionBy("column")
    lengths = (
        length_counts(df, [text_col], cfg)
        .withColumn("low", F.min("tokens").over(every).cast("double"))
        .withColumn("high", F.max("tokens").over(every).cast("double"))
        .withColumn("bins", F.least(F.lit(most).cast("bigint"), F.count("*").over(every)))
    )
    flat = F.col("low") == F.col("high")
    pad = F.col("low") * F.lit(0.001)
    lengths = (
        lengths.withColumn("first", F.when(flat, F.col("low") - pad).otherwise(F.col("low")))
        .withColumn("last", F.when(flat, F.col("high") + pad).otherwise(F.col("high")))
        .withColumn("step", (F.col("last") - F.col("first")) / F.col("bins"))
    )
    inner = F.when(F.col("bins") > 1, F.sequence(F.lit(1), F.col("bins") - 1)).otherwise(
        F.array().cast("array<bigint>")
    )
    passed = F.filter(inner, lambda i: F.col("tokens") > F.col("first") + i * F.col("step"))
    counted = (
        lengths.withColumn("bin", (F.size(passed) + 1).cast("bigint"))
        .groupBy("bins", "low", "high", "first", "last", "step", "bin")
        .agg(F.sum("n").alias("n"))
        .groupBy("bins", "low", "high", "first", "last", "step")
        .agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("counts"))
    )

    def label(edge):
        near = rounded(edge, 3)
        return F.when(near < 0, F.ceil(near)).otherwise(F.floor(near)).cast("string")

    def edge(i):
        lowest = F.when(flat, F.col("first")).otherwise(
            F.col("first") - (F.col("last") - F.col("first")) * F.lit(0.001)
        )
        return (
            F.when(i == 0, lowest)
            .when(i == F.col("bins"), F.col("last"))
            .otherwise(F.col("first") + i * F.col("step"))
        )

    rows = F.transform(
        F.sequence(F.lit(1).cast("bigint"), F.col("bins")),
        lambda i: F.struct(
            i.alias("bin"),
            F.concat(label(edge(i - 1)), F.lit("-"), label(edge(i))).alias("range"),
            F.coalesce(F.try_element_at(F.col("counts"), i), F.lit(0)).alias("count"),
        ),
    )
    return counted.select(F.inline(rows))


def vocabulary(df: DataFrame, text_cols: Sequence[str]) -> DataFrame:
    """(column, sampled_rows, total_tokens, unique_tokens, ttr) over all texts.

    Each text adds one null word, whose count is the number of texts. Words are
    counted per task before the shuffle, so frequent words cost nothing extra.
    """
    cells = [
        F.struct(
            F.lit(c).alias("column"),
            F.array_append(
                F.regexp_extract_all(column(c), F.lit(WORD + "+"), F.lit(0)),
                F.lit(None).cast("string"),
            ).alias("words"),
        )
        for c in text_cols
    ]
    words = (
        df.select(F.inline(F.array(*cells)))
        .filter(F.col("words").isNotNull())
        .select("column", F.explode("words").alias("word"))
        .groupBy("column", F.lower("word").alias("word"))
        .agg(F.count("*").alias("n"))
    )
    is_word = F.col("word").isNotNull()
    totals = words.groupBy("column").agg(
        F.sum(F.when(~is_word, F.col("n"))).alias("sampled_rows"),
        F.coalesce(F.sum(F.when(is_word, F.col("n"))), F.lit(0)).alias("total_tokens"),
        F.count("word").alias("unique_tokens"),
    )
    ttr = F.try_divide(F.col("unique_tokens").cast("double"), F.col("total_tokens"))
    return totals.withColumn("ttr", F.coalesce(rounded(ttr, 4), F.lit(0.0)))


def noise(df: DataFrame, text_cols: Sequence[str], cfg: AuditConfig = DEFAULT) -> DataFrame:
    """(column, count, repetitive_rows)."""
    aggs, rows = [], []
    for i, c in enumerate(text_cols):
        aggs += [
            F.count(column(c)).alias(f"n{i}"),
            F.count_if(text.is_repetitive(column(c), cfg)).alias(f"r{i}"),
        ]
        rows.append(
            {
                "column": F.lit(c),
                "count": F.col(f"n{i}"),
                "repetitive_rows": F.col(f"r{i}"),
            }
        )
    return rows_from_wide(df.agg(*aggs), rows)


def boilerplate_openings(
    df: DataFrame, text_col: str, cfg: AuditConfig = DEFAULT
) -> DataFrame:
    """(opening, rows): the most shared openings, those of more than one row."""
    return (
        df.select(text.opening(column(text_col), cfg.opening_words).alias("opening"))
        .filter(F.col("opening") != "")
        .groupBy("opening")
        .agg(F.count("*").alias("rows"))
        .filter(F.col("rows") > 1)
        .orderBy(F.desc("rows"), "opening")
        .limit(cfg.top_openings)
    )
