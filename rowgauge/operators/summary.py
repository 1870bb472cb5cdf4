"""Per-text-column summary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, AuditConfig
from ..functions.canonical import column
from .corpus import token_distribution
from .flags import flag_counts
from .profile import missingness


def column_summary(
    df: DataFrame, text_cols: Sequence[str], cfg: AuditConfig = DEFAULT
) -> DataFrame:
    """Missing share, token numbers, quality counts and PII hits per text column."""
    flags = flag_counts(df, text_cols, cfg).groupBy("column").agg(
        *[
            F.sum(F.when(F.col("flag") == flag, F.col("rows"))).alias(name)
            for flag, name in (
                ("empty_or_whitespace", "empty_cells"),
                ("html_bleed", "html_bleed"),
                ("encoding_artifacts", "encoding_artifacts"),
                ("whitespace_anomalies", "whitespace_anomalies"),
            )
        ],
        F.coalesce(
            F.sum(F.when(F.col("flag").startswith("pii_"), F.col("rows"))), F.lit(0)
        ).alias("pii_hits"),
    )
    lengths = token_distribution(df, text_cols, cfg).select(
        "column",
        F.floor("p50").alias("median_tokens"),
        F.col("max").alias("max_tokens"),
        "total_tokens",
    )
    gaps = missingness(df.select(*[column(c) for c in text_cols])).select("column", "null_pct")
    return gaps.join(lengths, "column", "left").join(flags, "column", "left")
