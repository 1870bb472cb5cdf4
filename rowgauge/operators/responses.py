"""Instruction/response consistency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, AuditConfig
from ..functions.canonical import canonical


def instruction_columns(df: DataFrame) -> tuple[str, str] | None:
    """The instruction and output columns, if the table has both."""
    by_name = {}
    for c in df.columns:
        by_name.setdefault(c.lower(), c)
    if "instruction" in by_name and "output" in by_name:
        return by_name["instruction"], by_name["output"]
    return None


def response_flags(
    df: DataFrame, instruction: str, output: str, cfg: AuditConfig = DEFAULT
) -> dict[str, Column]:
    """``empty_response`` and ``length_ratio``; a missing response is empty."""
    asked = F.length(F.coalesce(canonical(df, instruction), F.lit("")))
    given = F.length(F.coalesce(canonical(df, output), F.lit("")))
    return {
        "empty_response": given <= 1,
        "length_ratio": (given < F.lit(float(cfg.ratio_below)) * asked)
        & (asked > cfg.ratio_min_length),
    }


def response_checks(
    df: DataFrame, instruction: str, output: str, cfg: AuditConfig = DEFAULT
) -> DataFrame:
    """One row: empty responses and length-ratio anomalies."""
    flags = response_flags(df, instruction, output, cfg)
    return df.agg(
        F.count_if(flags["empty_response"]).alias("empty_responses"),
        F.count_if(flags["length_ratio"]).alias("length_ratio_rows"),
    )
