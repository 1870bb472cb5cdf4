"""Weighted readiness score over a table of checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, LOWEST_RATING, RATINGS, AuditConfig
from ..operators.shape import rows_from_wide
from .catalog import FAIL, WARN


def _rating(score: Column) -> Column:
    expr = F.lit(LOWEST_RATING)
    for least, name in reversed(RATINGS):
        expr = F.when(score >= least, name).otherwise(expr)
    return expr


def _dimension_scores(cfg: AuditConfig) -> list[Column]:
    """One aggregate per dimension; a dimension without checks has 100.

    Decimals throughout: halves of whole penalties stay exact.
    """
    points = "CASE severity " + " ".join(
        f"WHEN '{severity}' THEN {value}" for severity, value in cfg.penalties.items()
    ) + " ELSE 0 END"
    share = f"CASE status WHEN '{FAIL}' THEN 1.0 WHEN '{WARN}' THEN 0.5 ELSE 0.0 END"
    scores = []
    for i, (_name, _weight, categories) in enumerate(cfg.dimensions):
        listed = ", ".join(f"'{c}'" for c in categories)
        lost = f"sum(CASE WHEN category IN ({listed}) THEN ({points}) * ({share}) END)"
        left = f"greatest(bround(100 - coalesce({lost}, 0), 1), 0)"
        scores.append(F.expr(f"CAST({left} AS DECIMAL(10, 1)) AS d{i}"))
    return scores


def score_dimensions(checks: DataFrame, cfg: AuditConfig = DEFAULT) -> DataFrame:
    """(dimension, score, weight, rating)."""
    rows = [
        {
            "dimension": F.lit(name),
            "score": F.col(f"d{i}").cast("double"),
            "weight": F.lit(float(weight)),
            "rating": _rating(F.col(f"d{i}")),
        }
        for i, (name, weight, _categories) in enumerate(cfg.dimensions)
    ]
    return rows_from_wide(checks.agg(*_dimension_scores(cfg)), rows)


def score_overall(checks: DataFrame, cfg: AuditConfig = DEFAULT) -> DataFrame:
    """One row: overall, rating and the counts by status and severity."""
    total = F.lit("0").cast("decimal(10,3)")
    for i, (_name, weight, _categories) in enumerate(cfg.dimensions):
        total = total + F.col(f"d{i}") * F.lit(weight).cast("decimal(4,2)")
    status, severity = F.col("status"), F.col("severity")
    counts = {
        "fail": status == FAIL,
        "warn": status == WARN,
        "pass": status == "PASS",
        "critical": (severity == "CRITICAL") & (status == FAIL),
        "high": (severity == "HIGH") & status.isin(FAIL, WARN),
    }
    row = checks.agg(
        *_dimension_scores(cfg), *[F.count_if(v).alias(k) for k, v in counts.items()],
    )
    overall = F.bround(total, 1)
    return row.select(
        overall.cast("double").alias("overall"),
        _rating(overall).alias("overall_rating"),
        *counts,
    )


def gate(overall: DataFrame, fail_under: float | None = None) -> DataFrame:
    """One row (passed, reason): no critical failure, and not under the limit."""
    critical = F.col("critical") > 0
    below = F.lit(False) if fail_under is None else F.col("overall") < F.lit(fail_under)
    reason = (
        F.when(critical, "critical check failed")
        .when(below, "overall score is below the limit")
        .otherwise("")
    )
    return overall.select((~critical & ~below).alias("passed"), reason.alias("reason"))
