"""Writing audit results."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .manifest import classify_sources


def write_report(report, path: str, audit_id: str, fmt: str = "parquet") -> None:
    """Checks, scores, splits and leakage as tables partitioned by audit.

    An audit written again replaces its own partition and no other.
    """
    tables: dict[str, DataFrame] = {
        "checks": report.checks,
        "dimensions": report.dimensions,
        "overall": report.overall,
        "splits": report.splits,
        "evidence": report.evidence.withColumn("row_id", F.col("row_id").cast("string")),
    }
    if report.leakage is not None:
        tables["leakage"] = report.leakage
    for name, df in tables.items():
        (
            df.withColumn("audit_id", F.lit(audit_id))
            .coalesce(1)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("audit_id")
            .format(fmt)
            .save(f"{path}/{name}")
        )


def report_to_json(report) -> str:
    """The whole report as one JSON text; all its tables are small."""
    overall = report.overall.first().asDict()
    counts = {k: overall[k] for k in ("fail", "warn", "pass", "critical", "high")}
    splits = {r["split"]: r.asDict() for r in report.splits.collect()}
    if report.leakage is None:
        leaks = {"checked": False, "reason": report.leakage_reason}
    else:
        by_split = {r["split"]: r.asDict() for r in report.leakage.collect()}
        leaks = {"checked": True, "column": report.text_columns[0], "by_split": by_split}
    spark = report.checks.sparkSession
    link = classify_sources(spark.createDataFrame([(report.link,)], "link string"), "link").first()
    return json.dumps(
        {
            "generated_at": datetime.now(timezone.utc).isoformat(),
            "link": report.link,
            "source": {
                "type": link["source_type"],
                "resolved_url": link["resolved_url"],
                "format": link["file_format"],
            },
            "splits": splits,
            "primary_split": report.primary_split,
            "scorecard": {
                "overall": overall["overall"],
                "overall_rating": overall["overall_rating"],
                "dimensions": [r.asDict() for r in report.dimensions.collect()],
                "counts": counts,
            },
            "format_detected": report.formats,
            "tests": [r.asDict() for r in report.checks.orderBy("position").collect()],
            "leakage": leaks,
        },
        indent=2,
        default=str,
    )
