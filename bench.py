"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from suite.queries import QUERIES  # noqa: E402

HEADLINE = (
    "pii_counts", "pii_by_source", "row_flags", "text_quality", "toxicity", "duplicates",
    "split_leakage", "vocabulary", "token_distribution", "repetition", "openings", "cardinality",
    "cardinality_lineitem", "class_balance_lineitem", "outliers", "outliers_lineitem",
    "correlation", "turn_order_long", "chat_flags_nested", "evidence", "checks",
)


def spread(spark: SparkSession, sf_dir: str, cpus: int) -> str:
    """The tables with a file per core, as a large table has many: documents.parquet
    is one row group, which only one task can read. Not timed."""
    folder = os.path.join(spark.conf.get("spark.checkpoint.dir"), "tables")
    for name in sorted(os.listdir(sf_dir)):
        if name.endswith(".parquet"):
            spark.read.parquet(f"{sf_dir}/{name}").repartition(cpus).write.parquet(f"{folder}/{name}")
    return folder


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("rowgauge-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="rowgauge-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    tables = spread(spark, sf_dir, int(cpus))
    seconds = {}
    for name in names:
        times = []
        for _ in range(runs + 1):  # the first run warms up
            start = time.perf_counter()
            QUERIES[name](spark, tables).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(sorted(times[1:])[(len(times) - 1) // 2], 3)
        print(name, [round(t, 2) for t in times], file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
