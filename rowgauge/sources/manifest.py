"""Classifying dataset links without reading them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import WS

# --- Fixed values: formats, hosts and notes ----------------------------------
FORMATS = ("csv", "tsv", "json", "jsonl", "parquet")
HUB = "huggingface.co/datasets/"
CLOUD_SCHEMES = ("s3", "gs")
CLOUD_HOSTS = ("amazonaws.com", "storage.googleapis.com", "blob.core.windows.net")
NOTE_HUB = "Will load via the `datasets` library."
NOTE_GITHUB = "Converted GitHub blob URL to raw URL."
NOTE_CLOUD = "Cloud object storage URL."
NOTE_UNKNOWN = "Could not infer a supported file format from the URL."


def file_format(path: str) -> tuple[str, str]:
    """(format, compression) told by the extension of one path."""
    lowered = path.strip().lower()
    stem = lowered.removesuffix(".gz")
    known = next((f for f in FORMATS if stem.endswith("." + f)), "unknown")
    return known, "gzip" if stem != lowered else "none"


def classify_sources(df: DataFrame, link_col: str) -> DataFrame:
    """Adds source_type, resolved_url, file_format, compression and notes."""
    link = F.regexp_replace(F.col(link_col), rf"\A{WS}+|{WS}+\z", "")
    scheme = F.lower(F.regexp_extract(F.col("__link"), r"\A([a-zA-Z][a-zA-Z0-9+.\-]*):", 1))
    base = df.withColumn("__link", link).withColumn("__lower", F.lower("__link"))
    zipped = F.col("__lower").endswith(".gz")
    stem = F.when(zipped, F.expr("left(__lower, length(__lower) - 3)")).otherwise(F.col("__lower"))
    base = base.withColumn("__stem", stem).withColumn("__scheme", scheme)

    fmt = F.lit("unknown")
    for name in reversed(FORMATS):
        fmt = F.when(F.col("__stem").endswith("." + name), name).otherwise(fmt)
    low, scheme = F.col("__lower"), F.col("__scheme")
    in_cloud = scheme.isin(*CLOUD_SCHEMES)
    for host in CLOUD_HOSTS:
        in_cloud = in_cloud | low.contains(host)
    blob = low.contains("github.com") & F.col("__link").contains("/blob/")
    kind = (
        F.when((scheme == "") | (scheme == "file"), "local")
        .when(low.contains(HUB), "huggingface")
        .when(blob, "github_blob")
        .when(low.contains("raw.githubusercontent.com"), "github")
        .when(in_cloud, "cloud")
        .when(F.col("__format") != "unknown", "direct_file")
        .otherwise("unknown")
    )
    base = base.withColumn("__format", fmt).withColumn("__kind", kind)
    raw = F.replace(
        F.replace(F.col("__link"), F.lit("github.com"), F.lit("raw.githubusercontent.com")),
        F.lit("/blob/"),
        F.lit("/"),
    )
    is_blob = F.col("__kind") == "github_blob"
    return base.select(
        *[F.col(c) for c in df.columns],
        F.when(is_blob, "github").otherwise(F.col("__kind")).alias("source_type"),
        F.when(is_blob, raw).otherwise(F.col("__link")).alias("resolved_url"),
        F.col("__format").alias("file_format"),
        F.when(zipped, "gzip").otherwise("none").alias("compression"),
        F.when(is_blob, NOTE_GITHUB)
        .when(F.col("__kind") == "huggingface", NOTE_HUB)
        .when(F.col("__kind") == "cloud", NOTE_CLOUD)
        .when(F.col("__kind") == "unknown", NOTE_UNKNOWN)
        .otherwise("")
        .alias("notes"),
    )
