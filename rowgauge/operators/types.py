"""Mixed value kinds in JSON-like data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import column


def _kind(v: Column) -> Column:
    """Value kind by its plain name; null for a JSON null."""
    schema = F.schema_of_variant(v)
    return (
        F.when(schema == "VOID", F.lit(None))
        .when(schema.startswith("ARRAY"), "list")
        .when(schema.startswith("OBJECT"), "dict")
        .when(schema.isin("DOUBLE", "FLOAT") | schema.startswith("DECIMAL"), "float")
        .when(schema == "BIGINT", "int")
        .when(schema == "BOOLEAN", "bool")
        .when(schema == "STRING", "str")
        .otherwise(F.lower(schema))
    )


def dtype_consistency(df: DataFrame, variant: str = "v") -> DataFrame:
    """(column, observed_types) for record keys that hold several kinds.

    Nested objects are opened one level (``a.b``). Whole and fractional
    numbers together are one numeric column, not a mix.
    """
    spark = df.sparkSession
    top = df.select(column(variant).alias("record")).lateralJoin(
        spark.tvf.variant_explode(F.col("record").outer())
    )
    top = top.select("key", "value", F.schema_of_variant("value").startswith("OBJECT").alias("opens"))
    inner = top.filter("opens").select(F.col("key").alias("parent"), F.col("value").alias("record"))
    inner = inner.lateralJoin(spark.tvf.variant_explode(F.col("record").outer()))
    cells = top.filter(~F.col("opens")).select(
        F.col("key").alias("column"), _kind(F.col("value")).alias("kind")
    ).unionAll(
        inner.select(
            F.concat_ws(".", "parent", "key").alias("column"), _kind(F.col("value")).alias("kind")
        )
    )
    kinds = F.array_sort(F.collect_set("kind"))
    return (
        cells.filter(F.col("kind").isNotNull())
        .groupBy("column", "kind")
        .agg(F.count("*").alias("n"))
        .groupBy("column")
        .agg(kinds.alias("observed_types"))
        .filter(
            (F.size("observed_types") > 1)
            & (F.size(F.array_except("observed_types", F.array(F.lit("int"), F.lit("float")))) > 0)
        )
    )
