"""Merged sketches against one sketch of everything and against exact numbers."""

from pyspark.sql import functions as F

from rowgauge.functions.order_stats import order_statistics
from rowgauge.operators import sketches


def test_merge_equals_the_sketch_of_the_union(spark):
    df = spark.range(60_000).select(
        (F.col("id") % 20_011).alias("a"), F.when(F.col("id") % 5 > 0, F.sqrt("id")).alias("b"), F.concat(F.lit("t"), F.col("id") % 7).alias("c"),
        (F.col("id") % 4).alias("split"), F.lit(None).cast("string").alias("d"),
    )
    whole = {r["column"]: r for r in sketches.approximate_cardinality(sketches.merged(sketches.column_sketches(df.drop("split")))).collect()}
    parts = sketches.merged(sketches.column_sketches(df, "split"))
    got = {r["column"]: r for r in sketches.approximate_cardinality(parts).collect()}
    assert got == whole
    exact = {"a": 20_011, "b": 48_000, "c": 7, "d": 0}
    assert {c: r["present"] for c, r in got.items()} == {"a": 60_000, "b": 48_000, "c": 60_000, "d": 0}
    assert all(abs(got[c]["unique"] - n) <= n * sketches.DISTINCT_ERROR for c, n in exact.items())
    for r in sketches.approximate_quantiles(parts, [0.01, 0.5, 0.9]).collect():
        n = got[r["column"]]["present"]
        lo, hi = (max(0, min(n - 1, int(n * (r["share"] + e)))) for e in (-sketches.RANK_ERROR, sketches.RANK_ERROR))
        ends = order_statistics(df, {"x": F.col(r["column"]).cast("double")}, {"x": [lo, hi]})
        assert ends["x", lo] <= r["value"] <= ends["x", hi]


def test_new_data_joins_old_sketches(spark):
    old, new = spark.range(1000).toDF("v"), spark.range(500, 1500).toDF("v")
    kept = sketches.column_sketches(old).unionByName(sketches.column_sketches(new))
    row = sketches.approximate_cardinality(sketches.merged(kept)).first()
    assert row["present"] == 2000 and abs(row["unique"] - 1500) <= 1500 * sketches.DISTINCT_ERROR
    assert sketches.column_sketches(old.limit(0)).count() == 0
