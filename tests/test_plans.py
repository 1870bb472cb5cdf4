"""Physical plans stay free of what does not scale."""

import pytest
from pyspark.sql import functions as F

from rowgauge.functions.text import normal_hash
from rowgauge.plans import audit
from suite.queries import QUERIES

SF = "/root/testdata/sf0.001"
LAZY = [
    "row_flags", "flag_counts", "pii_by_source", "duplicates", "split_leakage", "vocabulary",
    "token_distribution", "token_histogram", "repetition", "openings", "cardinality",
    "turn_order_long", "chat_flags_nested", "evidence", "flagged_rows", "normalised_text",
]
REFUSED = ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython", "MapInPandas", "Expand ", "RoundRobinPartitioning")


def plan_of(spark, name):
    return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_refused_operator(spark, name):
    plan = plan_of(spark, name)
    assert [op for op in REFUSED if op in plan] == []


def test_evidence_is_limited_before_the_shuffle(spark):
    plan = plan_of(spark, "evidence")
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_scans_read_only_what_they_need(spark):
    assert "ReadSchema: struct<text:string,source:string>" in plan_of(spark, "pii_by_source")
    assert "ReadSchema: struct<text:string,source:string>" in plan_of(spark, "split_leakage")


def test_aggregates_are_partial_first(spark):
    for name in ("duplicates", "vocabulary", "split_leakage", "openings"):
        assert "partial_count" in plan_of(spark, name)


def test_leakage_reads_other_splits_once(spark):
    """The other splits' keys are used twice and made once."""
    read = spark.sparkContext.accumulator(0)

    def seen(text):
        read.add(1)
        return text

    rest = spark.createDataFrame([("test", f"Text  {i}") for i in range(20)], "split string, text string")
    rest = rest.select("split", F.udf(seen, "string")("text").alias("text"))
    keys = spark.createDataFrame([(f"text {i}",) for i in range(15, 40)], "text string")
    slim = keys.select(F.unhex(normal_hash(F.col("text"))).alias("near/0"))
    leaks = audit._leaked(slim, "train", rest, ["test"])
    assert [tuple(r) for r in leaks] == [("test", 5, 25.0)]
    assert read.value == 20
