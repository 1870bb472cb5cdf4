"""Bloom filters at the scan: nothing is lost, little passes, little moves."""

import random

from pyspark.sql import functions as F

from rowgauge.functions import bloom
from rowgauge.operators import leakage, repair

SPLITS = ["train", "test"]


def test_nothing_is_lost_and_little_passes(spark):
    keys = spark.range(20_000).select(F.md5(F.col("id").cast("string")).alias("k"))
    other = spark.range(20_000, 220_000).select(F.md5(F.col("id").cast("string")).alias("k"))
    held = bloom.bloom(keys.unionAll(spark.createDataFrame([(None,)], "k string")), "k")
    assert bloom.may_match(keys, F.col("k"), held).count() == 20_000
    assert bloom.may_match(keys, F.col("k"), held, "left_anti").count() == 0
    assert bloom.may_match(other, F.col("k"), held).count() < 200
    nulls = spark.createDataFrame([(None,)], "k string")
    assert bloom.may_match(nulls, F.col("k"), held).count() == 0
    assert bloom.may_match(nulls, F.col("k"), held, "left_anti").count() == 1


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    rows = made()
    monkeypatch.setattr(bloom, "WORDS", 1)
    check(spark, rows)


def made():
    rng = random.Random(2)
    rows = [(i, rng.choice(SPLITS + ["train"] * 6 + [None]), rng.choice([None, "", " A  b", "a B", *[f"text {k}" for k in range(300)]])) for i in range(1500)]
    return [*rows, (None, "train", "hot"), *[(2000 + i, "train", "hot") for i in range(500)], (3000, "test", "HOT")]


def check(spark, rows):
    df = spark.createDataFrame(rows, "id bigint, split string, text string").withColumn("word", F.lit(1)).withColumn("bits", F.lit(2))
    normal = lambda t: None if t is None else " ".join(t.split()).lower()
    train = {normal(t) for _, s, t in rows if s == "train" and t is not None}
    got = repair.drop_leaked(df, "text", SPLITS)
    assert got.columns == df.columns
    want = sorted(((i, s, t) for i, s, t in rows if s == "train" or normal(t) not in train), key=str)
    assert sorted(((r["id"], r["split"], r["text"]) for r in got.collect()), key=str) == want
    tests = [normal(t) for _, s, t in rows if s == "test"]
    leaked = sum(t in train for t in tests)
    found = leakage.split_leakage(df, "text", SPLITS).collect()
    assert [(r["split"], r["leaked_rows"]) for r in found] == [("test", leaked)]
    assert found[0]["leaked_pct"] == round(100 * leaked / len(tests), 2)


def test_leaks_against_plain_sets(spark):
    check(spark, made())


def shuffled(df):
    """Rows that the shuffles of an executed plan wrote."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    todo, total = [plan], {}
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if "QueryStage" in node.nodeName():
            todo.append(node.plan())
            continue
        if node.nodeName() == "Exchange":
            total[node.id()] = node.metrics().apply("shuffleRecordsWritten").value()
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return total


def test_training_keys_are_stopped_at_the_scan(spark):
    rows = spark.range(30_000).select(
        "id", F.when(F.col("id") % 1000 == 0, "test").otherwise("train").alias("split"), F.concat(F.lit("text "), F.col("id")).alias("text")
    )
    df = rows.unionAll(rows.filter("split = 'test'").select("id", F.lit("train"), "text"))
    for found in (leakage.split_leakage(df, "text", SPLITS), repair.drop_leaked(df, "text", SPLITS)):
        assert sum(shuffled(found).values()) < 1000
    assert repair.drop_leaked(df, "text", SPLITS).filter("split = 'test'").count() == 0
