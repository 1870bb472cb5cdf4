"""Cases in which an operator once did less than the whole job."""

import random

from pyspark.sql import functions as F

from rowgauge.llm import common, decontaminate, near_dup, toxicity
from tests.llm import brute


def longest_run(a, b):
    """Most consecutive words that both lists hold, without any window or mask."""
    best, above = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0] + [above[j] + 1 if x == y else 0 for j, y in enumerate(b)]
        best, above = max(best, *row), row
    return best


def test_partial_passages_are_leaks(spark):
    item = [f"w{i}" for i in range(48)]
    rows = []
    for n in range(6, 26):
        for start in (0, 17, 48 - n):
            i = len(rows)
            text = [f"a{i}x{j}" for j in range(15)] + item[start : start + n] + [f"b{i}x{j}" for j in range(15)]
            rows += [(i, " ".join(text), "s"), (1000 + i, " ".join(item[start : start + n]), "s")]
    bm = spark.createDataFrame([(69, " ".join(item))], "item_id bigint, text string")
    got = {r["doc_id"]: r for r in decontaminate.find_leaks(brute.frame(spark, rows), bm).collect()}
    runs = {i: longest_run(t.split(), item) for i, t, _ in rows}
    assert {i for i, n in runs.items() if n >= 12} <= set(got)
    assert not {i for i, n in runs.items() if n < 10} & set(got)
    assert all(0.8 <= r["best_match"] <= 1 for r in got.values())
    # A longer stretch that still reaches the share counts before a shorter one.
    assert all(got[i]["best_match"] == 1 for i in got if i >= 1000)


def test_brief_items_must_be_there_nearly_whole(spark):
    rows = [(1, "x y seven short words of one z z z", "s"), (2, "x seven short words of one brief y z", "s")]
    bm = spark.createDataFrame([(1, "seven short words of one brief item")], "item_id bigint, text string")
    assert [r["doc_id"] for r in decontaminate.find_leaks(brute.frame(spark, rows), bm).collect()] == [2]


def repeated_rows():
    """Long rows, several of each under one id, and the same without ids."""
    rng = random.Random(23)
    texts = [brute.prose(rng, 120) for _ in range(3)]
    rows = [(i, t + " tail", "s") for i, t in enumerate(texts) for _ in range(3)]
    return rows + [(None, t + f" other end {k}", "s") for t in texts for k in range(2) for _ in range(4)]


def test_one_full_set_a_class(spark):
    rows = repeated_rows()
    docs = brute.frame(spark, rows).select(common.whole_id("doc_id").alias("_id"), F.col("text").alias("_text"))
    signed = docs.mapInArrow(near_dup._sign, near_dup.SIGNATURE)
    classes = common.written(
        signed.groupBy("_set").agg(F.min("_id").alias("_rep"), F.count(F.lit(1)).alias("_copies")).withColumn("_class", F.monotonically_increasing_id())
    )
    got = near_dup.full_sets(docs, classes, classes).collect()
    assert len(got) == len({r["_class"] for r in got}) == 9
    want = {len(brute.shingles(t)) for _, t, _ in rows}
    assert {len(r["_items"]) for r in got} == want


def test_repeated_rows_in_crowds(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 7)
    monkeypatch.setattr(near_dup, "CROWD", 3)
    monkeypatch.setattr(near_dup, "RARE", 4)
    rng = random.Random(29)
    words = brute.prose(rng, 110).split()
    rows = []
    for i in range(30):
        w = list(words)
        for _ in range(1 + i % 4):
            w[rng.randrange(len(w))] = f"q{rng.randrange(10**6)}"
        rows += [(i if i % 5 else None, " ".join(w), "s")] * (1 + i % 3)
    got = near_dup.near_duplicates(brute.frame(spark, rows), percent=85).collect()
    want = brute.groups(rows, 85)
    assert sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"] or -1) for r in got) == sorted((i or -1, n, c or -1) for i, n, c in want)


def test_words_glued_by_the_end_of_a_clause_are_weighed():
    raw = toxicity.Reader(toxicity.Model({"idiot": 1.0}, {})).raw
    assert raw("Go!kill you") == 1.0 and raw("stop;idiot") == 1.0 and raw("go!walk you") == 0.0
