"""Profile statistics against pandas on small tables."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rowgauge.functions.order_stats import order_statistics
from rowgauge.operators import corpus, numeric, profile, types
from rowgauge.operators.leakage import split_leakage


def rows_of(df, key):
    return {r[key]: r.asDict() for r in df.collect()}


@pytest.fixture(scope="module")
def messy(spark):
    nan = float("nan")
    return spark.createDataFrame(
        [
            (1, 1.0, "a", None, True, [1, 2], {"x": 1, "y": 2}),
            (1, 1.0, "a", None, True, [1, 2], {"y": 2, "x": 1}),
            (2, nan, "a ", None, None, [2, 1], {"x": 1}),
            (2, nan, None, None, None, None, None),
            (3, -0.0, "B", None, False, [], {}),
            (3, 0.0, "B", None, False, [], {}),
            (None, None, None, None, None, None, None),
        ],
        "i int, d double, s string, e string, b boolean, l array<int>, m map<string,int>",
    )


def test_missing_and_unique(messy):
    got = rows_of(profile.schema_report(messy), "column")
    assert {c: got[c]["null_count"] for c in got} == {"i": 1, "d": 3, "s": 2, "e": 7, "b": 3, "l": 2, "m": 2}
    assert {c: got[c]["unique"] for c in got} == {"i": 3, "d": 2, "s": 3, "e": 0, "b": 2, "l": 3, "m": 3}
    assert got["d"]["null_pct"] == round(300 / 7, 2) and got["i"]["dtype"] == "int"
    assert profile.fully_empty_rows(messy).first()[0] == 1


def test_cardinality(messy):
    got = rows_of(profile.cardinality(messy), "column")
    assert got["e"]["constant"] and not got["i"]["constant"]
    assert got["i"]["unique_ratio"] == round(3 / 7, 4)
    ids = messy.sparkSession.range(10).toDF("id")
    assert rows_of(profile.cardinality(ids), "column")["id"]["high_cardinality"]
    none = profile.cardinality(ids.limit(0)).first()
    assert none.unique == 0 and none.unique_ratio == 0.0 and none.constant


def test_duplicates(messy):
    got = {(r.kind, r["column"]): (r.duplicate_rows, r.duplicate_pct) for r in profile.duplicates(messy, ["s"]).collect()}
    assert got["exact", ""] == (2, round(200 / 7, 2))
    assert got["near", "s"] == (3, round(300 / 7, 2))


def test_duplicate_keys_do_not_run_together(spark):
    df = spark.createDataFrame([("a", "bc"), ("ab", "c"), (None, "~"), ("~", None)], "x string, y string")
    assert profile.duplicates(df, []).first().duplicate_rows == 0


def test_co_missing_matches_pandas(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"a": rng.normal(size=200), "b": rng.normal(size=200), "c": rng.normal(size=200), "d": 1.0})
    pdf.loc[rng.random(200) < 0.4, "a"] = np.nan
    pdf.loc[pdf.a.isna() | (rng.random(200) < 0.05), "b"] = np.nan
    pdf.loc[rng.random(200) < 0.2, "c"] = np.nan
    mask = pdf[["a", "b", "c"]].isna().astype(int).corr()
    want = {("a", "b"): round(mask.loc["a", "b"], 2)}
    got = {(r.col_a, r.col_b): r.corr for r in profile.correlated_missingness(spark.createDataFrame(pdf)).collect()}
    assert got == want


def test_co_missing_without_gaps(spark):
    assert profile.correlated_missingness(spark.range(5).toDF("a")).count() == 0


def test_class_balance(spark):
    rows = [("a", 1, "x")] * 30 + [("b", 2, "x")] * 2 + [("c", 2, "x")] * 2 + [(None, 1, "x")] * 6
    df = spark.createDataFrame(rows, "l string, n int, k string").withColumn("u", F.monotonically_increasing_id())
    got = rows_of(profile.class_balance(df), "column")
    assert set(got) == {"l", "n", "u"}
    assert got["l"]["classes"] == 3 and got["l"]["majority_label"] == "a" and got["l"]["minority_label"] == "c"
    assert got["l"]["majority_pct"] == 75.0 and got["l"]["imbalance_ratio"] == 15.0
    assert got["l"]["verdict"] == "severe_imbalance" and got["n"]["verdict"] == "moderate_imbalance"
    assert got["u"]["verdict"] == "balanced"


@pytest.mark.parametrize("classes,found", [(2, True), (50, True), (51, False), (400, False)])
def test_class_limit_is_exact(spark, classes, found):
    df = spark.range(2000).select((F.col("id") % classes).alias("label"))
    assert (profile.class_balance(df).count() == 1) is found


@pytest.mark.parametrize("small,accuracy", [(5, 20), (50, 100), (100_000, 10_000)])
def test_order_statistics(spark, small, accuracy):
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.normal(size=700), np.full(900, 0.25), [math.pi] * 5, -rng.pareto(1, 400)])
    df = spark.createDataFrame(pd.DataFrame({"v": values})).repartition(5)
    ranks = [0, 1, 399, 400, 1000, 1001, 1500, 2003, 2004]
    got = order_statistics(df, {"v": F.col("v")}, {"v": ranks + [5000]}, small=small, accuracy=accuracy)
    ordered = np.sort(values)
    assert got == {("v", r): ordered[r] for r in ranks}


@pytest.mark.parametrize("small", [10, 100_000])
def test_outliers_match_pandas(spark, small):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"id": np.arange(500), "a": rng.standard_t(2, 500), "b": 5.0, "c": rng.integers(0, 4, 500)})
    pdf.loc[::7, "a"] = np.nan
    got = rows_of(
        numeric.numeric_outliers(spark.createDataFrame(pdf), "id", small=small, accuracy=50), "column"
    )
    for c in ("a", "b", "c"):
        s = pdf[c].dropna()
        q1, q3 = s.quantile(0.25), s.quantile(0.75)
        mask = (s < q1 - 1.5 * (q3 - q1)) | (s > q3 + 1.5 * (q3 - q1))
        z = int(((s - s.mean()).abs() / s.std() > 3).sum()) if s.std() else 0
        assert (got[c]["iqr_outliers"], got[c]["zscore_outliers"]) == (int(mask.sum()), z)
        assert (got[c]["example_rows"] or []) == s.index[mask].tolist()[:5]


def test_outliers_need_ten_values(spark):
    assert numeric.numeric_outliers(spark.range(9).toDF("v")).count() == 0


def test_correlation_matches_pandas(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=300) + 1e6
    pdf = pd.DataFrame({"x": x, "y": 2 * x + rng.normal(size=300) * 0.2, "k": 3.1, "z": -x, "w": rng.normal(size=300)})
    pdf.loc[::5, "y"] = np.nan
    pdf.loc[::3, "z"] = np.nan
    corr = pdf.corr()
    cols = list(pdf.columns)
    want = {
        (a, b): round(corr.loc[a, b], 3)
        for i, a in enumerate(cols) for b in cols[i + 1 :]
        if pd.notna(corr.loc[a, b]) and abs(corr.loc[a, b]) >= 0.8
    }
    got = {(r.col_a, r.col_b): r.correlation for r in numeric.numeric_correlation(spark.createDataFrame(pdf)).collect()}
    assert got == want and want


def test_wide_correlation_covers_all_pairs(spark):
    df = spark.range(50).select(*[(F.col("id") * (i + 1)).cast("double").alias(f"c{i}") for i in range(19)])
    got = {(r.col_a, r.col_b) for r in numeric.numeric_correlation(df).collect()}
    assert len(got) == 19 * 18 // 2


def test_token_distribution_matches_pandas(spark):
    texts = ["x" * n for n in (1, 3, 9, 18, 18, 40, 77, 400)]
    k = pd.Series([max(1, round(len(t) / 4)) for t in texts])
    q = k.quantile([0.05, 0.25, 0.5, 0.75, 0.95, 0.99]).round(1)
    got = corpus.token_distribution(spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string"), ["t"]).first()
    assert [got[f"p{p}"] for p in (5, 25, 50, 75, 95, 99)] == q.tolist()
    assert (got["count"], got["min"], got["max"], got["total_tokens"]) == (8, k.min(), k.max(), k.sum())


@pytest.mark.parametrize("sizes", [(4, 8, 400), (40,), (4, 8, 12, 16, 20, 400, 404, 800, 1600, 3200, 36, 40, 44, 48)])
def test_histogram_matches_pandas(spark, sizes):
    k = pd.Series([n // 4 for n in sizes])
    binned = pd.cut(k, bins=min(12, k.nunique())).value_counts().sort_index()
    want = [(f"{int(iv.left)}-{int(iv.right)}", c) for iv, c in binned.items()]
    df = spark.createDataFrame([("x" * n,) for n in sizes], "t string")
    got = corpus.length_histogram(df, "t").orderBy("bin").collect()
    assert [(r.range, r["count"]) for r in got] == want


def test_vocabulary(spark):
    df = spark.createDataFrame([("The the CAFÉ café",), ("日本 naïve_x 1",), (None,), ("...",)], "t string")
    r = corpus.vocabulary(df, ["t"]).first()
    assert (r.sampled_rows, r.total_tokens, r.unique_tokens, r.ttr) == (3, 7, 5, round(5 / 7, 4))
    r = corpus.vocabulary(df.limit(4).filter("t = '...'"), ["t"]).first()
    assert (r.sampled_rows, r.total_tokens, r.ttr) == (1, 0, 0.0)


def test_leakage(spark):
    rows = [("train", "A  b"), ("train", "c"), ("train", None), ("test", " a B "), ("test", "a b"), ("test", "x"),
            ("test", None), ("dev", "y")]
    df = spark.createDataFrame(rows, "split string, t string")
    got = {r.split: (r.leaked_rows, r.leaked_pct) for r in split_leakage(df, "t", ["train", "test", "dev"]).collect()}
    assert got == {"test": (2, 50.0), "dev": (0, 0.0)}
    assert split_leakage(df, "t", ["a", "b"]).count() == 0


def test_mixed_types(spark):
    lines = ['{"a": 1, "b": 1, "c": {"x": 1}, "d": [1], "e": null}', '{"a": "s", "b": 1.5, "c": {"x": "t"}, "d": [2]}',
             '{"a": true, "c": "flat"}']
    df = spark.createDataFrame([(line,) for line in lines], "j string").select(F.parse_json("j").alias("v"))
    got = {r["column"]: r.observed_types for r in types.dtype_consistency(df).collect()}
    assert got == {"a": ["bool", "int", "str"], "c.x": ["int", "str"]}


def test_hot_key_and_partitioning_do_not_matter(spark):
    rows = [(i, "same text here" if i % 3 else f"text number {i}") for i in range(900)]
    df = spark.createDataFrame(rows, "id long, t string")
    results = []
    for parts in (1, 9):
        d = df.repartition(parts, F.rand(parts))
        dup = profile.duplicates(d.drop("id"), ["t"]).orderBy("kind").collect()
        voc = corpus.vocabulary(d, ["t"]).collect()
        results.append((dup, voc))
    assert results[0] == results[1] and results[0][0][0].duplicate_rows == 599
