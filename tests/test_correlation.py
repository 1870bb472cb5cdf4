"""The Gram matrix in one scan against pandas."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from rowgauge.config import AuditConfig
from rowgauge.operators import numeric

EVERY = AuditConfig(correlation_from=0.0)


def made(rows=400, wide=37):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(rows, wide)) + 1e6 * np.arange(wide)
    base[:, 5] = base[:, 4] * -3 + rng.normal(size=rows) * 1e-3
    base[:, 9] = 2**40 + rng.normal(size=rows)
    base[:, 10] = base[:, 9] + rng.normal(size=rows) * 0.1
    frame = pd.DataFrame(base, columns=[f"v{k}" for k in range(wide)])
    frame["flat"], frame["blank"] = 1.5, np.nan
    frame["endless"] = np.where(np.arange(rows) == 7, np.inf, np.arange(rows))
    frame["few"] = np.where(np.arange(rows) % 9 == 0, frame["v4"] * 2, np.nan)
    for k in (1, 4, 20):
        frame.loc[rng.random(rows) < 0.3, f"v{k}"] = np.nan
    return frame


def test_against_pandas(spark):
    frame = made()
    df = spark.createDataFrame(frame).repartition(5)
    got = {(r["col_a"], r["col_b"]): r["correlation"] for r in numeric.numeric_correlation(df, cfg=EVERY).collect()}
    want = frame.drop(columns=["flat", "blank", "endless"]).corr(min_periods=1)
    names = list(want)
    expected = {(a, b): want.loc[a, b] for i, a in enumerate(names) for b in names[i + 1 :] if not np.isnan(want.loc[a, b])}
    assert got.keys() == expected.keys()
    assert max(abs(got[p] - expected[p]) for p in got) <= 6e-4
    assert got["v4", "few"] > 0.999 and got["v4", "v5"] < -0.999 and got["v9", "v10"] > 0.99


def test_one_scan_for_many_columns(spark, tmp_path):
    names = [f"v{k}" for k in range(200)]
    spark.range(50).select(*[(F.col("id") * (k + 1) % 97).alias(n) for k, n in enumerate(names)]).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    found = numeric.numeric_correlation(df)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
    assert found.filter("col_a = 'v0' AND col_b = 'v97'").count() == 1


def test_no_columns_and_no_rows(spark):
    df = spark.createDataFrame([(1, "x")], "a int, t string")
    assert numeric.numeric_correlation(df).count() == 0
    assert numeric.numeric_correlation(spark.range(0).select("id", (F.col("id") * 2).alias("b")), cfg=EVERY).count() == 0
