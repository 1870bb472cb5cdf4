"""Numeric outliers and correlation."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, AuditConfig
from ..functions.canonical import clean, column, numeric_columns
from ..functions.numbers import rounded
from ..functions.order_stats import order_statistics
from .flags import evidence, example_lists
from .shape import rows_from_wide

#: Columns of a block of the Gram matrix, first adders of a block, rows looked at for centres.
BLOCK, ADDERS, LOOK = 16, 64, 1000


def _as_double(df: DataFrame, name: str) -> Column:
    return clean(df, name).cast("double")


def quartiles(
    df: DataFrame, names: Sequence[str], min_values: int = 1, **sizes
) -> dict[str, dict[str, float]]:
    """Count, mean, deviation and exact linear-interpolated quartiles."""
    if not names:
        return {}
    cols = {c: _as_double(df, c) for c in names}
    aggs = []
    for c in cols.values():
        aggs += [F.count(c), F.min(c), F.max(c), F.avg(c), F.stddev_samp(c)]
    row = df.agg(*[e.alias(f"x{i}") for i, e in enumerate(aggs)]).first()
    basics = {c: row[5 * i : 5 * i + 5] for i, c in enumerate(names)}
    basics = {c: v for c, v in basics.items() if v[0] >= max(min_values, 1)}
    ranks = {}
    for c, (n, *_rest) in basics.items():
        at = [(n - 1) * p for p in (0.25, 0.75)]
        ranks[c] = [f(x) for x in at for f in (math.floor, math.ceil)]
    values = order_statistics(
        df,
        {c: cols[c] for c in basics},
        ranks,
        {c: (v[0], v[1], v[2]) for c, v in basics.items()},
        **sizes,
    )
    out = {}
    for c, (n, _low, _high, mean, std) in basics.items():
        q = []
        for p in (0.25, 0.75):
            at = (n - 1) * p
            lower, upper = values[c, math.floor(at)], values[c, math.ceil(at)]
            share, gap = at - math.floor(at), upper - lower
            q.append(upper - gap * (1 - share) if share >= 0.5 else lower + gap * share)
        out[c] = {"n": n, "mean": mean, "std": std, "q1": q[0], "q3": q[1]}
    return out


def numeric_outliers(
    df: DataFrame,
    row_id: str | None = None,
    columns: Sequence[str] | None = None,
    cfg: AuditConfig = DEFAULT,
    **sizes,
) -> DataFrame:
    """(column, iqr_outliers, zscore_outliers, example_rows)."""
    skip = [row_id] if row_id else []
    names = list(columns) if columns is not None else numeric_columns(df, skip)
    stats = quartiles(df, names, cfg.min_outlier_values, **sizes)
    counts, rows, outside = [], [], {}
    for i, (c, s) in enumerate(stats.items()):
        v = _as_double(df, c)
        reach = cfg.iqr_factor * (s["q3"] - s["q1"])
        outside[c] = (v < s["q1"] - reach) | (v > s["q3"] + reach)
        # With an infinity among the values there is no mean to be far from.
        known = s["std"] and math.isfinite(s["mean"]) and math.isfinite(s["std"])
        far = F.abs(v - s["mean"]) / s["std"] > cfg.z_threshold if known else F.lit(False)
        counts += [F.count_if(outside[c]).alias(f"i{i}"), F.count_if(far).alias(f"z{i}")]
        rows.append(
            {
                "column": F.lit(c),
                "iqr_outliers": F.col(f"i{i}"),
                "zscore_outliers": F.col(f"z{i}"),
            }
        )
    if not rows:
        schema = "column string, iqr_outliers bigint, zscore_outliers bigint"
        result = df.sparkSession.createDataFrame([], schema)
    else:
        result = rows_from_wide(df.agg(*counts), rows)
    if row_id is None or not rows:
        return result
    flagged = df.select(column(row_id), *[e.alias(c) for c, e in outside.items()])
    examples = example_lists(evidence(flagged, row_id, list(outside), cfg.max_examples))
    return result.join(examples.withColumnRenamed("check", "column"), "column", "left")


def _centres(df: DataFrame, names: Sequence[str]) -> list[float]:
    """A value near each column's others, from a look at a few rows: sums around it
    keep their digits. Any value gives the same correlations but for rounding."""
    few = df.select(*[_as_double(df, c).alias(f"c{i}") for i, c in enumerate(names)]).limit(LOOK).toArrow()
    out = []
    for column_ in few.columns:
        values = sorted(v for v in column_.to_pylist() if v is not None and math.isfinite(v))
        out.append(values[len(values) // 2] if values else 0.0)
    return out


#: Sums of a pair of columns over the rows where both are present.
SUMS = ("n", "x", "y", "xx", "yy", "xy")


def _gram(centres: Sequence[float]):
    """Sums of all pairs of columns over a task's rows, one row per block of columns.

    With gaps as zeros and a mask of what is present, every sum is one matrix
    product: n = M'M, x = X'M, xx = (X*X)'M, xy = X'X.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(centres)
        gram = np.zeros((len(SUMS), k, k))
        low, high, infinite = np.full(k, np.inf), np.full(k, -np.inf), np.zeros(k, bool)
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            present = ~np.isnan(x)
            infinite |= np.isinf(x).any(axis=0)
            low, high = np.fmin(low, np.fmin.reduce(x, axis=0, initial=np.inf)), np.fmax(high, np.fmax.reduce(x, axis=0, initial=-np.inf))
            x = np.where(present & np.isfinite(x), x - np.array(centres), 0.0)
            m = present.astype(np.float64)
            sx, sxx = x.T @ m, (x * x).T @ m
            for total, part in zip(gram, (m.T @ m, sx, sx.T, sxx, sxx.T, x.T @ x), strict=True):
                total += part
        for i in range(0, k, BLOCK):
            for j in range(i, k, BLOCK):
                both = np.r_[i : min(k, i + BLOCK), j : min(k, j + BLOCK)]
                part = gram[:, i : i + BLOCK, j : j + BLOCK]
                lists = [part.reshape(-1), low[both], high[both], infinite[both].astype(np.float64)]
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array([x], pa.int32()) for x in (i, j, *part.shape[1:])], *[pa.array([x], pa.list_(pa.float64())) for x in lists]],
                    [*PLACE, *LISTS],
                )

    return run


PLACE, LISTS = ("i", "j", "height", "width"), ("sums", "low", "high", "infinite")


def _added(group: pa.Table) -> pa.Table:
    sums, low, high, infinite = (np.stack(group.column(c).to_numpy()) for c in LISTS)
    lists = [sums.sum(axis=0), low.min(axis=0), high.max(axis=0), infinite.max(axis=0)]
    first = group.slice(0, 1)
    made = {n: pa.array([x], pa.list_(pa.float64())) for n, x in zip(LISTS, lists, strict=True)}
    return pa.table({c: first.column(c) for c in PLACE} | made)


def numeric_correlation(
    df: DataFrame, columns: Sequence[str] | None = None, cfg: AuditConfig = DEFAULT
) -> DataFrame:
    """(col_a, col_b, correlation): pairwise-complete Pearson, strong pairs only.

    One scan, whatever the number of columns: every task adds up the Gram matrix of
    its rows with gap masks, in blocks of columns; blocks are added up in two steps,
    so that no task sees those of all others. A column that does not vary or holds
    an infinity has no correlation.
    """
    names = list(columns) if columns is not None else numeric_columns(df)
    empty = df.sparkSession.createDataFrame([], "col_a string, col_b string, correlation double")
    if len(names) < 2:
        return empty
    values = df.select(*[F.coalesce(_as_double(df, c), F.lit(float("nan"))).alias(f"c{i}") for i, c in enumerate(names)])
    schema = ", ".join([f"{c} int" for c in PLACE] + [f"{c} array<double>" for c in LISTS])
    parts = values.mapInArrow(_gram(_centres(df, names)), schema)
    some = parts.groupBy("i", "j", F.pmod(F.spark_partition_id(), F.lit(ADDERS)).alias("adder")).applyInArrow(_added, schema)
    blocks = some.groupBy("i", "j").applyInArrow(_added, schema)
    area = F.col("height") * F.col("width")
    cells = blocks.select("*", F.explode(F.sequence(F.lit(0), area - 1)).alias("at")).select(
        "*", F.floor(F.col("at") / F.col("width")).cast("int").alias("down"), (F.col("at") % F.col("width")).alias("across")
    )
    varies = lambda p: (F.get("infinite", p) == 0) & (F.get("low", p) < F.get("high", p))
    kept = cells.filter(varies(F.col("down")) & varies(F.col("height") + F.col("across"))).select(
        (F.col("i") + F.col("down")).alias("a"), (F.col("j") + F.col("across")).alias("b"),
        *[F.get("sums", F.col("at") + k * area).alias(s) for k, s in enumerate(SUMS)],
    ).filter("a < b")
    spread = "(xx - try_divide(x * x, n)) * (yy - try_divide(y * y, n))"
    r = F.expr(f"CASE WHEN {spread} > 0 THEN try_divide(xy - try_divide(x * y, n), sqrt({spread})) END")
    label = F.lit(names)
    return kept.select(F.get(label, "a").alias("col_a"), F.get(label, "b").alias("col_b"), r.alias("r")).filter(F.abs("r") >= cfg.correlation_from).select(
        "col_a", "col_b", rounded(F.col("r"), 3).alias("correlation")
    )
