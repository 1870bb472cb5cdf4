"""Row ranges, split sizes and the split to audit."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.canonical import NESTED, column, type_of
from ..functions.order_stats import order_statistics
from ..operators.leakage import training_split


def row_range(
    df: DataFrame,
    row_id: str,
    start: int = 0,
    limit: int | None = None,
    split_col: str | None = None,
    **sizes,
) -> DataFrame:
    """Rows ``start`` to ``start + limit`` of each split in ``row_id`` order.

    ``row_id`` must be a unique number or timestamp. The ids at the two ends
    are found first, so the result is a plain filter on ``row_id``: no sort, no
    single task that counts rows, and Parquet skips what lies outside.
    """
    start = max(start, 0)
    if start == 0 and limit is None:
        return df
    key = column(row_id)
    if split_col is None:
        names, columns = [None], {"0": key}
    else:
        names = [r[0] for r in df.select(column(split_col)).distinct().collect()]
        columns = {
            str(i): F.when(column(split_col).eqNullSafe(F.lit(s)), key)
            for i, s in enumerate(names)
        }
    wanted = [start] + ([start + limit] if limit is not None else [])
    ends = order_statistics(df, columns, {i: wanted for i in columns}, **sizes)
    keep = F.lit(False)
    for i, s in enumerate(names):
        first = ends.get((str(i), start))
        if first is None:
            continue
        inside = key >= F.lit(first)
        last = ends.get((str(i), start + limit)) if limit is not None else None
        if last is not None:
            inside = inside & (key < F.lit(last))
        if split_col is not None:
            inside = inside & column(split_col).eqNullSafe(F.lit(s))
        keep = inside if len(names) == 1 else keep | inside
    return df.filter(keep)


def rows_by_position(spark: SparkSession, path: str, start: int = 0, limit: int | None = None) -> DataFrame:
    """Rows ``start`` to ``start + limit`` of a Parquet table that has no numbered key.

    A row's position is its place in its file behind the rows of all files before it
    in path order. Counts per file come from the footers, their running sums tell
    which files hold the range, and only those are opened; within them only the first
    and the last need a look at row numbers. Nothing is sorted but file names.
    """
    table = spark.read.parquet(path)
    start = max(start, 0)
    if start == 0 and limit is None:
        return table
    files = table.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("rows"))
    placed = files.withColumn("end", F.sum("rows").over(W.orderBy("file"))).withColumn("begin", F.col("end") - F.col("rows"))
    inside = F.col("end") > start
    if limit is not None:
        inside = inside & (F.col("begin") < start + limit)
    ends = placed.filter(inside).orderBy("begin").select("file", "begin").collect()
    if not ends or limit == 0:
        return table.limit(0)
    # Paths of the metadata column are encoded as in addresses; readers take them plain.
    read = spark.read.schema(table.schema).option("basePath", path).parquet(*[unquote(r["file"]) for r in ends])
    file, row = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    first, last = ends[0], ends[-1]
    kept = (file != first["file"]) | (row >= start - first["begin"])
    if limit is not None:
        kept = kept & ((file != last["file"]) | (row < start + limit - last["begin"]))
    return read.filter(kept)


def _bytes(df: DataFrame, name: str) -> Column:
    c, dtype = column(name), type_of(df, name)
    if isinstance(dtype, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0))
    if isinstance(dtype, NESTED):
        return F.coalesce(F.octet_length(F.to_json(c)), F.lit(0))
    wide = (T.LongType, T.DoubleType, T.TimestampType, T.TimestampNTZType)
    narrow = {T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2}
    return F.lit(8 if isinstance(dtype, wide) else narrow.get(type(dtype), 4))


def split_metadata(df: DataFrame, split_col: str = "split") -> DataFrame:
    """(split, rows, cols, data_mb) per split."""
    names = [c for c in df.columns if c != split_col]
    size = F.lit(0).cast("bigint")
    for c in names:
        size = size + _bytes(df, c)
    return df.groupBy(column(split_col).alias("split")).agg(
        F.count("*").alias("rows"),
        F.lit(len(names)).cast("bigint").alias("cols"),
        F.round(F.sum(size) / 1e6, 2).alias("data_mb"),
    )


def primary_split(names: Sequence[str]) -> str:
    """The first split named like a training split, else the first."""
    return training_split(names) or names[0]
