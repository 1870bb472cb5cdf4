"""One comparable form for cells and rows of any type."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NESTED = (T.ArrayType, T.MapType, T.StructType, T.VariantType)
FLOATING = (T.FloatType, T.DoubleType)
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreNullFields": "false"}


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def column(name: str) -> Column:
    """A top-level column by its plain name, dots and all."""
    return F.col(quoted(name))


def type_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def clean(df: DataFrame, name: str) -> Column:
    """The column with NaN turned into null."""
    c = column(name)
    if isinstance(type_of(df, name), FLOATING):
        return F.when(~F.isnan(c), c)
    return c


def missing(df: DataFrame, name: str) -> Column:
    return clean(df, name).isNull()


def _with_sorted_maps(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.MapType):
        value = dtype.valueType
        entries = F.transform(
            F.map_entries(c),
            lambda e: F.struct(
                e["key"].alias("key"), _with_sorted_maps(e["value"], value).alias("value")
            ),
        )
        return F.array_sort(entries)
    if isinstance(dtype, T.ArrayType):
        return F.transform(c, lambda x: _with_sorted_maps(x, dtype.elementType))
    if isinstance(dtype, T.StructType):
        fields = [_with_sorted_maps(c[f.name], f.dataType).alias(f.name) for f in dtype]
        return F.when(c.isNotNull(), F.struct(*fields))
    return c


def _holds_map(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.MapType):
        return True
    if isinstance(dtype, T.ArrayType):
        return _holds_map(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return any(_holds_map(f.dataType) for f in dtype)
    return False


def canonical(df: DataFrame, name: str) -> Column:
    """The cell as text: equal text means equal cell; null means missing."""
    c, dtype = clean(df, name), type_of(df, name)
    if isinstance(dtype, T.VariantType):
        return F.to_json(c)
    if isinstance(dtype, NESTED):
        return F.to_json(_with_sorted_maps(c, dtype) if _holds_map(dtype) else c, _JSON)
    if isinstance(dtype, FLOATING):
        return (c + F.lit(0.0)).cast("string")  # -0.0 equals 0.0
    if isinstance(dtype, T.BinaryType):
        return F.hex(c)
    return c.cast("string")


def value_key(df: DataFrame, name: str, longest: int = 32) -> Column:
    """The canonical cell, or its 128-bit hash where that is shorter."""
    c = canonical(df, name)
    if isinstance(type_of(df, name), (T.StringType, T.BinaryType) + NESTED):
        return F.when(F.length(c) < longest, c).otherwise(F.md5(c))
    return c


def row_hash(df: DataFrame, names: Sequence[str]) -> Column:
    """128-bit key of whole rows; nulls equal nulls."""
    parts = []
    for name in names:
        c = canonical(df, name)
        parts.append(F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("~")))
    return F.md5(F.concat(*parts))


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [
        f.name
        for f in df.schema
        if isinstance(f.dataType, T.NumericType) and f.name not in exclude
    ]
