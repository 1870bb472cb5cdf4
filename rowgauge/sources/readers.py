"""Table scans by file format."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import NA_VALUES
from ..functions.canonical import column
from ..functions.text import is_blank
from .manifest import file_format

# --- Fixed values: wrapper keys of a JSON document, first match wins ---------
WRAPPERS = ("data", "rows", "examples", "instances")
INTEGER = r"\A[+-]?[0-9]+\z"
NUMBER = r"\A[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"
MIXED_KINDS = "mixed_kinds"
BOOLEANS = ("True", "TRUE", "true", "False", "FALSE", "false")


def flatten_once(df: DataFrame) -> DataFrame:
    """Top-level structs become ``a.b`` columns, one level deep."""
    out = []
    for f in df.schema:
        if isinstance(f.dataType, T.StructType):
            out += [column(f.name)[k].alias(f"{f.name}.{k}") for k in f.dataType.names]
        else:
            out.append(column(f.name))
    return df.select(*out)


def _typed(df: DataFrame) -> DataFrame:
    """Whole, fractional and boolean columns told from text in one aggregate."""
    checks = []
    for i, name in enumerate(df.columns):
        c = column(name)
        checks += [
            F.count_if(~c.rlike(INTEGER) | c.try_cast("bigint").isNull()).alias(f"i{i}"),
            F.count_if(~c.rlike(NUMBER)).alias(f"d{i}"),
            F.count_if(~c.isin(*BOOLEANS)).alias(f"b{i}"),
            F.count(c).alias(f"n{i}"),
        ]
    seen = df.agg(*checks).first()
    out = []
    for i, name in enumerate(df.columns):
        not_int, not_num, not_bool, n = seen[4 * i : 4 * i + 4]
        to = None
        if n and not not_int:
            to = "bigint"
        elif n and not not_num:
            to = "double"
        elif n and not not_bool:
            to = "boolean"
        out.append(column(name).cast(to).alias(name) if to else column(name))
    return df.select(*out)


def delimited_options(sep: str = ",", multi_line: bool = False, mode: str = "FAILFAST") -> dict:
    """How delimited files are read, as a table or as a stream."""
    return {"header": True, "sep": sep, "quote": '"', "escape": '"', "multiLine": multi_line, "mode": mode}


def as_text(schema: T.StructType | str) -> tuple[T.StructType, T.StructType]:
    """(the schema, the same names as strings)."""
    typed = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return typed, T.StructType([T.StructField(f.name, T.StringType()) for f in typed])


def from_text(df: DataFrame, schema: T.StructType | None, na_values=NA_VALUES) -> DataFrame:
    """Cells that mean "missing" become null, the others the schema's types."""
    kinds = {f.name: f.dataType for f in schema} if schema is not None else {}
    cells = {c: F.when(~column(c).isin(*na_values), column(c)) for c in df.columns}
    return df.select(*[(v.cast(kinds[c]) if c in kinds else v).alias(c) for c, v in cells.items()])


def _has_broken_lines(spark: SparkSession, path: str) -> bool:
    """Some line holds an odd number of quotes, so a cell goes on in the next one."""
    quotes = F.regexp_count("value", F.lit('"'))
    return not spark.read.text(path).filter(quotes % 2 == 1).isEmpty()


def read_delimited(
    spark: SparkSession,
    path: str,
    sep: str = ",",
    schema=None,
    na_values=NA_VALUES,
    multi_line: bool | None = None,
    mode: str = "FAILFAST",
) -> DataFrame:
    """CSV or TSV with a header, gzip by extension.

    Large files are split, unless some quoted cell has a line break: then each
    file is one task. ``multi_line`` says so beforehand and saves the look.
    """
    if multi_line is None:
        multi_line = _has_broken_lines(spark, path)
    reader = spark.read.options(**delimited_options(sep, multi_line, mode))
    if schema is not None:
        typed, plain = as_text(schema)
        return from_text(reader.schema(plain).csv(path), typed, na_values)
    return _typed(from_text(reader.csv(path), None, na_values))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines; bytes that are no UTF-8 become replacement characters."""
    lines = spark.read.text(path).select(F.make_valid_utf8("value").alias("value"))
    return lines.filter(~is_blank(F.col("value")))


def _plain(dtype: T.DataType, path: str, mixed: set[str]) -> T.DataType:
    """Variants, which stand for several kinds of values, become strings; their paths are noted."""
    if isinstance(dtype, T.VariantType):
        mixed.add(path)
        return T.StringType()
    if isinstance(dtype, T.ArrayType):
        return T.ArrayType(_plain(dtype.elementType, path + "[]", mixed))
    if isinstance(dtype, T.StructType):
        lead = path + "." if path else ""
        return T.StructType([T.StructField(f.name, _plain(f.dataType, lead + f.name, mixed)) for f in dtype])
    return dtype


def _record_schema(lines: DataFrame) -> tuple[T.StructType, set[str]]:
    """The merged schema of all records, from one aggregate, and the keys with
    several kinds of values.

    Those become strings, as do keys without any value.
    """
    found = lines.agg(F.schema_of_variant_agg(F.parse_json("value"))).first()[0]
    if not found or not found.startswith("OBJECT"):
        return T.StructType([]), set()
    parts = re.split(r"(`(?:[^`]|``)*`)", found)  # quoted names stay as they are
    for k in range(0, len(parts), 2):
        part = re.sub(r"\bVOID\b(?!:)", "STRING", parts[k])
        part = re.sub(r"\bDECIMAL\(\d+,\s*0\)", "DECIMAL(38,0)", part)  # whole, too large for a long
        part = re.sub(r"\b(DECIMAL\(\d+,\s*[1-9]\d*\)|FLOAT\b(?!:))", "DOUBLE", part)
        parts[k] = re.sub(r"\bOBJECT(?=<)", "STRUCT", part)
    mixed: set[str] = set()
    return _plain(T.StructType.fromDDL("r " + "".join(parts))["r"].dataType, "", mixed), mixed


def is_mixed(field: T.StructField) -> bool:
    """The reader met several kinds of values in the column."""
    return bool((field.metadata or {}).get(MIXED_KINDS))


def read_jsonl(
    spark: SparkSession, path: str, schema=None, mode: str = "FAILFAST", flatten: bool = True
) -> DataFrame:
    """JSON lines. Columns keep the order of the first record; those with several
    kinds of values become strings and are marked for the check of types."""
    lines = _lines(spark, path)
    mixed: set[str] = set()
    if schema is None:
        schema, mixed = _record_schema(lines)
        first = lines.select(F.json_object_keys("value").alias("keys")).first()
        lead = [k for k in dict.fromkeys((first and first["keys"]) or []) if k in schema.names]
        names = lead + [c for c in schema.names if c not in lead]
        schema = T.StructType([schema[c] for c in names])
    df = lines.select(F.from_json("value", schema, {"mode": mode}).alias("r")).select("r.*")
    df = flatten_once(df) if flatten else df
    return df.select(*[
        column(c).alias(c, metadata={MIXED_KINDS: True}) if c in mixed else column(c) for c in df.columns
    ])


def read_json_document(
    spark: SparkSession, path: str, schema=None, mode: str = "FAILFAST", flatten: bool = True
) -> DataFrame:
    """JSON files that hold an array, one object, or an object around a list.

    A document cannot be split, so each file is one task.
    """
    reader = spark.read.options(multiLine=True, mode=mode)
    df = (reader.schema(schema) if schema is not None else reader).json(path)
    types = {f.name: f.dataType for f in df.schema}
    wrapper = next((w for w in WRAPPERS if isinstance(types.get(w), T.ArrayType)), None)
    if wrapper and isinstance(types[wrapper].elementType, T.StructType):
        df = df.select(F.inline(column(wrapper)))
    return flatten_once(df) if flatten else df


def read_variants(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines as one variant column ``v``, value kinds left as they are."""
    return _lines(spark, path).select(F.parse_json("value").alias("v"))


def read_table(spark: SparkSession, path: str, fmt: str | None = None, **options) -> DataFrame:
    """A table by its format, told by the extension unless named."""
    known = fmt or file_format(path)[0]
    if known == "csv":
        return read_delimited(spark, path, ",", **options)
    if known == "tsv":
        return read_delimited(spark, path, "\t", **options)
    if known == "parquet":
        return spark.read.parquet(path)
    if known == "jsonl":
        return read_jsonl(spark, path, **options)
    if known == "json":
        return read_json_document(spark, path, **options)
    raise ValueError(f"no known format for {path!r}; name one of csv, tsv, json, jsonl, parquet")


def load_splits(
    spark: SparkSession, paths: Mapping[str, str], fmt: str | None = None, **options
) -> dict[str, DataFrame]:
    """One table per split."""
    return {name: read_table(spark, path, fmt, **options) for name, path in paths.items()}


def union_splits(splits: Mapping[str, DataFrame], split_col: str = "split") -> DataFrame:
    """All splits as one table with a split column; absent columns are null."""
    out = None
    for name, df in splits.items():
        part = df.withColumn(split_col, F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
