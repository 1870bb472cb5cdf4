"""Row flags over files as they arrive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import DEFAULT, AuditConfig
from ..functions.text import is_blank
from ..operators.flags import flag_counts
from ..sources import readers

SEPARATORS = {"csv": ",", "tsv": "\t"}


def read_stream(
    spark: SparkSession, path: str, fmt: str, schema, max_files: int, flatten: bool = True
) -> DataFrame:
    """A stream of files with the rows that the batch readers give, ``max_files`` a step.

    Row flags are stateless, so ``row_flags`` and every expression under it run
    on the result as they do on a table.
    """
    stream = spark.readStream.option("maxFilesPerTrigger", max_files)
    typed, plain = readers.as_text(schema)
    if fmt in SEPARATORS:
        lines = stream.options(**readers.delimited_options(SEPARATORS[fmt])).schema(plain).csv(path)
        return readers.from_text(lines, typed)
    if fmt == "jsonl":
        value = F.make_valid_utf8("value")
        lines = stream.text(path).select(value.alias("value")).filter(~is_blank(F.col("value")))
        df = lines.select(F.from_json("value", typed, {"mode": "FAILFAST"}).alias("r")).select("r.*")
        return readers.flatten_once(df) if flatten else df
    return stream.schema(typed).format(fmt).load(path)


def count_stream(stream: DataFrame, text_cols: Sequence[str], path: str, checkpoint: str, cfg: AuditConfig = DEFAULT) -> StreamingQuery:
    """Counts flags of all files there are now, then stops; run again for new files.

    Every batch writes its counts as a partition of its own number and replaces what
    stood there, so a batch that runs again after a failure counts once. The
    checkpoint knows which files were counted.
    """

    def count(batch: DataFrame, number: int) -> None:
        flag_counts(batch, text_cols, cfg).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.foreachBatch(count).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def counted(spark: SparkSession, path: str) -> DataFrame:
    """(column, flag, rows) over all batches so far."""
    parts = spark.read.schema("column string, flag string, rows bigint, batch bigint").parquet(path)
    return parts.groupBy("column", "flag").agg(F.sum("rows").alias("rows"))
