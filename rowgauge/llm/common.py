"""What the operators of this folder share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every word and line rule here: [\x20\x09-\x0D].
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands for a null id inside an operator, so that it sorts last and joins.
NO_ID = 2**63 - 1


_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """A new folder in spark.checkpoint.dir, which all executors share.

    A local session that names none gets one of its own; a cluster must name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own_folder:
            _own_folder.append("file://" + tempfile.mkdtemp(prefix="rowgauge-"))
        base = _own_folder[0]
    return os.path.join(base, "rowgauge-llm-" + uuid.uuid4().hex)


def written(df: DataFrame, partition_by: str | None = None, slim: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there, and it
    outlives any executor. It stays for as long as results may read it.

    slim: rows are a few numbers each, so twice as many tasks and files as there
    are cores are enough, however many partitions shuffles have.
    """
    path = shared_folder(df.sparkSession)
    if slim:
        df = df.coalesce(2 * df.sparkSession.sparkContext.defaultParallelism)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """df as written(), in a table bucketed by key: joins by it do not move the table.
    Its files are in the shared folder; in the catalog it has a name of its own."""
    spark = df.sparkSession
    name = "rowgauge_" + uuid.uuid4().hex
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, key).option("path", shared_folder(spark)).saveAsTable(name)
    return spark.table(name)


_shared: set[str] = set()


def share_code(spark: SparkSession) -> None:
    """Send this package to the executors, once an application, for functions that
    run in Python tasks. Nothing to do where it was not loaded from a folder: then
    it was sent along with the application."""
    context = spark.sparkContext
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if context.applicationId in _shared or not os.path.isdir(package):
        return
    name = os.path.basename(package)
    path = os.path.join(tempfile.mkdtemp(prefix="rowgauge-"), f"{name}.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, files in os.walk(package):
            for file in files:
                if file.endswith(".py"):
                    whole = os.path.join(folder, file)
                    archive.write(whole, os.path.join(name, os.path.relpath(whole, package)))
    context.addPyFile(path)
    _shared.add(context.applicationId)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else. Spark's lower() agrees with that on ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )


def words(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def lines(text: Column) -> Column:
    """The text cut at \\n; one empty line for null."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def whole_id(column: str | Column) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("long"), F.lit(NO_ID))


def join_counted(left: DataFrame, right: DataFrame, keys: list[str], n: str, parts: int = 1000) -> DataFrame:
    """left inner join right, where right has one row a key and in column n the
    number of left's rows with it.

    Keys that hold more than one in `parts` of left's rows are joined by
    broadcast; there are fewer than `parts` of them at any size. The others
    cannot fill a task and are joined by shuffle. Both frames should be cheap to
    read twice.
    """
    total = right.agg(F.sum(n)).first()[0] or 0
    hot = F.broadcast(right.filter(F.col(n) > total // parts).drop(n))
    cold = right.filter(F.col(n) <= total // parts).drop(n)
    rest = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return left.join(hot, keys).unionByName(rest.join(cold, keys))
