"""Line deduplication over levelled sorted runs of line hashes.

Documents come in batches of rising ids. A batch's line hashes are merged
against the runs of all batches before it; hashes that no run holds become a
run of their own. Once a level holds `fanout` runs, they are compacted into one
run of the next level, so that a batch meets few runs however many came before.
Runs are tables bucketed and sorted by hash: merging them moves only the batch.

Results in odd cases
--------------------
- A null or empty text is one empty line; keys under `min_chars` never drop.
- Rows that repeat an id are parts of one document: a key in several of them is
  held by one document, and the rows share its fate.
- Rows without an id are one document that comes after all others.
- Extra columns are kept; the operator's own columns replace those of their name.
- An empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowgauge.llm import common

HASH = ["_h1", "_h2"]


def line_key(line: Column) -> Column:
    return common.ascii_lower(F.trim(line, F.lit(common.SPACE)))


class Runs:
    """Levels of runs, each run a table bucketed and sorted by line hash."""

    def __init__(self, spark, fanout: int = 2):
        self.spark, self.fanout, self.levels = spark, fanout, [[]]
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _write(self, hashes: DataFrame) -> str:
        name = "line_run_" + uuid.uuid4().hex
        (
            hashes.select(*HASH)
            .repartition(self.buckets, *HASH)
            .write.bucketBy(self.buckets, *HASH)
            .sortBy(*HASH)
            .option("path", common.shared_folder(self.spark))
            .saveAsTable(name)
        )
        return name

    def compact(self) -> None:
        level = 0
        while level < len(self.levels):
            runs = self.levels[level]
            if len(runs) >= self.fanout:
                merged = self.spark.table(runs[0])
                for run in runs[1:]:
                    merged = merged.unionAll(self.spark.table(run))
                if level + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[level + 1].append(self._write(merged))
                self._forget(runs)
                self.levels[level] = []
            level += 1

    def mark(self, hashes: DataFrame) -> DataFrame:
        """hashes with a column _seen: some run holds the hash."""
        marked, seen = hashes, F.lit(False)
        for i, run in enumerate(r for level in self.levels for r in level):
            marked = marked.join(self.spark.table(run).withColumn(f"_in{i}", F.lit(True)), HASH, "left")
            seen = seen | F.coalesce(F.col(f"_in{i}"), F.lit(False))
        return marked.select(*hashes.columns, seen.alias("_seen"))

    def add(self, hashes: DataFrame) -> None:
        self.levels[0].append(self._write(hashes))

    def _forget(self, runs: list[str]) -> None:
        for run in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {run}")

    def close(self) -> None:
        for runs in self.levels:
            self._forget(runs)


def repeated_lines(
    df: DataFrame, id_col: str, text_col: str, min_chars: int, batches: int, fanout: int
) -> DataFrame:
    """_id, _text_hash and the positions _drop of lines held by an earlier document."""
    spark = df.sparkSession
    line = (
        df.select(common.whole_id(id_col).alias("_id"), F.col(text_col).alias("_text"))
        .select("_id", F.xxhash64("_text").alias("_text_hash"), F.posexplode(common.lines(F.col("_text"))).alias("_pos", "_line"))
        .withColumn("_key", line_key(F.col("_line")))
        .filter(F.length("_key") >= min_chars)
    )
    cuts = df.select(common.whole_id(id_col).alias("_id")).agg(
        F.percentile_approx("_id", [i / batches for i in range(1, batches)], 1000).alias("cuts")
    ).first()["cuts"] if batches > 1 else []
    batch = F.lit(0)
    for cut in sorted(set(cuts or [])):
        batch = batch + (F.col("_id") > cut).cast("int")
    found = common.written(
        line.select(
            "_id", "_text_hash", "_pos",
            F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit(1), "_key").alias("_h2"), batch.alias("_batch"),
        ),
        partition_by="_batch",
    )
    runs = Runs(spark, fanout)
    drops = None
    n = len(set(cuts or [])) + 1
    for b in range(n):
        runs.compact()
        own = found.filter(F.col("_batch") == b).drop("_batch")
        keys = own.groupBy(*HASH).agg(
            F.min("_id").alias("_first"), F.max("_id").alias("_last"), F.count(F.lit(1)).alias("_n")
        )
        judged = common.written(runs.mark(keys))
        if b < n - 1:
            runs.add(judged.filter(~F.col("_seen")))
        owner = F.when(~F.col("_seen"), F.col("_first"))
        twice = judged.filter(F.col("_seen") | (F.col("_first") < F.col("_last"))).select(
            *HASH, owner.alias("_owner"), "_n"
        )
        dropped = common.join_counted(own, twice, HASH, "_n").filter(
            F.col("_owner").isNull() | (F.col("_id") != F.col("_owner"))
        ).select("_id", "_text_hash", "_pos")
        drops = dropped if drops is None else drops.unionAll(dropped)
    found = common.written(drops)
    runs.close()
    return found.groupBy("_id", "_text_hash").agg(F.collect_set("_pos").alias("_drop"))


def dedup_lines(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    min_chars: int = 10, batches: int = 4, fanout: int = 2,
) -> DataFrame:
    """Every row of df, its text without the lines that an earlier document holds.

    A line's key is the line without white space at its ends, A-Z lower-cased.
    Keys of `min_chars` or more code points stay only in the smallest id that
    holds them. Adds n_lines (before) and n_dropped.
    """
    columns = [c for c in df.columns if c not in ("n_lines", "n_dropped")]
    drops = repeated_lines(df, id_col, text_col, min_chars, batches, fanout)
    rows = (
        df.select(*columns, common.whole_id(id_col).alias("_id"), F.xxhash64(text_col).alias("_text_hash"))
        .join(drops, ["_id", "_text_hash"], "left")
        .withColumn("_lines", common.lines(F.col(text_col)))
    )
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_drop"))
    kept = F.when(F.col("_drop").isNull(), F.coalesce(F.col(text_col), F.lit(""))).otherwise(
        F.array_join(F.transform(F.col("_stay"), lambda p: F.get(F.col("_lines"), p)), "\n")
    )
    rows = rows.withColumn("_stay", F.when(F.col("_drop").isNotNull(), stay))
    return rows.select(
        *[kept.alias(c) if c == text_col else F.col(c) for c in columns],
        F.size("_lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("_drop"), F.lit(0)).cast("long").alias("n_dropped"),
    )
