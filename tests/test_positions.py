"""Rows by their place in files: the right ones, from no more files than hold them."""

import pytest

from rowgauge.sources import ranges


@pytest.fixture
def folder(spark, tmp_path):
    path = str(tmp_path / "a table %20é")
    spark.range(100).selectExpr("CAST(id AS STRING) AS name", "id % 3 AS part").repartitionByRange(9, "part", "name").write.parquet(path)
    return path


def in_order(spark, path):
    rows = spark.read.parquet(path).selectExpr("name", "_metadata.file_path AS f", "_metadata.row_index AS r").collect()
    return [x["name"] for x in sorted(rows, key=lambda x: (x["f"], x["r"]))]


@pytest.mark.parametrize("start, limit", [(0, 5), (3, 40), (95, 50), (0, 0), (100, 3), (500, None), (37, None), (0, None), (-4, 2), (11, 1), (0, 100)])
def test_ranges(spark, folder, start, limit):
    names = in_order(spark, folder)
    got = ranges.rows_by_position(spark, folder, start, limit)
    begin = max(start, 0)
    assert got.columns == ["name", "part"]
    assert sorted(r["name"] for r in got.collect()) == sorted(names[begin : None if limit is None else begin + limit])


def test_other_files_are_left_out(spark, folder):
    whole = len(spark.read.parquet(folder).inputFiles())
    few = ranges.rows_by_position(spark, folder, 0, 5)
    assert whole > 4 and len(few.inputFiles()) == 1
    assert "SortExec" not in few._jdf.queryExecution().executedPlan().toString()


def test_partition_columns_stay(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(30).selectExpr("CAST(id AS STRING) AS name", "id % 3 AS part").repartition(2).write.partitionBy("part").parquet(path)
    got = ranges.rows_by_position(spark, path, 4, 20).collect()
    assert len(got) == 20 and all(int(r["name"]) % 3 == r["part"] for r in got)
