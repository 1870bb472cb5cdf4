"""Scans, ranges, splits and sinks."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from rowgauge import AuditConfig, audit
from rowgauge.operators.flags import row_flags
from rowgauge.operators.types import dtype_consistency
from rowgauge.plans.checks import callout, issues
from rowgauge.plans.score import gate
from rowgauge.sources import manifest, ranges, readers, sinks
from rowgauge.streaming.files import read_stream


def test_csv(spark, tmp_path):
    path = tmp_path / "t.csv.gz"
    body = 'id,name,score,ok,mixed\n1,"a, ""b""\nc",1.5,True,7\n2,NA,,False,x\n3,null,2e3,True,\n'
    path.write_bytes(gzip.compress(body.encode()))
    df = readers.read_table(spark, str(path))
    assert dict(df.dtypes) == {"id": "bigint", "name": "string", "score": "double", "ok": "boolean", "mixed": "string"}
    assert [tuple(r) for r in df.collect()] == [
        (1, 'a, "b"\nc', 1.5, True, "7"), (2, None, None, False, "x"), (3, None, 2000.0, True, None),
    ]


def test_tsv(spark, tmp_path):
    path = tmp_path / "t.tsv"
    path.write_text("a\tb\n1\tx\n2\tn/a\n")
    assert [tuple(r) for r in readers.read_table(spark, str(path)).collect()] == [(1, "x"), (2, None)]


def test_jsonl(spark, tmp_path):
    path = tmp_path / "t.jsonl"
    path.write_bytes(b'{"z": 1, "a": {"y": 2, "x": {"w": 1}}}\n\n{"z": 2, "a": {"y": 3}, "b": "caf\xc3\xa9"}\n')
    df = readers.read_table(spark, str(path))
    assert df.columns == ["z", "a.x", "a.y", "b"]
    assert [r["z"] for r in df.collect()] == [1, 2] and df.filter(F.col("b") == "café").count() == 1


def test_jsonl_bad_bytes_and_bad_json(spark, tmp_path):
    path = tmp_path / "bytes.jsonl"
    path.write_bytes(b'{"a": "x\xffy"}\n')
    assert readers.read_table(spark, str(path)).first()["a"] == "x�y"
    path = tmp_path / "bad.jsonl"
    path.write_text('{"a": 1}\n{"a": \n')
    with pytest.raises(Exception):
        readers.read_table(spark, str(path)).collect()


@pytest.mark.parametrize(
    "doc", [[{"a": 1}, {"a": 2}], {"data": [{"a": 1}, {"a": 2}], "n": 2}, {"rows": [{"a": 1}, {"a": 2}]}]
)
def test_json_document(spark, tmp_path, doc):
    path = tmp_path / "t.json"
    path.write_text(json.dumps(doc, indent=1))
    assert sorted(r[0] for r in readers.read_table(spark, str(path)).collect()) == [1, 2]


def test_json_single_object_gz(spark, tmp_path):
    path = tmp_path / "t.json.gz"
    path.write_bytes(gzip.compress(b'{"a": 1,\n "b": {"c": 2}}'))
    assert readers.read_table(spark, str(path)).first().asDict() == {"a": 1, "b.c": 2}


def test_variants(spark, tmp_path):
    path = tmp_path / "t.jsonl"
    path.write_text('{"a": 1}\n{"a": "s"}\n')
    assert dtype_consistency(readers.read_variants(spark, str(path))).first()["observed_types"] == ["int", "str"]


def test_unknown_format(spark):
    with pytest.raises(ValueError):
        readers.read_table(spark, "/data/file.bin")


def test_file_format():
    assert manifest.file_format("s3://b/X.JSONL.GZ") == ("jsonl", "gzip")
    assert manifest.file_format("a.parquet") == ("parquet", "none")
    assert manifest.file_format("a.gz") == ("unknown", "gzip")


@pytest.mark.parametrize("small,accuracy", [(3, 10), (100_000, 10_000)])
def test_row_range(spark, small, accuracy):
    ids = [i * i for i in range(100)]
    df = spark.createDataFrame([(i, "a" if k % 4 else "b") for k, i in enumerate(ids)], "id long, split string").repartition(5)
    def kept(*args, split=None):
        return sorted(r.id for r in ranges.row_range(df, "id", *args, split, small=small, accuracy=accuracy).collect())
    assert kept(10, 20) == ids[10:30]
    assert kept(0, 5) == ids[:5] and kept(90, 50) == ids[90:] and kept(200, 5) == []
    assert kept(7, None) == ids[7:] and kept(0, None) == ids
    a = [i for k, i in enumerate(ids) if k % 4]
    b = [i for k, i in enumerate(ids) if not k % 4]
    assert kept(20, 10, split="split") == sorted(a[20:30] + b[20:30])


def test_row_range_is_a_scan_filter(spark, tmp_path):
    spark.range(1000).write.parquet(str(tmp_path / "t"))
    df = ranges.row_range(spark.read.parquet(str(tmp_path / "t")), "id", 100, 50)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(id), GreaterThanOrEqual(id,100), LessThan(id,150)]" in plan
    assert "Exchange" not in plan and df.count() == 50


def test_splits(spark):
    parts = {"test": spark.createDataFrame([("x",)], "text string"), "Train_a": spark.createDataFrame([("xyz", 1)], "text string, n int")}
    whole = readers.union_splits(parts)
    meta = {r.split: (r.rows, r.cols) for r in ranges.split_metadata(whole).collect()}
    assert meta == {"test": (1, 2), "Train_a": (1, 2)}
    assert ranges.primary_split(list(parts)) == "Train_a" and ranges.primary_split(["b", "a"]) == "b"


@pytest.fixture(scope="module")
def report(spark):
    train = [(i, f"A clean sentence number {i}.") for i in range(30)] + [(90, "Write to me@x.org, 123-45-6789")]
    test = [(100, "a  CLEAN sentence number 3."), (101, "unseen text in the test split")]
    parts = {
        "train": spark.createDataFrame(train, "id long, text string"),
        "test": spark.createDataFrame(test, "id long, text string"),
    }
    return audit(parts, "id")


def test_audit_of_splits(report):
    by_name = {r["check"]: r for r in report.checks.collect()}
    assert report.primary_split == "train"
    assert by_name["leakage"].affected_rows == 1 and by_name["leakage"].severity == "CRITICAL"
    assert by_name["pii"].affected_rows == 2 and by_name["pii"].example_rows == ["90"]
    assert by_name["pii"].detail.startswith("2 PII hits; most common: email (1 rows).")
    assert [r.severity for r in issues(report.checks).collect()] == ["CRITICAL", "CRITICAL"]
    assert callout(report.checks).count() == 2
    g = gate(report.overall).first()
    assert not g.passed and g.reason == "critical check failed"


def test_report_sinks(spark, report, tmp_path):
    sinks.write_report(report, str(tmp_path / "r"), "one")
    sinks.write_report(report, str(tmp_path / "r"), "two")
    back = spark.read.parquet(str(tmp_path / "r" / "checks"))
    assert back.count() == 2 * report.checks.count() and set(back.select("audit_id").distinct().toPandas()["audit_id"]) == {"one", "two"}
    payload = json.loads(sinks.report_to_json(report))
    assert payload["leakage"]["by_split"]["test"]["leaked_rows"] == 1
    assert payload["scorecard"]["counts"]["critical"] == 2 and len(payload["tests"]) == report.checks.count()


def test_all_text_columns_and_extras(spark):
    df = spark.createDataFrame([("a plain long question?", "<p>an answer</p> to me@x.org")] * 3, "q string, a string")
    cfg = AuditConfig(
        all_text_columns=True,
        extra_flags={"has_q": lambda c: c.contains("?")},
        extra_checks=[
            lambda d: d.agg(
                F.lit("COVERAGE").alias("category"), F.lit("Row count").alias("name"), F.lit("WARN").alias("status"),
                F.count("*").alias("affected_rows"), F.lit("LOW").alias("severity"), F.lit("few rows").alias("detail"),
            )
        ],
    )
    checks = audit(df, cfg=cfg).checks.collect()
    names = {r.name: r.status for r in checks}
    assert names["HTML/XML bleed (a)"] == "WARN" and names["HTML/XML bleed (q)"] == "PASS"
    assert names["PII presence (a)"] == "FAIL" and names["Row count"] == "WARN"


def test_generic_format_warns(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    found = {r["check"]: r.status for r in audit(df).checks.collect()}
    assert found["format"] == "WARN"
    found = {r["check"]: r.status for r in audit(df, cfg=AuditConfig(generic_format_warns=False)).checks.collect()}
    assert found["format"] == "PASS"


def test_empty_table(spark):
    report = audit(spark.createDataFrame([], "text string, n int"))
    assert report.overall.first().fail == 0 and report.text_columns == []


def test_flags_on_a_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for i in range(3):
        (src / f"{i}.jsonl").write_text(json.dumps({"id": i, "text": "me@x.org" if i else "clean"}) + "\n")
    stream = read_stream(spark, str(src), "jsonl", "id long, text string", max_files=1)
    query = (
        row_flags(stream, "text", ["id"]).select("id", "pii_email").writeStream.format("parquet")
        .option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    got = {r.id: r.pii_email for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {0: False, 1: True, 2: True}
