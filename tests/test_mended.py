"""Cases outside the given tables: values, names and sizes that were got wrong once."""

import json
import math

import pytest
from pyspark.sql import functions as F

from rowgauge import audit
from rowgauge.functions import order_stats, safety
from rowgauge.operators import chat, flags, leakage, numeric, profile, repair, summary
from rowgauge.sources import readers, sinks
from rowgauge.streaming.files import read_stream


def test_two_labels_in_one_register_are_two(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 950, 0).otherwise(561).alias("label"))
    row, = profile.class_balance(df).collect()
    assert (row["column"], row["verdict"], row["imbalance_ratio"]) == ("label", "severe_imbalance", 19.0)


@pytest.mark.parametrize("classes", [500, 3000])
def test_many_classes_rule_long_columns_out(spark, classes):
    from rowgauge.config import AuditConfig

    df = spark.range(20_000).select((F.col("id") % classes).alias("label"), F.col("id"), F.lit(1).alias("one"))
    texts, labels = profile.column_roles(df, AuditConfig(max_classes=classes))
    assert labels == ["label"]


def test_infinities(spark):
    rows = [(float(i), float(i * 2)) for i in range(30)] + [(math.inf, 1.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    found = {r["column"]: r for r in numeric.numeric_outliers(df).collect()}
    assert found["a"]["zscore_outliers"] == 0 and found["a"]["iqr_outliers"] == 1
    assert numeric.numeric_correlation(df).collect() == []


def test_whole_numbers_beyond_a_long(spark, tmp_path):
    path = tmp_path / "n.jsonl"
    path.write_text('{"n": 12345678901234567890}\n{"n": 12345678901234567891}\n')
    df = readers.read_jsonl(spark, str(path))
    assert sorted(int(r["n"]) for r in df.collect()) == [12345678901234567890, 12345678901234567891]


def test_missing_cells_with_a_schema_and_in_a_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text('id,name,x\n1,NA,1.5\n2,"a ""b"", c",\n3,n/a,NaN\n')
    schema = "id int, name string, x double"
    batch = readers.read_delimited(spark, str(folder), schema=schema)
    rows = sorted(map(tuple, batch.collect()))
    assert rows == [(1, None, 1.5), (2, 'a "b", c', None), (3, None, None)]
    stream = read_stream(spark, str(folder), "csv", schema, max_files=1)
    query = stream.writeStream.format("memory").queryName("mended").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("mended").collect())) == rows


def test_json_stream_has_the_rows_of_the_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.jsonl").write_bytes(b'{"id": 1, "m": {"t": "x\xff"}}\n\n{"id": 2, "m": {"t": "y"}}\n')
    schema = "id int, m struct<t: string>"
    stream = read_stream(spark, str(folder), "jsonl", schema, max_files=1)
    query = stream.writeStream.format("memory").queryName("mended_json").start()
    query.processAllAvailable()
    query.stop()
    from pyspark.sql import types as T

    batch = readers.read_jsonl(spark, str(folder), T.StructType.fromDDL(schema))
    assert stream.columns == batch.columns == ["id", "m.t"]
    assert sorted(map(tuple, spark.table("mended_json").collect())) == sorted(map(tuple, batch.collect()))


def test_cells_with_line_breaks_are_noticed(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n1,"x\ny"\n')
    (tmp_path / "b.csv").write_text('a,b\n1,"x ""y"""\n')
    assert readers.read_delimited(spark, str(tmp_path / "a.csv")).collect() == [(1, "x\ny")]
    assert readers._has_broken_lines(spark, str(tmp_path / "a.csv"))
    assert not readers._has_broken_lines(spark, str(tmp_path / "b.csv"))


def test_dotted_names(spark):
    df = spark.createDataFrame([(i, f"a text that is long enough {i}", float(i)) for i in range(12)], "`m.id` int, `m.t` string, `m.x` double")
    assert summary.column_summary(df, ["m.t"]).count() == 1
    assert numeric.numeric_outliers(df, "m.id", ["m.x"]).count() == 1
    assert repair.dedup_near(df, "m.t", "m.id").count() == 12


def test_thousands_of_keywords(spark):
    words = [f"word{i}" for i in range(5000)] + ["self-harm", "kill myself", "c++"]
    df = spark.createDataFrame([("a word4999 here",), ("word49999",), ("Self-Harm!",), ("c++x",), ("c++ x",), (None,), ("",)], "t string")
    flag = safety.keyword_flags(F.col("t"), {"k": words})["k"]
    assert [r[0] for r in df.select(flag).collect()] == [True, False, True, True, False, None, False]


def test_unproven_intervals_are_widened(spark, monkeypatch):
    """A sketch that always proposes too narrow an interval, and too high."""
    real, asked, ranked = order_stats._guesses, [], []

    def narrow(df, columns, brackets, accuracy):
        asked.append([b.room for b in brackets])
        found = real(df, columns, brackets, accuracy)
        return [(high, high) if b.room < 20 else (low, high) for b, (low, high) in zip(brackets, found)]

    inside = order_stats._rank_inside
    monkeypatch.setattr(order_stats, "_guesses", narrow)
    monkeypatch.setattr(order_stats, "_rank_inside", lambda df, c, b: ranked.extend(x.strict for x in b) or inside(df, c, b))
    df = spark.range(20_000).select((F.col("id") * 7919 % 20_011).alias("v"))
    values = sorted(i * 7919 % 20_011 for i in range(20_000))
    found = order_stats.order_statistics(df, {"v": F.col("v")}, {"v": [5000, 5001]}, small=50, accuracy=200)
    assert [found["v", r] for r in (5000, 5001)] == values[5000:5002]
    assert max(map(max, asked)) >= 20 and max(ranked, default=0) <= 50


def test_a_report_written_twice_is_there_once(spark, tmp_path):
    df = spark.createDataFrame([(i, f"some text of a fair length {i % 3}") for i in range(9)], "id int, text string")
    report = audit(df, "id", link="https://github.com/o/r/blob/main/x.csv")
    for name in ("a", "b", "a"):
        sinks.write_report(report, str(tmp_path / "out"), name)
    stored = spark.read.parquet(str(tmp_path / "out" / "checks")).groupBy("audit_id").count().collect()
    assert {r["audit_id"]: r["count"] for r in stored} == dict.fromkeys("ab", report.checks.count())
    source = json.loads(sinks.report_to_json(report))["source"]
    assert source == {"type": "github", "resolved_url": "https://raw.githubusercontent.com/o/r/main/x.csv", "format": "csv"}


def test_mixed_kinds_fail_the_normal_audit(spark, tmp_path):
    path = tmp_path / "m.jsonl"
    path.write_text('{"k": 1, "o": {"p": 1}, "n": 1}\n{"k": "x", "o": {"p": true}, "n": 1.5}\n')
    checks = {r["name"]: r for r in audit(readers.load_splits(spark, {"train": str(path)})).checks.collect()}
    found = checks["Dtype consistency"]
    assert found["status"] == "FAIL" and found["affected_rows"] == 2 and found["detail"].endswith("k, o.p")


def test_evidence_without_an_id(spark):
    df = spark.createDataFrame([("fine and long enough to be text",), ("<p>tag and some more of it</p>",)], "text string").coalesce(1)
    report = audit(df)
    assert [(r["check"], r["row_id"]) for r in report.evidence.collect()] == [("text/html_bleed", 1)]


def test_turns_without_conversation_and_turns_repeated(spark):
    rows = [(None, 1, "user", "a"), (None, 1, "user", " "), (1, 1, "user", "a"), (1, 2, "assistant", "b"), (1, 2, "assistant", "c"), (2, 1, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    found = {r["conv_id"]: (r["broken_ordering"], r["empty_turn"]) for r in chat.long_turn_flags(df).collect()}
    assert found == {None: (None, True), 1: (True, False), 2: (False, False)}
    assert chat.long_turn_flags(df.limit(0)).count() == 0


def test_leakage_reads_other_splits_once(spark, tmp_path):
    rows = [(i, f"a text long enough to be one {i % 7}", ["train", "x", "y", "z"][i % 4]) for i in range(40)]
    spark.createDataFrame(rows, "id int, text string, split string").write.parquet(str(tmp_path / "t"))
    report = audit(spark.read.parquet(str(tmp_path / "t")), "id")
    assert {r["split"] for r in report.leakage.collect()} == {"x", "y", "z"}


def test_repairs_of_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, ""), (4, "A  b"), (5, " a b "), (6, "c <b>d</b>")], "id int, t string")
    ids = lambda x: sorted(r["id"] for r in x.collect())
    assert ids(repair.dedup_near(df, "t", "id")) == [1, 2, 3, 4, 6]
    assert ids(repair.dedup_exact(df, "id")) == [1, 3, 4, 5, 6]
    assert ids(repair.drop_empty(df, "t")) == [4, 5, 6]
    assert ids(repair.within_budget(df, "t")) == [1, 2, 3, 4, 5, 6]
    assert df.filter("id = 6").select(repair.strip_tags(F.col("t"))).first()[0] == "c  d "
    text = "mail a.b@c.de or +1 (743) 555-3824, 10.0.0.1, 123-45-6789, 4111 1111 1111 1111, 4111 1111 1111 1112"
    out = repair.redact(spark.createDataFrame([(text,)], "t string"), "t").first()[0]
    assert out.startswith("mail [EMAIL] or [PHONE], [IP], [SSN], [CARD], ") and "1111 1111 1111 1111" not in out
    split = df.withColumn("split", F.when(F.col("id") < 5, "train"))
    assert ids(repair.drop_leaked(split.withColumn("split", F.coalesce("split", F.lit("test"))), "t", ["train", "test"])) == [1, 2, 3, 4, 6]
    with pytest.raises(ValueError):
        repair.to_chat(df)
    with pytest.raises(ValueError):
        repair.rebalance(spark.range(60).withColumn("c", F.col("id")), "c", "id", "under")


def test_flag_counts_of_chosen_flags(spark):
    df = spark.createDataFrame([("a@b.de",), ("x",)], "t string")
    assert [tuple(r) for r in flags.flag_counts(df, ["t"], flags=["pii_email"]).collect()] == [("t", "pii_email", 1)]
    assert leakage.training_split(["a"]) is None
