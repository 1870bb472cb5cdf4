"""The six-row example dataset and its published result."""

import json

import pytest

from rowgauge import audit
from rowgauge.sources.readers import read_jsonl

# --- Fixed values: the example rows and the results stated for them ----------
ROWS = [
    ("Explain dataset splitting.", "", "Keep training and evaluation examples in separate splits to reduce leakage."),
    ("Explain dataset splitting.", "", "Keep training and evaluation examples in separate splits to reduce leakage."),
    ("Explain deduplication.", "", "Deduplication removes repeated examples from a dataset."),
    ("Summarize the reference.", "", "<p>This synthetic record intentionally contains HTML markup.</p>"),
    ("Explain evaluation.", "", ""),
    ("Describe a synthetic contact field.", "", "Contact demo@example.com. This reserved example address tests the approximate PII detector."),
]

EXPECTED = [
    ("SCHEMA", "Columns present", "PASS", 0, "INFO", "3 columns detected: instruction, input, output"),
    ("SCHEMA", "Dtype consistency", "PASS", 0, "INFO", "No mixed-type object columns detected."),
    ("INTEGRITY", "Exact duplicate rows", "FAIL", 1, "HIGH", "1 exact duplicate rows (16.67%)."),
    ("INTEGRITY", "Near-duplicate text (instruction)", "WARN", 1, "MEDIUM", "1 rows duplicate after whitespace/case normalisation (16.67%)."),
    ("QUALITY", "Empty/whitespace text (instruction)", "PASS", 0, "INFO", "0 rows are empty or whitespace-only."),
    ("QUALITY", "HTML/XML bleed (instruction)", "PASS", 0, "INFO", "0 rows contain HTML/XML tags."),
    ("QUALITY", "Encoding artifacts (instruction)", "PASS", 0, "INFO", "0 rows show mojibake / replacement chars."),
    ("QUALITY", "Token budget (instruction)", "PASS", 0, "INFO", "Max sample is 9 tokens (p99=8.9). Confirm this fits your context window."),
    ("FORMAT", "Instruction format", "PASS", 0, "INFO", "Detected format(s): alpaca"),
    ("SAFETY", "PII presence (instruction)", "PASS", 0, "INFO", "No PII patterns matched."),
    ("SAFETY", "Toxicity surface flags (instruction)", "PASS", 0, "INFO", "No keyword surface hits (does not prove the data is clean)."),
    ("CONSISTENCY", "Empty responses", "FAIL", 1, "HIGH", "1 rows have an empty/near-empty output."),
    ("CONSISTENCY", "Instruction/response length ratio", "PASS", 0, "INFO", "0 rows have a response <10% the instruction length."),
    ("COVERAGE", "Lexical diversity (instruction)", "PASS", 0, "INFO", "Type-token ratio = 0.7222 over 18 tokens. Very low TTR can signal templated/repetitive data."),
    ("COVERAGE", "Class balance", "PASS", 0, "INFO", "No severe class imbalance detected."),
]


@pytest.fixture(scope="module")
def report(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("golden") / "sample.jsonl"
    path.write_text(
        "\n".join(json.dumps(dict(zip(("instruction", "input", "output"), r))) for r in ROWS) + "\n"
    )
    return audit(read_jsonl(spark, str(path)), link=str(path))


def test_checks(report):
    got = report.checks.orderBy("position").collect()
    assert [tuple(r[2:8]) for r in got] == EXPECTED


def test_score(report):
    o = report.overall.first()
    assert (o.overall, o.overall_rating) == (85.0, "Good")
    assert (o.fail, o.warn, o["pass"], o.critical, o.high) == (2, 1, 12, 0, 2)
    dims = {r.dimension: (r.score, r.rating) for r in report.dimensions.collect()}
    assert dims == {
        "Completeness": (62.5, "Needs Work"),
        "Quality": (70.0, "Needs Work"),
        "Format": (100.0, "Excellent"),
        "Safety": (100.0, "Excellent"),
        "Diversity": (100.0, "Excellent"),
    }


def test_leakage_not_checked(report):
    assert report.leakage is None
    assert report.leakage_reason == "Need >=2 splits and a text column."


def test_analysis_runs(report):
    for name, table in report.analysis.items():
        assert table.columns, name
        table.collect()
