"""Row flags on planted positives and near-misses, against plain Python."""

import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rowgauge import config
from rowgauge.config import AuditConfig
from rowgauge.functions import safety, text
from rowgauge.operators import flags as flag_ops

CASES = [
    None, "", "   ", "\n\t", " 　", "\x1c\x1d", "plain text", " lead", "trail ",
    "a   b", "a \t b", "a  b", "a\n\n\n\nb", "a\n\n\nb",
    "<p>x</p>", "a < b > c", "</div>", "<" + "a" * 202 + ">", "<a" + "b" * 200 + ">", "< p>",
    "cafÃ©", "donâ€™t", "â€œquote", "bad � char", "Â x", "Âx", "café", "â€“ dash",
    "me@x.org", "éme@x.org", "me@x.o", "@x.org", "a.b+c@sub.x.org!", "me@x.org1", ".me@x.org",
    "call 555 1234", "555-123", "555-12", "+1 (212) 555-1234", "12 34 56",
    "123-45-6789", "1123-45-6789", "123-45-67890", "x123-45-6789", "é123-45-6789",
    "10.1.2.3", "999.999.999.999", "1.2.3", "1.2.3.4.5", "a1.2.3.4", "1.2.3.4567",
    "4111 1111 1111 1111", "4111-1111-1111-1112", "4111111111111111", "41111111111111111",
    "378282246310005", "1234 5678 9012 3456 4111 1111 1111 1111", "4111 1111 1111 1111 x",
    "Kill it", "skill", "kill", "kill_", "killé", "KILL MYSELF now", "self-harm", "selfharm", "bombs",
    "ab " * 3, "x y z " * 4, "the cat sat " * 40 + "on a mat", "a b c d e f g h i",
    "a b c a b c d e f", "one two three four five six seven eight nine ten",
]

WORD = re.compile(r"\w")


def py_flags(t):
    """The same answers with the standard library, for non-null text."""
    pii = {
        "email": r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b",
        "phone": r"(?:\+?\d{1,3}[\s.\-]?)?(?:\(\d{2,4}\)[\s.\-]?)?\d{3}[\s.\-]\d{3,4}[\s.\-]?\d{0,4}",
        "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
        "ipv4": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    }
    out = {
        "empty_or_whitespace": not t.strip(),
        "html_bleed": bool(re.search(r"</?[a-zA-Z][^>]{0,200}>", t)),
        "whitespace_anomalies": bool(re.search(r"[ \t]{3,}|\n{4,}", t)) or t != t.strip(),
    }
    out.update({f"pii_{k}": bool(re.search(p, t)) for k, p in pii.items()})
    out["pii_credit_card"] = any(
        luhn(m) for m in re.findall(r"\b(?:[0-9][ \-]?){13,16}\b", t)
    )
    for name, words in AuditConfig().keywords.items():
        pattern = r"\b(" + "|".join(map(re.escape, words)) + r")\b"
        out[f"toxicity_{name}"] = bool(re.search(pattern, t.lower()))
    out["repetitive"] = repeats(t)
    return out


def luhn(m):
    digits = [int(c) for c in m if c.isdigit()][::-1]
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0


def repeats(t):
    w = t.split()
    if len(w) < 9:
        return False
    grams = Counter(zip(w, w[1:], w[2:]))
    return max(grams.values()) / (len(w) - 2) > 0.3


def spark_flags(spark, texts):
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id int, text string")
    return {r["id"]: r.asDict() for r in flag_ops.row_flags(df, "text", ["id"]).collect()}


def test_planted_texts(spark):
    got = spark_flags(spark, CASES)
    for i, t in enumerate(CASES):
        if t is None:
            assert got[i]["empty_or_whitespace"] and not got[i]["pii_email"]
            assert not got[i]["repetitive"] and got[i]["tokens"] is None
            continue
        want = py_flags(t)
        assert {k: got[i][k] for k in want} == want, repr(t)


def test_encoding_artifacts(spark):
    bad = ["Ã©", "Ã¨", "Ã¶", "Ã¼", "â€™", "â€œ", "â€\u009d", "â€“", "Â ", "�"]
    good = ["Ã", "â€", "Â", "é", "Âx", "â€–"]
    got = spark_flags(spark, bad + good)
    flags = [got[i]["encoding_artifacts"] for i in range(len(bad + good))]
    assert flags == [True] * len(bad) + [False] * len(good)


@settings(max_examples=8, deadline=None)
@given(
    st.lists(
        st.text(alphabet="ab1.-@ \t\n <>/é_5", max_size=60), min_size=40, max_size=40
    )
)
def test_random_texts(spark, texts):
    got = spark_flags(spark, texts)
    for i, t in enumerate(texts):
        want = py_flags(t)
        assert {k: got[i][k] for k in want} == want, repr(t)


@settings(max_examples=6, deadline=None)
@given(
    st.lists(
        st.lists(st.sampled_from("abcd"), min_size=0, max_size=40), min_size=40, max_size=40
    )
)
def test_repetition_of_random_words(spark, rows):
    texts = [" ".join(r) for r in rows]
    got = spark_flags(spark, texts)
    for i, t in enumerate(texts):
        assert got[i]["repetitive"] == repeats(t), t


def test_normalise_tokens_opening(spark):
    df = spark.createDataFrame([(t,) for t in CASES if t is not None], "text string")
    got = df.select(
        "text",
        text.normalise(F.col("text")).alias("n"),
        text.token_estimate(F.col("text")).alias("k"),
        text.opening(F.col("text")).alias("o"),
    ).collect()
    for r in got:
        assert r.n == re.sub(r"\s+", " ", r.text).strip().lower()
        assert r.k == max(1, round(len(r.text) / 4))
        assert r.o == " ".join(r.text.split()[:8])


def test_lone_spaces_are_not_replaced(spark):
    """Runs that are one space already cost no replacement; every other run is one match."""
    texts = ["plain words only", " a", "a ", "a  b", "a \n b\u2003c", "x\x1f \u3000y z", "é à", "\u65e5 \u672c", " ", "", "a\x85 b \xa0"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    found = F.regexp_extract_all(F.col("text"), F.lit(config.WS_RUN), F.lit(0))
    for r in df.select("text", found.alias("runs"), text.normalise(F.col("text")).alias("n")).collect():
        runs = re.findall(r"\s+", r.text)
        assert set(runs) - {" "} <= set(r.runs) <= set(runs)
        assert r.n == re.sub(r"\s+", " ", r.text).strip().lower()
    lone = df.filter("text = 'plain words only'").select(F.size(found)).first()[0]
    assert lone == 0


def test_half_even_tokens(spark):
    df = spark.createDataFrame([("x" * n,) for n in range(0, 30)], "text string")
    got = df.select(F.length("text").alias("n"), text.token_estimate(F.col("text")).alias("k")).collect()
    assert all(r.k == max(1, round(r.n / 4)) for r in got)


def test_own_keywords(spark):
    df = spark.createDataFrame([("C++ code",), ("c+++",), ("abc++x",), ("c++x",), ("nothing",)], "text string")
    found = safety.keyword_flags(F.col("text"), {"lang": ["c++"]})
    got = [r.lang for r in df.select(found["lang"].alias("lang")).collect()]
    pattern = re.compile(r"\b(" + re.escape("c++") + r")\b")
    want = [bool(pattern.search(t.lower())) for t in ("C++ code", "c+++", "abc++x", "c++x", "nothing")]
    assert got == want


def test_evidence_and_rows(spark):
    rows = [(i, "" if i % 3 == 0 else "<b>x</b>") for i in range(100)]
    df = spark.createDataFrame(rows, "id long, text string").repartition(7)
    flagged = flag_ops.row_flags(df, "text", ["id"])
    proof = flag_ops.evidence(flagged, "id", ["empty_or_whitespace", "html_bleed", "pii_ssn"])
    got = {}
    for r in proof.orderBy("check", "position").collect():
        got.setdefault(r.check, []).append(r.row_id)
    assert got == {"empty_or_whitespace": [0, 3, 6, 9, 12], "html_bleed": [1, 2, 4, 5, 7]}
    full = flag_ops.flagged_rows(df, proof, "id")
    assert full.columns == ["id", "text", "check"] and full.count() == 10


def test_union_doubles_counts(spark):
    df = spark.createDataFrame([(t,) for t in CASES], "text string")
    once = {(r.flag): r.rows for r in flag_ops.flag_counts(df, ["text"]).collect()}
    twice = {(r.flag): r.rows for r in flag_ops.flag_counts(df.unionAll(df), ["text"]).collect()}
    assert twice == {k: 2 * v for k, v in once.items()}


@pytest.mark.parametrize("parts", [1, 5])
def test_quality_of_empty_table(spark, parts):
    df = spark.createDataFrame([], "text string").repartition(parts)
    row = flag_ops.text_quality(df, ["text"]).first()
    assert row["count"] == 0 and row.min_chars is None and row.html_bleed == 0
