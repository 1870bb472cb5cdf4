"""Redaction by ranges and exact class sizes, against plain Python."""

import random
import re
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rowgauge.functions import spans
from rowgauge.operators import repair

W = r"[^\W]"
B = rf"(?:(?<={W})(?!{W})|(?<!{W})(?={W}))"
KINDS = [
    (rf"{B}[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{{2,}}{B}", "[EMAIL]"),
    (rf"(?<!{W})\d{{3}}-\d{{2}}-\d{{4}}(?!{W})", "[SSN]"),
    (rf"(?<!{W})(?:\d{{1,3}}\.){{3}}\d{{1,3}}(?!{W})", "[IP]"),
    (rf"(?<!{W})(?:[0-9][ \-]?){{13,16}}{B}", "[CARD]"),
    (r"(?:\+?\d{1,3}[\s.\-]?)?(?:\(\d{2,4}\)[\s.\-]?)?\d{3}[\s.\-]\d{3,4}[\s.\-]?\d{0,4}", "[PHONE]"),
]


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n // 10 + n % 10
    return total % 10 == 0


def plain(text):
    """Letters of found ranges are blanked kind after kind, then all are replaced."""
    blanked, found = text, []
    for pattern, put in KINDS:
        for m in list(re.finditer(pattern, blanked)):
            start, end = m.span()
            if put == "[CARD]":
                if not luhn(re.sub("[^0-9]", "", m[0])):
                    continue
                end = start + len(m[0].rstrip(" -"))
            found.append((start, end, put))
            blanked = blanked[:start] + "\0" * (end - start) + blanked[end:]
    at, out = 0, ""
    for start, end, put in sorted(found):
        out += text[at:start] + put
        at = end
    return out + text[at:]


def test_redaction_against_plain_ranges(spark):
    rng = random.Random(9)
    bits = [
        "a.b@c.de", "x@y", "123-45-6789", "10.0.0.1", "1.2.3.4.5", "4111 1111 1111 1111", "4111-1111-1111-1111-", "94111111111111111", "4111111111111112",
        "5500005555555559", "555-123-4567", "+1 (743) 555-3824", "é", " ", " ", "-", ".", ",", "word", "日本", "﷐", "$0", "\\", "[CARD]", "1", "12",
    ]
    texts = ["".join(rng.choices(bits, k=rng.randint(1, 9))) for _ in range(600)]
    texts += ["", "nothing", "10.0.0.1 555-123-4567", "".join(spans.NO_CHARACTERS[:-1]) + " a@b.co", "a@b.co " * 700, "555-123-4567\n" * 300]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "id int, t string")
    got = {r["id"]: r["t"] for r in repair.redact(df, "t").collect()}
    assert got.pop(-1) is None
    assert [(t, got[i]) for i, t in enumerate(texts) if got[i] != plain(t)] == []
    assert all(not unicodedata.category(c).startswith("Cc") or c == "\n" for x in got.values() for c in x)


def test_running_sums(spark):
    rng = random.Random(1)
    rows = [[rng.randint(0, 9) for _ in range(n)] for n in (0, 1, 2, 255, 256, 257, 700)]
    df = spark.createDataFrame([(r,) for r in rows], "v array<int>")
    got = [r[0] for r in df.select(spans.running_sums(F.col("v"))).collect()]
    assert got == [[sum(r[:k]) for k in range(len(r))] for r in rows]


@pytest.mark.parametrize("ties", [False, True])
def test_classes_have_exactly_the_goal(spark, monkeypatch, ties):
    if ties:
        monkeypatch.setattr(repair, "_place", lambda row_id: F.lit(7).cast("long"))
    sizes = {"a": 5, "b": 12, "c": 31}
    rows = [(k, name) for k, name in enumerate([n for n, k in sizes.items() for _ in range(k)])] + [(100, None), (101, None)]
    df = spark.createDataFrame(rows, "id bigint, c string")
    for how, goal in (("under", 5), ("over", 31)):
        for small in (10, 100_000):
            got = repair.rebalance(df, "c", "id", how, small=small).collect()
            assert Counter(r["c"] for r in got) == {"a": goal, "b": goal, "c": goal, None: 2}
            times = Counter(r["id"] for r in got)
            for name, n in sizes.items():
                own = sorted(times[i] for i, c in rows if c == name)
                assert own[-1] - own[0] <= 1 and sum(own) == goal and len(own) == n
            if ties:
                assert [times[i] for i, c in rows if c == "b"] == ([1] * 5 + [0] * 7 if how == "under" else [3] * 7 + [2] * 5)
    assert repair.rebalance(df.limit(0), "c", "id", "over").count() == 0
