"""Near duplicates, decontamination and toxicity against plain Python and held-out rows."""

import random
import re
import zlib
from collections import Counter

import numpy as np

from rowgauge.llm import decontaminate, near_dup, toxicity
from tests.llm import brute


def near_rows():
    rng = random.Random(11)
    rows = brute.documents(seed=2, n=20)
    base = brute.prose(rng, 150)
    words = base.split()
    rows += [(500 + i, base, "s0") for i in range(30)]
    for i in range(60):  # copies of one text that resemble it more than each other
        w = list(words)
        for _ in range(1 + i % 4):
            w[rng.randrange(len(w))] = f"q{rng.randrange(10**6)}"
        rows.append((600 + i, " ".join(w), "s1"))
    step = list(words)
    for i in range(40):  # a chain: each a little further from the first
        step = list(step)
        step[(7 * i) % len(step)] = f"z{i}"
        rows.append((700 + i, " ".join(step), "s2"))
    shared = brute.prose(rng, 60)
    rows += [(800 + i, shared + " " + brute.prose(rng, rng.choice([20, 60])), "s3") for i in range(40)]
    rows += [(900 + i, "one two three four" if i % 2 else "One two three four five", "s") for i in range(4)]
    return rows


def test_near_duplicates(spark):
    rows = near_rows()
    for percent in (80, 85):
        got = near_dup.near_duplicates(brute.frame(spark, rows), percent=percent).collect()
        assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == Counter(brute.groups(rows, percent))
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_drop_near_duplicates_keeps_one_of_each(spark):
    rows = [r for r in near_rows() if r[0] is not None and r[0] not in (303, 307)]
    kept = near_dup.drop_near_duplicates(brute.frame(spark, rows), percent=80)
    assert kept.columns == brute.frame(spark, rows).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, _, c in brute.groups(rows, 80) if i == c)


def test_bands_find_and_sketches_keep_pairs_at_the_threshold():
    rng = np.random.default_rng(3)
    multipliers, found, passed = near_dup._multipliers(), 0, 0
    for _ in range(400):
        both = rng.integers(0, 2**63, 400, dtype=np.uint64)
        a, b = np.concatenate([both, rng.integers(0, 2**63, 50, dtype=np.uint64)]), np.concatenate([both, rng.integers(0, 2**63, 50, dtype=np.uint64)])
        x, y = near_dup.samples(a, multipliers), near_dup.samples(b, multipliers)
        found += bool((near_dup.bands(x) == near_dup.bands(y)).any())
        differ = np.unpackbits((near_dup.odd_sketch(x) ^ near_dup.odd_sketch(y)).view(np.uint8)).sum()
        passed += differ <= near_dup.most_bits(0.8)
    assert found == passed == 400


def test_salting_and_crowds_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 7)
    monkeypatch.setattr(near_dup, "CROWD", 3)
    monkeypatch.setattr(near_dup, "RARE", 4)
    rows = near_rows()
    got = near_dup.near_duplicates(brute.frame(spark, rows), percent=85).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == Counter(brute.groups(rows, 85))


def token_runs(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def leaks(docs, items):
    """Windows by brute force over all pairs of positions."""
    out = {}
    for i, text, _ in docs:
        d = token_runs(text)
        for k, item in items:
            b = token_runs(item)
            masks = decontaminate.MASKS if len(b) >= 12 else ("1" * decontaminate.SHORT,)
            span = len(masks[0])
            for p in range(len(d) - span + 1):
                for q in range(len(b) - span + 1):
                    if not any(all(d[p + x] == b[q + x] for x in range(span) if m[x] == "1") for m in masks):
                        continue
                    before, after = min(6, p, q), min(span + 6, len(d) - p, len(b) - q)
                    same = sum(d[p + x] == b[q + x] for x in range(-before, after))
                    if 10 * same >= 8 * (before + after):
                        out.setdefault((i, k), set()).add((p, q))
    return {key: (len(v), min(p for p, _ in v)) for key, v in out.items()}


def bench(rng):
    items = [(i, brute.prose(rng, rng.choice([15, 30]))) for i in range(6)]
    return [*items, (10, "seven short words of one brief item"), (11, "too few words"), (12, None), (None, brute.prose(rng, 20)), (0, items[0][1])]


def test_leaks(spark, monkeypatch):
    rng = random.Random(13)
    items = bench(rng)
    rows = brute.documents(seed=3, n=15)
    for j, (_, text) in enumerate(items):
        if text:
            w = text.split()
            rows.append((1000 + j, brute.prose(rng, 20) + " " + text.upper() + " " + brute.prose(rng, 20), "s"))
            w[len(w) // 2] = "changed"
            rows.append((1100 + j, brute.prose(rng, 20) + " " + " ".join(w) + "! " + brute.prose(rng, 20), "s"))
    rows.append((1000, rows[-1][1], "s"))
    df = brute.frame(spark, rows)
    bm = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "1 AS doc_id")
    want = {}
    for key, value in leaks([r for r in rows if r[0] != 1000], items).items():
        want[key] = value
    got = {(r["doc_id"], r["item_id"]): (r["n_windows"], r["first_word"]) for r in decontaminate.find_leaks(df, bm).collect()}
    assert {k: v for k, v in got.items() if k[0] != 1000 and k[1] not in (0, None)} == {k: v for k, v in want.items() if k[1] not in (0, None)}
    assert {k for k in got if k[0] != 1000} == set(want)
    assert {(1000 + j, i) for j, (i, t) in enumerate(items) if t and i != 11} <= set(got)
    assert not any(i is not None and i < 400 for i, _ in got)
    kept = decontaminate.drop_leaks(df, bm)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == {r[0] for r in rows} - {i for i, _ in got}
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", 0)
    shuffled = {(r["doc_id"], r["item_id"]): (r["n_windows"], r["first_word"]) for r in decontaminate.find_leaks(df, bm).collect()}
    assert shuffled == got


def toxic_table(n=600):
    rng = random.Random(17)
    rows, labels = [], []
    for i in range(n):
        bad = i % 6 == 0
        w = brute.prose(rng, 60).split()
        if bad:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(["grumbo", "snarf", "blatz"]) + rng.choice(["", ",", "!"]))
        rows.append((i, " ".join(w), "s"))
        labels.append((i, int(bad)))
    labels += [(None, 1), (5, None), (10**6, 1), (0, 1)]
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = toxic_table()
    odd = [(700, None, "s"), (701, "", "s"), (702, "you grumbo! not a snarf", "s"), (702, "you grumbo! not a snarf", "s"), (None, "grumbo snarf", "s")]
    df = brute.frame(spark, rows + odd).withColumnRenamed("n_words", "score")
    model = toxicity.fit(df, spark.createDataFrame(labels, "doc_id bigint, toxic int").selectExpr("*", "'x' AS text"))
    assert {"grumbo", "snarf", "blatz"} <= set(model.words)
    got = toxicity.score_toxicity(df, model).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 600 and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert len(held) > 100
    assert sum(r["predicted"] == (r["doc_id"] % 6 == 0) for r in held) >= 0.98 * len(held)
    reader = toxicity.Reader(model)
    plain = {(i, round(reader.score(reader.raw(t or "")), 9)) for i, t, _ in rows + odd}
    assert {(r["doc_id"], round(r["score"], 9)) for r in got} == plain
    assert all(r["predicted"] == (r["score"] >= 0.7) for r in got)


def test_grammar_weighs_context():
    reader = toxicity.Reader(toxicity.Model({"fool": 1.0}, {"scoun": 0.5}))
    raw = reader.raw
    assert raw("a fool") == 1.0 and raw("you fool") == 1.25 and raw("the scoundrels,") == 0.5
    assert raw("not a fool") == 0.4 and raw("not one two three fool") == 1.0
    assert raw("he said: a fool") == 1.25 * 0.5
    assert raw("kill you") == 1.0 and raw("kill. you") == 0.0 and raw("kill time") == 0.0
    assert raw("") == 0.0 and raw("fool\nfool. fool") == 3.0


def test_no_labels_and_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    empty = brute.frame(spark, [])
    bm = spark.createDataFrame([], "item_id bigint, text string")
    model = toxicity.fit(brute.frame(spark, brute.documents(n=8)), none)
    assert model.words == {} and toxicity.score_toxicity(empty, model).count() == 0
    assert near_dup.near_duplicates(empty).count() == decontaminate.find_leaks(empty, bm).count() == 0
    assert decontaminate.find_leaks(brute.frame(spark, brute.documents(n=8)), bm).count() == 0
