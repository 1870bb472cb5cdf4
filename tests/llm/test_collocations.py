"""Collocations against plain counting of all phrases."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowgauge.llm import collocations
from tests.llm import brute


def plain(rows, least, top):
    """Every phrase of every piece, its cuts and its longer neighbours, by definition."""
    f, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(brute.UPPER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in (1, 2, 3, 4):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    frequent = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    out = []
    for (lang, p), a in frequent.items():
        inside = any(
            lang == other and len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            for (other, q), b in frequent.items()
        )
        if not inside:
            score, _, left, right = min(
                (2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))
            )
            out.append((lang, " ".join(p), a, left, right, total[lang], score))
    ranked = []
    for lang in {x[0] for x in out}:
        mine = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))
        ranked += [(lang, r, *x[1:]) for r, x in enumerate(mine[:top], 1)]
    return sorted(ranked)


def texts(seed=5, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(25)] + ["É", "É x", "THE", "of", "a\x85b"]
    weights = [1 / (k + 1) for k in range(len(words))]
    made = []
    for _ in range(n):
        text = ""
        for w in rng.choices(words, weights, k=rng.choice([0, 3, 40, 120])):
            text += w + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "! "])
            if rng.random() < 0.05:
                text += "in the United States "
        made.append((text, rng.choice(["en", "de", None, ""])))
    return made + [(None, "en"), ("", "de"), (" .,\n", None), ("one", "xx"), ("x x x x x x x x", "en"), *made[:5]]


def found(spark, rows, **args):
    df = spark.createDataFrame(rows, "text string, lang string").select("*", *[F.lit(1).alias(c) for c in ("phrase", "n", "size", "part", "score", "k")])
    out = collocations.collocations(df.repartition(3), **args)
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in out.collect())


@pytest.mark.parametrize("small", [False, True])
def test_collocations(spark, small):
    rows = texts()
    # Spills, bursts, hot prefixes, texts in parts, colliding bits, forgotten words.
    limits = collocations.Limits(entries=60, burst=4, batch=17, words=20, hot=10**6, bits=256, parts=3) if small else collocations.Limits()
    assert found(spark, rows, least=3, top=40, limits=limits) == plain(rows, 3, 40)


def test_empty_table(spark):
    assert found(spark, [], least=3, top=5) == []
    assert found(spark, [(None, None), ("", "en")], least=1, top=5) == []


def test_exact_beyond_64_bits(spark):
    n = 6 * 10**15 + 1
    df = spark.createDataFrame([(n, n + 2, 10**16)], "a bigint, l bigint, r bigint")
    got = df.select(F.expr("CAST(CAST(CAST(a AS DECIMAL(30,0)) * 2000000 AS DECIMAL(38,0)) div (CAST(l AS DECIMAL(30,0)) + CAST(r AS DECIMAL(30,0))) AS BIGINT)"))
    assert got.first()[0] == 2000000 * n // (n + 2 + 10**16)


def test_trie_spills_whole_subtrees():
    rng = np.random.default_rng(1)
    trie, want = collocations.HatTrie(4, burst=8), Counter()
    for _ in range(5):
        first, rest = rng.integers(1, 5, 400), rng.integers(1, 3, 400) << 42 | rng.integers(1, 9, 400) << 21 | rng.integers(0, 9, 400)
        trie.add(first, rest)
        want.update(zip(first.tolist(), rest.tolist(), strict=True))
    assert any(isinstance(x, dict) and not isinstance(x, Counter) for x in trie.root.values())
    assert len(trie) == len(want)
    gone = trie.largest(len(trie) // 2)
    first, keys, counts = trie.take(gone)
    rows = list(zip(first.tolist(), keys.tolist(), strict=True))
    assert rows == sorted(rows)
    assert dict(zip(rows, counts.tolist(), strict=True)) == {k: n for k, n in want.items() if k[0] in gone}
    assert len(trie) == sum(f not in gone for f, _ in want) <= len(want) // 2


@pytest.mark.parametrize("pairs", [True, False])
def test_runs_have_a_row_for_a_bucket_not_a_prefix(pairs):
    """What is shuffled does not grow with the number of prefixes."""
    limits = collocations.Limits(bits=512, buckets=4)
    every = bytes([255]) * (limits.bits // 8)
    miner = collocations.Miner((2,) if pairs else (3, 4), every, None if pairs else every, set(), limits)
    text = " ".join(f"w{i * i % 211}" for i in range(3000))
    batches = [*miner.read([text], ["en"]), *miner.spill(0)]
    assert sum(b.num_rows for b in batches) <= limits.buckets * len(batches)
    got = Counter()
    for b in batches:
        for row in b.to_pylist():
            for run in row["runs"]:
                for suffix, n in zip(run["suffixes"].split("\n"), run["counts"].split(","), strict=True):
                    got[f"{run['prefix']} {suffix}"] += int(n)
    words = text.split()
    assert got == Counter(" ".join(words[i : i + k]) for k in ((2,) if pairs else (3, 4)) for i in range(len(words) - k + 1))


def test_hybrid_containers_give_back_pairs():
    rng = np.random.default_rng(2)
    trie, want = collocations.HatTrie(2, burst=8, span=collocations.SPAN), Counter()
    for _ in range(3):
        first, rest = rng.integers(1, 2000, 900), rng.integers(1, 50, 900)
        trie.add(first, rest)
        want.update(zip(first.tolist(), rest.tolist(), strict=True))
    assert len(trie.root) <= (2000 >> collocations.SPAN) + 1
    first, keys, counts = trie.take(trie.largest(0))
    rows = list(zip(first.tolist(), keys.tolist(), strict=True))
    assert rows == sorted(rows) and dict(zip(rows, counts.tolist(), strict=True)) == want and len(trie) == 0


def test_words_are_cut_at_ascii_white_space_and_ends_alone():
    assert collocations.tokens_of("A\u00a0B\x1fc,D\x0bE\u2003\tÉ!") == ["a\u00a0b\x1fc".encode(), b".", b"d", b".", "e\u2003".encode(), "É".encode(), b"."]


def test_prefixes_of_runs_make_no_rows(spark):
    """A run has its prefixes anew; rows are made for its phrases alone (F1 of round 3)."""
    rows = [(" ".join(f"w{i * i % 89}" for i in range(400)), lang) for lang in ("en", "de", "a\nb", "a\tb")]
    limits = collocations.Limits(bits=512, buckets=4, entries=50)
    every = bytes([255]) * (limits.bits // 8)
    df = spark.createDataFrame(rows, "text string, lang string").repartition(2)
    out = collocations.merged_runs(df, (3, 4), every, every, set(), 2, limits)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate ") == 1
    want = Counter()
    for text, lang in rows:
        w = text.split()
        want.update((lang, " ".join(w[i : i + k]), k) for k in (3, 4) for i in range(len(w) - k + 1))
    assert {(r["lang"], r["phrase"], r["size"]): r["n"] for r in out.collect()} == {k: n for k, n in want.items() if n >= 2}
