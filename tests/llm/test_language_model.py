"""The language model against plain counting, and its trie against sorted lists."""

import math
import mmap
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowgauge.llm import elias_fano, language_model
from tests.llm import brute


@pytest.mark.parametrize("top", [0, 5, 300, 10**12])
def test_rising(top):
    rng = np.random.default_rng(top % 97)
    for n in (0, 1, 2, 63, 64, 65, 1000):
        values = np.sort(rng.integers(0, top + 1, n))
        held = elias_fano.Rising(elias_fano.Rising.pack(values))
        assert held.n == n and (held[np.arange(n)] == values).all()
        x = np.append(rng.integers(0, top + 2, 200), values)
        start = rng.integers(0, n + 1, len(x))
        stop = np.minimum(n, start + rng.integers(0, n + 1, len(x)))
        want = np.clip(np.searchsorted(values, x), start, stop)
        assert (held.successor(x, start, stop) == want).all()


@pytest.mark.parametrize("wide", [3, 50, 10**7])
def test_trie(wide, tmp_path):
    rng = np.random.default_rng(wide)
    for n in (0, 1, 700):
        rows = sorted({tuple(r) for r in rng.integers(0, wide, (n, 3)).tolist()})
        columns = [np.array([r[k] for r in rows], np.int64) for k in range(3)]
        values = rng.integers(0, 65536, len(rows))
        path = tmp_path / f"trie-{n}"
        path.write_bytes(elias_fano.pack_trie(columns, values))
        with open(path, "rb") as file:
            trie = elias_fano.Trie(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ))
            asked = rows + [tuple(r) for r in rng.integers(0, wide + 2, (500, 3)).tolist()]
            got = trie.find([np.array([r[k] for r in asked], np.int64) for k in range(3)])
            at = {r: i for i, r in enumerate(rows)}
            assert got.tolist() == [at.get(r, -1) for r in asked]
            assert (trie.values == values).all()


def test_packed_ints():
    rng = np.random.default_rng(2)
    columns = [rng.integers(-(2**62), 2**62, 77), rng.integers(0, 3, 77)]
    got = language_model.unpack_ints(language_model.pack_ints(columns), 77, 2)
    assert all((x == y).all() for x, y in zip(got, columns, strict=True))
    assert [len(x) for x in language_model.unpack_ints(language_model.pack_ints([np.zeros(0, np.int64)]), 0, 3)] == [0, 0, 0]


def plain(rows, spread):
    """(id, n_tokens, n_known, N) -> base and score, from dictionaries of counts."""
    one, two, three, after = Counter(), Counter(), Counter(), Counter()
    docs = [(i, [*brute.words(t), None], train) for i, t, train in rows]
    for _, words, train in docs:
        if train:
            one.update(words)
            row = ["<", *words]
            two.update(zip(row, row[1:]))
            after.update((x,) for x in row[:-1])
            three.update(zip(row, row[1:], row[2:]))
            after.update(zip(row, row[1:-1]))
    total, types = sum(one.values()), len(one)

    def mix(context, n, lower):
        met = after[context]
        rest = (1 + met) ** -spread
        return ((1 - rest) * n / met if n else 0) + rest * lower

    out = []
    for i, words, _ in docs:
        base = score = 0.0
        row = ["<", *words]
        for k, w in enumerate(words):
            p = (one[w] + 1) / (total + types + 1)
            base += math.log10(p)
            p = mix((row[k],), two[row[k], w], p)
            if k:
                p = mix((row[k - 1], row[k]), three[row[k - 1], row[k], w], p)
            score += math.log10(p)
        out.append((i, len(words), sum(one[w] > 0 for w in words), total, base, score))
    return out


def corpus():
    rng = random.Random(3)
    rows = [(i, t, i is not None and i % 3 != 2) for i, t, _ in brute.documents()]
    words = [f"w{k}" for k in range(12)]
    rows += [(500 + i, " ".join(rng.choices(words, [1 / (k + 1) for k in range(12)], k=rng.choice([1, 2, 3, 30, 90]))), i % 2 == 0) for i in range(40)]
    return rows + [(600, "A b\x85c É é", True), (601, "</s> <s> A B", False), (602, "x " * 50, True)]


@pytest.mark.parametrize("sizes", [{}, {"block": 40, "shard": 60}])
def test_scores(spark, sizes):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id bigint, text string, train boolean").select(
        "*", *[F.lit("mine").alias(c) for c in ("row", "doc", "block", "words", "pairs", "score", "n", "seen", "id")]
    )
    out = language_model.score_texts(df.repartition(3), F.col("train"), **sizes).collect()
    key = lambda r: (r[0] is None, r[0], r[1], r[2], round(r[4], 6))
    got = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in out), key=key)
    want = sorted(plain(rows, language_model.SPREAD), key=key)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[4] == pytest.approx(w[4], abs=1e-7)
        # Quantised steps are 1 / 1024; each token may be half a step off.
        assert abs(g[5] - w[5]) <= w[1] / (2 * language_model.STEPS) + 1e-9
    assert all(r["row"] == r["pairs"] == r["seen"] == "mine" for r in out)


def test_probabilities_add_up():
    rng = np.random.default_rng(5)
    seen = np.array([1, 2, 40, 10**6])
    for met in seen:
        n = rng.multinomial(met, np.ones(7) / 7)
        codes = language_model.code_of(n[n > 0], np.full((n > 0).sum(), met), 0.3)
        whole = language_model.value_of(codes).sum() + language_model.lower_share(met, 0.3)
        assert whole == pytest.approx(1, abs=2e-3)


def test_no_training_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    got = language_model.score_texts(df, F.lit(None).cast("boolean")).orderBy("doc_id").collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got] == [(3, 0, 0, 0.0, 0.0), (1, 0, 0, 0.0, 0.0)]
    assert language_model.score_texts(df.limit(0), F.lit(True)).count() == 0


def test_rows_of_three_are_not_made_for_pairs():
    """The pass that sends pairs pays for pairs alone."""
    tokens = [language_model.FIRST + i % 7 for i in range(50)] + [language_model.END]
    r = {
        "tokens": language_model.pack_ints([np.array(tokens, np.int64)]), "n": len(tokens), "docs": np.array([4]), "sizes": np.array([51]),
        "begins": [True], "train": [True], "ids": np.arange(3, 10), "seen": np.full(7, 9), "every": np.full(7, 9),
    }
    on = language_model.Events(r, (1, 1), 1, 100)
    rows = on.pair_rows()
    assert "_threes" not in vars(on) and rows.n.sum() == 51
    assert len(on.threes) == 9 and on.three_at.max() == 8


def test_words_are_those_of_the_ascii_rule():
    text = "Aé\u00a0B\x1fC\x0bÀ\u2003z\tİ\n\r E"
    assert language_model.words_of(text) == [w.encode() for w in ("aé\u00a0b\x1fc", "À\u2003z", "İ", "e")]


def test_blocks_do_not_move_to_their_answers(spark):
    """Blocks hold most of what there is on disk; only answers are shuffled (F2 of round 3)."""
    df = spark.createDataFrame([(i, f"a b{i % 3} c{i} d") for i in range(30)], "doc_id bigint, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = language_model.score_texts(df.repartition(3), F.col("doc_id") % 2 == 0)
        lines = out._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    below = [lines[i + 1] for i, x in enumerate(lines) if "Exchange hashpartitioning(block#" in x]
    assert below and all("collect_list" in x for x in below)


def test_messages_have_no_bytes_that_shards_know():
    """Small numbers take few bytes, and how often a context was met is not sent with each row."""
    small = np.arange(100_000) % 251
    assert len(language_model.pack_ints([small])) < 2_000
    assert language_model.pack_ints([np.array([3, 255])])[0] == 1 and language_model.pack_ints([np.array([-1])])[0] == 8
    rng = np.random.default_rng(4)
    tokens = np.append(language_model.FIRST + rng.integers(0, 40, 999), language_model.END)
    seen = np.bincount(tokens, minlength=43)[3:]
    r = {
        "tokens": language_model.pack_ints([tokens]), "n": 1000, "docs": [4], "sizes": [1000], "begins": [True], "train": [True],
        "ids": np.arange(3, 43)[::-1], "seen": 2 * seen, "every": 2 * seen,
    }
    on = language_model.Events(r, (2, 2), 1, 10**6)
    rows = on.pair_rows()
    ((_, n, data),) = on.messages(rows, True)
    first, second, count, more, told = language_model.unpack_ints(data, n, 5)
    assert n == len(rows.n) and not told.any() and not more.any() and (count == rows.n).all()
    pairs = list(zip(np.cumsum(first).tolist(), second.tolist(), strict=True))
    assert pairs == sorted(pairs) == list(zip(*(c.tolist() for c in rows.columns), strict=True))
    # A context that fills a shard is told: its rows are dealt by all their words.
    assert language_model.Events(r, (2, 2), 4, 20).pair_rows().told.any()
    # The two words before a token are the pair that ends right before it.
    assert (on.pairs[on.context[on.longer]] == (on.u << language_model.WIDTH | on.v)[on.longer]).all()


def test_rows_in_order_with_and_without_room_for_one_key():
    rng = np.random.default_rng(6)
    for top in (5, 2**30):
        rows = [np.append(rng.integers(0, 4, 500) * (top // 4), top) for _ in range(3)]
        key, order = language_model.in_order(rows)
        want = sorted(zip(*(c.tolist() for c in rows), strict=True))
        assert list(zip(*(c[order].tolist() for c in rows), strict=True)) == want
        assert len(np.unique(key)) == len(set(want))


@pytest.mark.parametrize("top", [0, 5, 300, 10**7, 10**12])
def test_rising_finds_and_gives_neighbours(top):
    rng = np.random.default_rng(top % 89)
    for n in (1, 2, 63, 64, 65, 1000):
        values = np.unique(rng.integers(0, top + 1, n))
        n = len(values)
        held = elias_fano.Rising(elias_fano.Rising.pack(values))
        x = np.concatenate([rng.integers(0, top + 2, 200), values, [top + 10**6]])
        start = rng.integers(0, n + 1, len(x))
        stop = np.minimum(n, start + rng.integers(0, n + 1, len(x)))
        at = np.searchsorted(values, x)
        want = np.where((start <= at) & (at < stop) & (np.append(values, -1)[at] == x), at, -1)
        assert (held.find(x, start, stop) == want).all()
        i = np.arange(n - 1)
        one, other = held.with_next(i)
        assert (one == values[:-1]).all() and (other == values[1:]).all()
