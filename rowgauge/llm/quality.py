"""Weak supervision of document quality.

Rules look at counts of a text and vote good (1), bad (-1) or abstain (0).
Expectation-maximisation over the table of vote patterns, of which there are at
most 3 to the number of rules however many documents there are, estimates how each
rule votes on good documents and on bad ones, and how many there are. A document's
verdict is the posterior probability that it is good.

A document is good, or bad in one of as many kinds as there are rules: each rule
is there to find one kind. Rules have a rate of bad votes of their own in every
kind, so an accuracy for good documents and others for bad ones, and votes may
depend on each other among bad documents, where one fault hides or brings another.
Abstaining says nothing. The rates start from what rules are written for, and are
held there by half of their weight: good documents rarely get a bad vote. No label
is looked at.

Results in odd cases
--------------------
- A null or empty text has no words; all its counts are 0 and it fails the base.
- Repeated rows and rows without an id are judged each on its own.
- Extra columns are kept; the operator's own columns replace those of their name.
- An empty table gives an empty result.
- Windows of five words are compared by 64-bit hashes within one document.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowgauge.llm import common

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals")
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """SQL conditions over the counts, the same in every SQL dialect."""

    name: str
    bad: str
    good: str


RULES = (
    Rule("length", "n_words < 10", "n_words >= 40"),
    Rule("word_size", "word_chars > 12 * n_words OR word_chars < 2 * n_words", "word_chars BETWEEN 3 * n_words AND 10 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words", "50 * n_symbols <= n_words"),
    Rule("lines", "n_dup_lines >= 5", "n_dup_lines = 0"),
    Rule("repeats", "5 * n_repeat_words > n_words", "50 * n_repeat_words <= n_words"),
    Rule("capitals", "3 * n_capitals > word_chars", "10 * n_capitals <= word_chars"),
)


def with_counts(df: DataFrame, text_col: str) -> DataFrame:
    """df with the columns of COUNTS; no Python, one pass, linear in the text.

    Windows that occur once are most; only texts in which a window returns pay
    for sorting them.
    """
    kept = [c for c in df.columns if c not in COUNTS]
    # The caller's columns in one, so that no name of theirs meets one from here.
    keep = [F.col("row")]
    row = F.struct(*kept) if kept else F.struct(F.lit(0).alias("none"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    filled = F.filter(common.lines(text), lambda line: F.length(F.trim(line, F.lit(common.SPACE))) > 0)
    a = df.select(
        row.alias("row"),
        F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "").alias("_words"),
        filled.alias("_lines"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit("[A-Z]")).cast("long").alias("n_capitals"),
    )
    b = a.select(
        *keep, "n_symbols", "n_capitals",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_h"),
    )
    at = [lambda i, k=k: F.get(F.col("_h"), i + k) for k in range(WINDOW)]
    windows = F.when(
        F.col("n_words") >= WINDOW,
        F.transform(F.sequence(F.lit(0), F.size("_h") - WINDOW), lambda i: F.xxhash64(*[f(i) for f in at])),
    )
    c = b.withColumn("_w", windows)
    pairs = F.when(
        F.size(F.array_distinct("_w")) < F.size("_w"),
        F.sort_array(F.transform("_w", lambda w, i: F.struct(w.alias("w"), i.alias("i")))),
    )
    d = c.select(*keep, *[x for x in COUNTS if x != "n_repeat_words"], pairs.alias("_p"))
    w = lambda k: F.get(F.col("_p"), k)["w"]
    again = F.transform(
        F.filter(
            F.sequence(F.lit(0), F.size("_p") - 1),
            lambda k: F.coalesce(w(k) == w(k - 1), F.lit(False)) | F.coalesce(w(k) == w(k + 1), F.lit(False)),
        ),
        lambda k: F.get(F.col("_p"), k)["i"],
    )
    e = d.withColumn("_at", F.when(F.col("_p").isNotNull(), F.sort_array(again)))
    covered = F.aggregate(
        "_at",
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda s, p: F.struct(
            p.alias("last"), (s["n"] + F.least(F.lit(WINDOW), p - s["last"])).alias("n")
        ),
        lambda s: s["n"],
    )
    return e.select(
        *[F.col("row")[c].alias(c) for c in kept],
        *[F.coalesce(covered, F.lit(0).cast("long")).alias(x) if x == "n_repeat_words" else F.col(x) for x in COUNTS],
    )


def vote(rule: Rule) -> Column:
    return F.when(F.expr(rule.bad), -1).when(F.expr(rule.good), 1).otherwise(0)


#: Where estimates start: the share of each kind of bad documents, and the rate of bad
#: votes on good documents, of a rule on its own kind, and of a rule on another kind.
#: WEIGHT is how much that counts against what is counted. The SQL next door has them too.
KIND, ON_GOOD, ON_OWN, ON_OTHER, WEIGHT, ROUNDS = 0.03, 0.005, 0.9, 0.05, 0.5, 20


def start(n_rules: int) -> list[tuple[float, list[float]]]:
    """(share, rates of bad votes by rule) of good documents and of each bad kind."""
    kinds = [(KIND, [ON_OWN if j == k else ON_OTHER for j in range(n_rules)]) for k in range(n_rules)]
    return [(1 - KIND * n_rules, [ON_GOOD] * n_rules), *kinds]


@dataclass(frozen=True)
class Model:
    kinds: tuple[tuple[float, tuple[float, ...]], ...]
    rules: tuple[Rule, ...]

    def weights(self, votes: tuple[int, ...]) -> list[float]:
        """Share of each kind times the likelihood of the votes."""
        return [
            math.prod([share, *[(rate if v < 0 else 1 - rate) for v, rate in zip(votes, rates, strict=True) if v]])
            for share, rates in self.kinds
        ]

    def posterior(self) -> Column:
        weights = []
        for share, rates in self.kinds:
            weight = F.lit(share)
            for rule, rate in zip(self.rules, rates, strict=True):
                weight = weight * F.when(vote(rule) == -1, rate).when(vote(rule) == 1, 1 - rate).otherwise(1.0)
            weights.append(weight)
        total = weights[0]
        for weight in weights[1:]:
            total = total + weight
        return weights[0] / total


def fit(patterns: list[tuple[tuple[int, ...], int]], rules: tuple[Rule, ...]) -> Model:
    """EM over (votes, number of documents)."""
    first = start(len(rules))
    model = Model(tuple((s, tuple(r)) for s, r in first), rules)
    total = sum(n for _, n in patterns)
    for _ in range(ROUNDS if total else 0):
        shares = []
        for votes, n in patterns:
            weights = model.weights(votes)
            shares.append([n * w / sum(weights) for w in weights])
        kinds = []
        for k, (share, rates) in enumerate(first):
            new = []
            for j, rate in enumerate(rates):
                bad = sum(q[k] for (votes, _), q in zip(patterns, shares, strict=True) if votes[j] < 0)
                cast = sum(q[k] for (votes, _), q in zip(patterns, shares, strict=True) if votes[j])
                new.append((bad + WEIGHT * cast * rate + rate) / ((1 + WEIGHT) * cast + 1))
            kinds.append(((sum(q[k] for q in shares) / total + WEIGHT * share) / (1 + WEIGHT), tuple(new)))
        model = Model(tuple(kinds), rules)
    return model


def judge(
    df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, least: float = 0.5,
    carry: list[str] | None = None,
) -> DataFrame:
    """Every row of df with its counts, base_failed, quality (the posterior) and kept.

    df with its counts is written once to the shared folder; the votes are
    counted there and the verdicts added on reading, so texts are read and
    measured once. `carry` names the columns of df to keep, all by default.
    """
    own = (*COUNTS, "base_failed", "quality", "kept")
    df = df.select(*[c for c in df.columns if c not in own])
    keep = [c for c in df.columns if carry is None or c in carry]
    counted = common.written(with_counts(df, text_col).select(*keep, *COUNTS))
    votes = [vote(r).alias(f"v{j}") for j, r in enumerate(rules)]
    rows = counted.select(*votes).groupBy(*[f"v{j}" for j in range(len(rules))]).count().collect()
    model = fit(sorted((tuple(r[: len(rules)]), r["count"]) for r in rows), rules)
    return with_verdict(counted, model, least)


def with_verdict(counted: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return counted.withColumn("base_failed", failed).withColumn("quality", model.posterior()).withColumn(
        "kept", ~F.col("base_failed") & (F.col("quality") >= least)
    )
