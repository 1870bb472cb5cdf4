"""Toxicity by a weighted finite-state grammar over clauses.

Five small transducers read the classes of a clause's words: insults, threats,
whom they aim at, negation, and reported speech. Their composition is one
machine whose states are tuples of theirs; it emits a weight where an insult or
a threat is matched, raised when somebody is addressed, lowered after a negation
or inside what somebody else said. A text's score is a logistic function of the
summed weights of its clauses.

Function words and threats are fixed lists. Insults are learned: words, and
stems that many words share, which stand in many different contexts in several
toxic training texts and in few in others. Contexts, not documents, are counted,
so that a text copied a thousand times teaches no more than once.

Results in odd cases
--------------------
- A null or empty text has no clause and gets the score of weight 0.
- Repeated rows and rows without an id are scored each; a row without an id is in no training set.
- Without labels nothing is learned, and the fixed lists alone decide.
- Extra columns are kept by score_toxicity; its own replace those of their name.
- An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowgauge.llm import common

#: Most labelled rows that the lexicon and the curve are fitted on, and most entries learned.
TRAINING_ROWS, LEXICON = 20_000, 5_000
LEAST_CONTEXTS, LEAST_TEXTS, LEAST_WORDS, LEAST_ODDS = 4, 3, 3, 3.0
STEMS = (4, 5, 6)

#: Fixed word lists, English, German, French and Spanish.
THREATS = "kill murder destroy hurt beat burn hang shoot töten umbringen tuer frapper matar golpear"
TARGETS = "you your yours u they them their he him his she her these those du dich dein ihr euch sie tu te ton vous votre ils tú usted ustedes ellos"
NEGATIONS = "not no never neither nor without isn't aren't don't doesn't nicht kein keine nie pas jamais ni nunca"
REPORTED = "said says saying told wrote writes called quote quoted quoting according sagte schrieb dit écrit dijo escribió"
OTHER, INSULT, THREAT, TARGET, NEGATION, SPEECH = range(6)
EDGES = ".,;:!?\"'()[]{}*#$%&|<>-_"
CLAUSE = re.compile(r"[.!?;\n]+")
#: Tokens whose class a task remembers.
REMEMBERED = 100_000
NOTHING = (OTHER, 0.0)


@dataclass(frozen=True)
class Transducer:
    """next[state][class] and the factor it puts on a match made in that state."""

    next: tuple[tuple[int, ...], ...]
    factor: tuple[float, ...]


def _states(n: int, **moves: dict[int, int]) -> tuple[tuple[int, ...], ...]:
    """Rows of a table in which a class leads from each state to itself unless given."""
    return tuple(tuple(moves.get(f"c{c}", {}).get(s, s) for c in range(6)) for s in range(n))


#: Somebody was addressed earlier in the clause.
AIMED = Transducer(_states(2, c3={0: 1}), (1.0, 1.25))
#: A negation weighs on the three words after it.
NEGATED = Transducer(
    tuple(tuple(3 if c == NEGATION else max(0, s - 1) for c in range(6)) for s in range(4)), (1.0, 0.4, 0.4, 0.4)
)
#: After a verb of saying, the rest of the clause is another's words.
SAID = Transducer(_states(2, c5={0: 1}), (1.0, 0.5))
#: A threat waits for whom it is aimed at.
THREATENED = Transducer(_states(2, c2={0: 1}, c3={1: 0}), (1.0, 1.0))


class Machine:
    """The composition: one table over tuples of states."""

    def __init__(self) -> None:
        parts = (AIMED, NEGATED, SAID, THREATENED)
        states = list(product(*[range(len(p.next)) for p in parts]))
        index = {s: i for i, s in enumerate(states)}
        self.start = index[(0, 0, 0, 0)]
        self.next = [[index[tuple(p.next[x][c] for p, x in zip(parts, s, strict=True))] for c in range(6)] for s in states]
        self.factor = [math.prod(p.factor[x] for p, x in zip(parts, s, strict=True)) for s in states]
        self.threat = [s[3] == 1 for s in states]

    def weigh(self, clause: list[tuple[int, float]]) -> float:
        state, total = self.start, 0.0
        for kind, weight in clause:
            if kind == INSULT or (kind == TARGET and self.threat[state]):
                total += weight * self.factor[state]
            state = self.next[state][kind]
        return total


@dataclass(frozen=True)
class Model:
    words: dict[str, float]
    stems: dict[str, float]
    bias: float = -3.0
    slope: float = 4.0


@dataclass
class Reader:
    model: Model
    machine: Machine = field(default_factory=Machine)

    def __post_init__(self) -> None:
        fixed = [(THREATS, THREAT), (TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTED, SPEECH)]
        self.fixed = {w: (kind, 1.0) for text, kind in fixed for w in text.split()}
        reader = self

        class Kinds(dict):
            def __missing__(self, token: str) -> tuple[int, float]:
                kind = reader.kind(token.strip(EDGES))
                if len(self) < REMEMBERED and len(token) <= 64:
                    self[token] = kind
                return kind

        self.kinds = Kinds()

    def kind(self, word: str) -> tuple[int, float]:
        if word in self.fixed:
            return self.fixed[word]
        weight = self.model.words.get(word, 0.0)
        for n in STEMS:
            if len(word) >= n:
                weight = max(weight, self.model.stems.get(word[:n], 0.0))
        return (INSULT, weight) if weight else NOTHING

    def raw(self, text: str) -> float:
        """Summed weights of the clauses; most texts hold no match and are left at once."""
        get = self.kinds.__getitem__
        clauses = [[get(t) for t in clause.split()] for clause in CLAUSE.split(text.lower())]
        if not any(k in (INSULT, THREAT) for clause in clauses for k, _ in clause):
            return 0.0
        return sum(map(self.machine.weigh, clauses))

    def score(self, raw: float) -> float:
        z = self.model.bias + self.model.slope * math.log1p(raw)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def training_rows(df: DataFrame, labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """The labelled rows to learn from: crc32 of the id as text, mod 3, is not 1; of
    these TRAINING_ROWS at most, those with the smallest hashes of their ids."""
    chosen = (
        labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .filter(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 != 1)
        .groupBy(id_col).agg(F.max(label_col).alias("_label"))
        .orderBy(F.xxhash64(id_col), id_col).limit(TRAINING_ROWS)
    )
    return df.join(F.broadcast(chosen), id_col)


def learn_lexicon(rows: DataFrame, text_col: str) -> tuple[dict[str, float], dict[str, float]]:
    """Words and stems with their weights. rows: texts with _label.

    One of 63 bits a text counts the different texts well enough for LEAST_TEXTS.
    """
    tokens = F.filter(
        F.transform(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"\s+"), lambda t: F.trim(t, F.lit(EDGES))),
        lambda t: F.length(t) > 2,
    )
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(text_col), F.lit(63)).cast("int"))
    pairs = rows.select("_label", F.when(F.col("_label") == 1, bit).alias("_text_bit"), tokens.alias("_t")).select(
        "_label", "_text_bit", F.explode(F.arrays_zip(F.col("_t").alias("word"), F.concat(F.array(F.lit("")), F.col("_t")).alias("before"))).alias("p")
    ).filter("p.word IS NOT NULL")
    contexts = pairs.groupBy("p.word", "p.before").agg(
        F.max("_label").alias("bad"), F.min("_label").alias("least"), F.bit_or("_text_bit").alias("texts")
    )
    words = common.written(
        contexts.groupBy("word").agg(F.sum("bad").alias("bad"), F.sum(1 - F.col("least")).alias("good"), F.bit_or("texts").alias("texts"))
    )
    bad, good = (float(x or 0) for x in words.agg(F.sum("bad"), F.sum("good")).first())
    odds = F.log((F.col("bad") + 0.5) / F.lit(bad + 1)) - F.log((F.col("good") + 0.5) / F.lit(good + 1))

    def best(df: DataFrame, key: str) -> dict[str, float]:
        top = df.withColumn("odds", odds).filter((F.col("odds") >= LEAST_ODDS) & (F.bit_count("texts") >= LEAST_TEXTS))
        chosen = top.orderBy(F.desc(F.col("odds") * F.log1p("bad")), key).limit(LEXICON).collect()
        return {r[key]: min(1.0, r["odds"] / 5) for r in chosen}

    whole = best(words.filter(F.col("bad") >= LEAST_CONTEXTS), "word")
    cut = words.withColumn("n", F.explode(F.array(*[F.lit(n) for n in STEMS]))).filter(F.length("word") >= F.col("n"))
    stems = (
        cut.groupBy(F.expr("substring(word, 1, n)").alias("stem"))
        .agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.count_if(F.col("bad") > 0).alias("words"), F.bit_or("texts").alias("texts"))
        .filter((F.col("bad") >= 2 * LEAST_CONTEXTS) & (F.col("words") >= LEAST_WORDS))
    )
    return whole, best(stems, "stem")


def fit_curve(points: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Logistic curve over log1p(weight), by Newton steps with a small ridge.

    points: weight, rows, toxic rows.
    """
    a, b, ridge = 0.0, 0.0, 0.1
    for _ in range(50):
        ga, gb, haa, hab, hbb = -ridge * a, -ridge * b, ridge, 0.0, ridge
        for x, n, bad in points:
            x = math.log1p(x)
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * x))))
            ga, gb = ga + bad - n * p, gb + (bad - n * p) * x
            h = n * p * (1 - p)
            haa, hab, hbb = haa + h, hab + h * x, hbb + h * x * x
        det = haa * hbb - hab * hab
        a, b = a + (hbb * ga - hab * gb) / det, b + (haa * gb - hab * ga) / det
    return a, b


def weights(df: DataFrame, model: Model, text_col: str) -> DataFrame:
    """df without its text, with _raw."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        for batch in batches:
            names = batch.schema.names
            raw = [reader.raw(t.as_py() or "") for t in batch.column(names.index("_text"))]
            kept = [n for n in names if n != "_text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(names.index(n)) for n in kept], pa.array(raw, pa.float64())], [*kept, "_raw"])

    common.share_code(df.sparkSession)
    rest = [c for c in df.columns if c not in (text_col, "_text", "_raw")]
    schema = df.select(*rest).schema.add("_raw", "double")
    return df.select(*rest, F.col(text_col).alias("_text")).mapInArrow(run, schema)


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    rows = common.written(training_rows(df.select(id_col, text_col), labels.select(id_col, label_col), id_col, label_col))
    words, stems = learn_lexicon(rows, text_col)
    model = Model(words, stems)
    points = (
        weights(rows.select("_label", text_col), model, text_col)
        .groupBy(F.least(F.round("_raw", 1), F.lit(100.0)).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("_label").alias("bad"))
        .orderBy("w").collect()
    )
    if not points or not 0 < sum(r["bad"] for r in points) < sum(r["n"] for r in points):
        return model
    bias, slope = fit_curve([(r["w"], r["n"], r["bad"]) for r in points])
    return Model(words, stems, bias, slope)


def score_toxicity(df: DataFrame, model: Model, text_col: str = "text", cut: float = 0.7) -> DataFrame:
    """df without its text, with score and predicted."""
    scored = weights(df, model, text_col)
    z = F.lit(model.bias) + F.lit(model.slope) * F.log1p("_raw")
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))
    keep = [c for c in scored.columns if c not in ("_raw", "score", "predicted")]
    return scored.select(*keep, score.alias("score"), (score >= cut).cast("int").alias("predicted"))
