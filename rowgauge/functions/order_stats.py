"""Exact order statistics of very large columns.

``percentile`` keeps every distinct value of a group in one task, which does
not hold for billions of doubles. Here a sketch proposes a narrow interval
around each wanted rank, a count proves that the rank lies in it, and only the
values inside the last interval are grouped and ranked. Each round shrinks an
interval by a factor in the thousands, so two rounds cover 10^11 values; all
that reaches the driver is one row per round. An interval that a count does not
prove is proposed again with more room on both sides, and one that does not
shrink, with a finer sketch; the ranking never sees more than ``small`` distinct
places between the ends of an interval.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SMALL = 100_000
ACCURACY = 10_000
FINEST = 10_000_000
MAX_ROUNDS = 64


@dataclass
class _Bracket:
    name: str
    first: int     # 0-based ranks among the non-null values,
    last: int      # both wanted (equal or neighbours)
    low: Any       # both ends belong to the interval
    high: Any
    below: int     # values < low
    upto: int      # values <= high
    strict: int    # values strictly between the ends
    room: float = 2.0    # ranks to either side of a guess, in units of the sketch's error
    finer: int = 1       # how much finer than usual its sketch has to be

    @property
    def interval(self):
        return (self.name, self.low, self.high)


def _bounds(df: DataFrame, columns: Mapping[str, Column]) -> dict[str, tuple[int, Any, Any]]:
    exprs = []
    for c in columns.values():
        exprs += [F.count(c), F.min(c), F.max(c)]
    row = df.agg(*[e.alias(f"x{i}") for i, e in enumerate(exprs)]).first()
    return {name: tuple(row[3 * i : 3 * i + 3]) for i, name in enumerate(columns)}


def _guesses(df, columns, brackets, accuracy) -> list[tuple[Any, Any]]:
    """A narrower interval for each bracket; one sketch per current interval."""
    places: dict[tuple, list[float]] = {}
    at = []
    for b in brackets:
        span = max(b.upto - b.below - 1, 1)
        ends = places.setdefault(b.interval, [])
        at.append(len(ends))
        ends.append(max((b.first - b.below) / span - b.room / accuracy, 0.0))
        ends.append(min((b.last - b.below) / span + b.room / accuracy, 1.0))
    sketches = []
    for i, ((name, low, high), ends) in enumerate(places.items()):
        c = columns[name]
        inside = F.when((c >= F.lit(low)) & (c <= F.lit(high)), c)
        sketches.append(F.percentile_approx(inside, ends, accuracy).alias(f"x{i}"))
    row = df.agg(*sketches).first()
    values = dict(zip(places, row))
    return [(values[b.interval][k], values[b.interval][k + 1]) for b, k in zip(brackets, at)]


def _enough(brackets, small, accuracy) -> int:
    """No finer a sketch than it takes to get under ``small`` in one round."""
    widest = max(b.strict for b in brackets)
    usual = int(min(accuracy, max(40 * widest / small, 100)))
    return min(usual * max(b.finer for b in brackets), FINEST)


def _narrow(df, columns, brackets, accuracy) -> None:
    guesses = _guesses(df, columns, brackets, accuracy)
    counts = []
    for i, (b, (low, high)) in enumerate(zip(brackets, guesses)):
        c = columns[b.name]
        counts += [
            F.count_if(c < F.lit(low)).alias(f"b{i}"),
            F.count_if(c <= F.lit(high)).alias(f"u{i}"),
            F.count_if((c > F.lit(low)) & (c < F.lit(high))).alias(f"s{i}"),
        ]
    seen = df.agg(*counts).first()
    for i, (b, (low, high)) in enumerate(zip(brackets, guesses)):
        below, upto, strict = seen[3 * i : 3 * i + 3]
        proven = below <= b.first and b.last < upto
        if not proven:
            b.room *= 4
        elif strict > b.strict / 2:
            b.finer *= 4
        if proven:
            b.low, b.high, b.below, b.upto, b.strict = low, high, below, upto, strict


def _rank_inside(df, columns, brackets) -> dict[tuple[str, int], Any]:
    """Group the values inside each interval and walk up to the ranks.

    Columns of one type share a job.
    """
    types = df.select(*[columns[b.name].alias(f"x{i}") for i, b in enumerate(brackets)]).dtypes
    found = {}
    for dtype in dict.fromkeys(t for _, t in types):
        found.update(
            _ranks_of_one_type(df, columns, [b for b, (_, t) in zip(brackets, types) if t == dtype])
        )
    return found


def _ranks_of_one_type(df, columns, brackets) -> dict[tuple[str, int], Any]:
    intervals: dict[tuple, list[_Bracket]] = {}
    for b in brackets:
        intervals.setdefault(b.interval, []).append(b)
    some, cells = F.lit(False), []
    for i, (name, low, high) in enumerate(intervals):
        c = columns[name]
        inside = (c >= F.lit(low)) & (c <= F.lit(high))
        some = some | inside
        cells.append(F.when(inside, F.struct(F.lit(i).alias("at"), c.alias("value"))))
    cum = F.sum("n").over(W.partitionBy("at").orderBy("value"))
    ranked = (
        df.filter(some)
        .select(F.inline(F.array_compact(F.array(*cells))))
        .groupBy("at", "value")
        .agg(F.count("*").alias("n"))
        .withColumn("cum", cum)
    )
    wanted = F.lit(False)
    for i, group in enumerate(intervals.values()):
        for b in group:
            reached = (F.col("cum") > b.first - b.below) & (
                F.col("cum") - F.col("n") <= b.last - b.below
            )
            wanted = wanted | ((F.col("at") == i) & reached)
    found, groups = {}, list(intervals.values())
    for r in ranked.filter(wanted).collect():
        for b in groups[r["at"]]:
            for rank in (b.first, b.last):
                if r["cum"] - r["n"] <= rank - b.below < r["cum"]:
                    found[b.name, rank] = r["value"]
    return found


def order_statistics(
    df: DataFrame,
    columns: Mapping[str, Column],
    ranks: Mapping[str, Sequence[int]],
    bounds: Mapping[str, tuple[int, Any, Any]] | None = None,
    small: int = SMALL,
    accuracy: int = ACCURACY,
) -> dict[tuple[str, int], Any]:
    """The value at each 0-based rank of each column (nulls left out).

    ``bounds`` may hold (count, min, max) per column where the caller has them.
    """
    known = bounds if bounds is not None else _bounds(df, columns)
    brackets: list[_Bracket] = []
    for name, wanted in ranks.items():
        n, low, high = known[name]
        for rank in sorted({r for r in wanted if r < n}):
            last = brackets[-1] if brackets else None
            if last and last.name == name and last.first == last.last == rank - 1:
                last.last = rank
            else:
                brackets.append(_Bracket(name, rank, rank, low, high, 0, n, n))
    for _ in range(MAX_ROUNDS):
        wide = [b for b in brackets if b.strict > small and b.low != b.high]
        if not wide:
            break
        _narrow(df, columns, wide, _enough(wide, small, accuracy))
    else:
        raise RuntimeError("order statistics did not converge")

    values = {}
    for b in brackets:
        if b.low == b.high:
            values[b.name, b.first] = values[b.name, b.last] = b.low
    open_ = [b for b in brackets if b.low != b.high]
    if open_:
        values.update(_rank_inside(df, columns, open_))
    return values
