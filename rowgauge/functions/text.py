"""Row-level text expressions."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT, MULTI_WS, NOT_WS, SEARCH_FORMS, WS, WS_RUN, AuditConfig


def normalise(text: Column) -> Column:
    """One space for every run of whitespace, stripped, lower-cased.

    Runs that are one space already are passed over, not replaced by themselves.
    """
    return F.lower(F.trim(F.regexp_replace(text, WS_RUN, " ")))


def normal_hash(text: Column) -> Column:
    """128-bit key of the normalised text; null for null."""
    return F.md5(normalise(text))


def is_blank(text: Column) -> Column:
    """Null, empty or only whitespace. Stops at the first other character."""
    return text.isNull() | ~text.rlike(NOT_WS)


def contains_any(text: Column, parts: Sequence[str]) -> Column:
    """Plain substring search, several times faster than a regex of alternatives."""
    found = text.contains(parts[0])
    for part in parts[1:]:
        found = found | text.contains(part)
    return found


def has_odd_whitespace(text: Column, cfg: AuditConfig = DEFAULT) -> Column:
    first, last = F.substring(text, 1, 1), F.substring(text, -1, 1)
    runs = text.rlike(SEARCH_FORMS.get(cfg.multi_ws, cfg.multi_ws))
    if cfg.multi_ws == MULTI_WS:
        # Such a run holds one of these; looking for them rules out most texts.
        runs = contains_any(text, ("  ", "\t", "\n\n\n\n")) & runs
    return runs | first.rlike(WS) | last.rlike(WS)


def token_estimate(text: Column, cfg: AuditConfig = DEFAULT) -> Column:
    """A quarter of the characters, half to even, at least one."""
    if cfg.token_count is not None:
        return cfg.token_count(text)
    estimate = F.bround(F.length(text) / F.lit(4)).cast("bigint")
    return F.when(text.isNotNull(), F.greatest(F.lit(1).cast("bigint"), estimate))


def tokens(text: Column) -> Column:
    """Whitespace-separated tokens."""
    return F.array_remove(F.split(text, WS + "+"), "")


def opening(text: Column, words: int = DEFAULT.opening_words) -> Column:
    """The first ``words`` tokens; the regex stops there, whatever follows."""
    head = F.regexp_extract(
        text, rf"\A{WS}*((?:{NOT_WS}+{WS}+){{0,{words - 1}}}{NOT_WS}+)", 1
    )
    return F.regexp_replace(head, WS + "+", " ")


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once.

    A column used inside a lambda is evaluated again for every element; a
    lambda variable is not.
    """
    return F.element_at(F.transform(F.array(value), use), 1)


def _has_run(values: Column, run: Column) -> Column:
    """Does an array hold some value at least ``run`` times?

    In the sorted array a run that long covers a position that is a multiple of
    ``run``, so only those few positions need a look.
    """

    def covers(ordered: Column, at: Column) -> Column:
        value = F.element_at(ordered, at)
        last = F.array_position(ordered, value) + run - 1
        return F.try_element_at(ordered, last.cast("int")).eqNullSafe(value)

    return bind(
        F.sort_array(values),
        lambda ordered: F.exists(
            F.sequence(run, F.size(ordered), run), lambda at: covers(ordered, at)
        ),
    )


def _repeats_itself(words: Column, cfg: AuditConfig) -> Column:
    n_grams = F.size(words) - (cfg.ngram - 1)
    needed = (F.floor(F.lit(Decimal(cfg.ngram_share)) * n_grams) + 1).cast("int")

    def gram(word: Column, at: Column) -> Column:
        following = [F.get(words, at + F.lit(k)) for k in range(1, cfg.ngram)]
        return F.concat_ws(" ", word, *following)

    grams = F.transform(F.slice(words, F.lit(1), n_grams), gram)
    long_enough = F.size(words) >= cfg.ngram * 3
    return F.when(
        long_enough,
        F.when(_has_run(words, needed), _has_run(grams, needed)).otherwise(F.lit(False)),
    ).otherwise(F.lit(False))


def is_repetitive(text: Column, cfg: AuditConfig = DEFAULT) -> Column:
    """Does one n-gram make up more than its share of the row's n-grams?

    The work stays in the row: nothing is shuffled. The n-gram that occurs k
    times starts k times with the same token, so n-grams are only built for
    rows where some single token is that frequent.
    """
    return F.when(
        text.isNotNull(), bind(tokens(text), lambda words: _repeats_itself(words, cfg))
    )


def quality_flags(text: Column, cfg: AuditConfig = DEFAULT) -> dict[str, Column]:
    return {
        "empty_or_whitespace": is_blank(text),
        "html_bleed": text.rlike(cfg.html_tag),
        "encoding_artifacts": contains_any(text, cfg.mojibake),
        "whitespace_anomalies": has_odd_whitespace(text, cfg),
    }
