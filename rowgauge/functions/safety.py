"""Personal-data and keyword expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT, PII_PATTERNS, SEARCH_FORMS, WORD_SET, AuditConfig
from .text import bind, contains_any


def has_luhn_number(text: Column, pattern: str) -> Column:
    """Some match of the pattern passes the Luhn checksum."""
    numbers = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    valid = F.exists(
        numbers, lambda m: F.call_function("luhn_check", F.regexp_replace(m, "[^0-9]", ""))
    )
    return F.when(text.isNull(), F.lit(None)).otherwise(
        F.when(text.rlike(pattern), valid).otherwise(F.lit(False))
    )


def pii_flags(text: Column, cfg: AuditConfig = DEFAULT) -> dict[str, Column]:
    flags = {}
    for label, pattern in cfg.pii_patterns.items():
        if label in cfg.luhn_labels:
            flags[label] = has_luhn_number(text, pattern)
        elif pattern == PII_PATTERNS["email"]:
            # It needs an @; looking for that alone is far cheaper than the
            # regex and rules out most texts.
            flags[label] = text.contains("@") & text.rlike(pattern)
        else:
            flags[label] = text.rlike(SEARCH_FORMS.get(pattern, pattern))
    return flags


def _escape(word: str) -> str:
    return "".join(ch if ch.isalnum() or ch in "_ " else "\\" + ch for ch in word)


def _is_word(ch: str) -> bool:
    return ch.isalnum() or ch == "_"


def whole_word(word: str) -> str:
    """Pattern of the word with a word boundary on both sides.

    The literal comes first and the look-behind after it, so the engine can
    skip ahead to the literal.
    """
    inside, body = f"[{WORD_SET}]", _escape(word)
    before = f"(?<!{inside}{body})" if _is_word(word[0]) else f"(?<={inside}{body})"
    after = f"(?!{inside})" if _is_word(word[-1]) else f"(?={inside})"
    return body + before + after


def _is_plain(word: str) -> bool:
    return all(_is_word(ch) for ch in word)


#: Lists of up to this many words are searched for; longer ones are looked up.
SEARCHED = 200


def has_keyword(lowered: Column, words: Sequence[str]) -> Column:
    """Some listed word occurs as a whole word.

    Of short lists the bare words are looked for first, which rules out most texts
    at the cost of a substring search; only the others meet the pattern with its
    boundaries. Plain words of long lists are looked up among the words of the text,
    whatever their number.
    """
    plain = sorted({w for w in words if _is_plain(w)})
    other = sorted({w for w in words if not _is_plain(w)})
    found = F.lit(False)
    if len(plain) > SEARCHED:
        inside = F.split(lowered, f"[^{WORD_SET}]+")
        found = F.arrays_overlap(inside, F.lit(plain))
    else:
        other = plain + other
    if other:
        some = [w for w in other if not any(v != w and v in w for v in other)]
        searched = lowered.rlike("|".join(whole_word(w) for w in other))
        found = found | (contains_any(lowered, some) & searched if len(some) <= SEARCHED else searched)
    return F.when(lowered.isNotNull(), found)


def keyword_flags(
    text: Column, keywords: Mapping[str, Sequence[str]] | None = None
) -> dict[str, Column]:
    """Per category: does a listed word occur in the lower-cased text?

    Texts are lower-cased once a category, not once a word.
    """
    words_of = DEFAULT.keywords if keywords is None else keywords

    def flag(words: Sequence[str]) -> Column:
        return bind(F.lower(text), lambda lowered: has_keyword(lowered, words))

    return {category: flag(words) for category, words in words_of.items()}
