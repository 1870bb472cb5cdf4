"""Settings of an audit, and the fixed values they default to."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame

# Character sets spelled out, because ``\s``, ``\w``, ``\d`` and ``\b`` mean
# different things from one regex engine (and JDK) to the next.
WS_SET = (
    r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
WS = f"[{WS_SET}]"
NOT_WS = f"[^{WS_SET}]"
# Runs of white space, but for lone spaces before an ordinary character. Most
# characters fail the first, narrow set and never meet the wide one.
ORDINARY = r"!-~\xa1-\x{167f}"
WS_RUN = f"(?![!-~])(?! [{ORDINARY}]){WS}+"
WORD_SET = r"\p{L}\p{N}_"
WORD = f"[{WORD_SET}]"
DIGIT = r"\p{Nd}"
# The digit is looked at first: the look-behind is slow and digits are rare.
NUMBER_START = f"(?={DIGIT})(?<!{WORD})"
NOT_BEFORE_WORD = f"(?!{WORD})"
BOUNDARY = f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"

# --- Fixed values: text patterns -------------------------------------------
HTML_TAG = r"</?[a-zA-Z][^>]{0,200}>"
STRIPPED_TAG = r"</?[^>]+>"
MOJIBAKE = ("Ã©", "Ã¨", "Ã¶", "Ã¼", "â€™", "â€œ", "â€\x9d", "â€“", "Â ", "\ufffd")
MULTI_WS = r"[ \t]{3,}|\n{4,}"

# What was meant by the sequences above; the replacement character means nothing.
MOJIBAKE_REPAIRS = tuple(zip(MOJIBAKE, ("é", "è", "ö", "ü", "’", "“", "”", "–", " ", ""), strict=True))

# --- Fixed values: personal-data patterns, most specific label order --------
PII_PATTERNS = {
    "email": BOUNDARY + r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}" + BOUNDARY,
    "phone": (
        r"(?:\+?" + DIGIT + "{1,3}[" + WS_SET + r".\-]?)?(?:\(" + DIGIT + r"{2,4}\)[" + WS_SET + r".\-]?)?"
        + DIGIT + "{3}[" + WS_SET + r".\-]" + DIGIT + "{3,4}[" + WS_SET + r".\-]?" + DIGIT + "{0,4}"
    ),
    "ssn": NUMBER_START + DIGIT + "{3}-" + DIGIT + "{2}-" + DIGIT + "{4}" + NOT_BEFORE_WORD,
    "ipv4": NUMBER_START + "(?:" + DIGIT + r"{1,3}\.){3}" + DIGIT + "{1,3}" + NOT_BEFORE_WORD,
    "credit_card": NUMBER_START + r"(?:[0-9][ \-]?){13,16}" + BOUNDARY,
}

# Derived search forms, for when only "is there a match" is asked: the optional
# head and tail of the phone pattern and the open ends of the white-space runs
# cannot change that answer, and without them the search is faster.
SEARCH_FORMS = {
    PII_PATTERNS["phone"]: DIGIT + "{3}[" + WS_SET + r".\-]" + DIGIT + "{3}",
    MULTI_WS: r"[ \t]{3}|\n{4}",
}

# Placeholders in the order in which they are put: the phone pattern overlaps
# addresses and cards and comes last.
PII_PLACEHOLDERS = (
    ("email", "[EMAIL]"), ("ssn", "[SSN]"), ("ipv4", "[IP]"), ("credit_card", "[CARD]"), ("phone", "[PHONE]"),
)

# --- Fixed values: keyword surface list -------------------------------------
KEYWORDS = {
    "profanity": ("fuck", "shit", "bitch", "asshole", "bastard"),
    "violence": ("kill", "murder", "bomb", "shoot", "stab", "attack"),
    "self_harm": ("suicide", "self-harm", "kill myself"),
}

# --- Fixed values: score weights, categories and penalties ------------------
DIMENSIONS = (
    ("Completeness", "0.20", ("SCHEMA", "INTEGRITY")),
    ("Quality", "0.25", ("QUALITY", "CONSISTENCY")),
    ("Format", "0.20", ("FORMAT",)),
    ("Safety", "0.20", ("SAFETY",)),
    ("Diversity", "0.15", ("COVERAGE",)),
)
PENALTIES = {"CRITICAL": 60, "HIGH": 30, "MEDIUM": 15, "LOW": 6, "INFO": 0}
RATINGS = ((90, "Excellent"), (75, "Good"), (50, "Needs Work"))
LOWEST_RATING = "Critical"
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")

# Tokens a CSV or TSV cell may hold to mean "missing".
NA_VALUES = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


@dataclass(frozen=True)
class AuditConfig:
    """What an audit looks for. Every field has the documented default."""

    text_columns: Sequence[str] | None = None
    min_avg_length: float = 12
    all_text_columns: bool = False

    html_tag: str = HTML_TAG
    mojibake: Sequence[str] = MOJIBAKE
    multi_ws: str = MULTI_WS
    pii_patterns: Mapping[str, str] = field(default_factory=lambda: dict(PII_PATTERNS))
    luhn_labels: Sequence[str] = ("credit_card",)
    keywords: Mapping[str, Sequence[str]] = field(default_factory=lambda: dict(KEYWORDS))
    extra_flags: Mapping[str, Callable[[Column], Column]] = field(default_factory=dict)
    extra_checks: Sequence[Callable[[DataFrame], DataFrame]] = ()
    token_count: Callable[[Column], Column] | None = None
    tokenizer_name: str = "estimate(char/4)"

    token_budget: int = 8192
    histogram_bins: int = 12
    ngram: int = 3
    ngram_share: str = "0.3"
    opening_words: int = 8
    top_openings: int = 10
    max_examples: int = 5
    max_classes: int = 50
    balanced_below: float = 1.5
    severe_from: float = 10
    co_missing_from: float = 0.5
    high_cardinality_from: float = 0.9
    iqr_factor: float = 1.5
    z_threshold: float = 3.0
    min_outlier_values: int = 10
    correlation_from: float = 0.8
    duplicate_high_share: float = 0.01
    low_ttr: float = 0.05
    ratio_below: str = "0.1"
    ratio_min_length: int = 50
    generic_format_warns: bool = True

    dimensions: Sequence[tuple[str, str, Sequence[str]]] = DIMENSIONS
    penalties: Mapping[str, int] = field(default_factory=lambda: dict(PENALTIES))


DEFAULT = AuditConfig()
