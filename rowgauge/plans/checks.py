"""From audit statistics to the table of checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, SEVERITIES, AuditConfig
from ..operators.chat import GENERIC
from .catalog import ADVICE, CHECK_SCHEMA, CHECKS, FAIL, PASS, WARN


@dataclass
class TextStats:
    """The numbers the checks need about one text column."""

    column: str
    flags: Mapping[str, int]
    near_rows: int
    near_pct: float
    texts: int
    max_tokens: int | None
    p99: float | None
    ttr: float
    total_tokens: int


@dataclass
class TableStats:
    """The numbers the checks need about one split; all of them are few."""

    columns: Sequence[str]
    rows: int
    exact_rows: int
    exact_pct: float
    formats: Sequence[str]
    text: Sequence[TextStats] = ()
    mixed: Sequence[str] = ()
    leaked: int | None = None
    train: str | None = None
    chat: Mapping[str, int] | None = None
    responses: Mapping[str, int] | None = None
    output_column: str | None = None
    severe: Sequence[tuple[str, str]] | None = None
    examples: Mapping[str, Sequence[str]] = field(default_factory=dict)


class _Rows:
    def __init__(self):
        self.rows = []

    def add(self, check, bad=False, status=FAIL, severity="HIGH", rows=0, examples=(), advice=None, **values):
        entry = CHECKS[check]
        values.setdefault("rows", rows)
        template = entry["bad"] if bad and "bad" in entry else entry["good"]
        self.rows.append(
            (
                len(self.rows) + 1,
                check,
                entry["category"],
                entry["name"].format(**values),
                status if bad else PASS,
                int(rows),
                severity if bad else "INFO",
                template.format(**values),
                [str(e) for e in examples],
                ADVICE[advice or check].format(**{"column": "", "strategy": "", **values}),
                entry["effort"],
            )
        )


def _text_checks(out: _Rows, t: TextStats, s: TableStats, cfg: AuditConfig) -> None:
    seen = {k: list(s.examples.get(f"{t.column}/{k}", ())) for k in t.flags}
    for check, flag, status, severity in (
        ("empty_text", "empty_or_whitespace", FAIL, "HIGH"),
        ("html", "html_bleed", WARN, "MEDIUM"),
        ("encoding", "encoding_artifacts", WARN, "MEDIUM"),
    ):
        n = t.flags[flag]
        out.add(check, n > 0, status, severity, n, seen[flag], column=t.column)
    if t.texts:
        over = t.max_tokens > cfg.token_budget
        out.add("token_budget", over, WARN, "MEDIUM", column=t.column, max=t.max_tokens, p99=t.p99)


def _safety_checks(out: _Rows, t: TextStats, s: TableStats) -> None:
    for check, prefix, status, severity in (
        ("pii", "pii_", FAIL, "CRITICAL"),
        ("toxicity", "toxicity_", WARN, "HIGH"),
    ):
        hits = {k.removeprefix(prefix): n for k, n in t.flags.items() if k.startswith(prefix)}
        total = sum(hits.values())
        worst = max(hits, key=hits.get, default="none")
        # The first label with findings, in listed order, supplies examples.
        first = next((k for k, n in hits.items() if n), None)
        examples = s.examples.get(f"{t.column}/{prefix}{first}", ()) if first else ()
        out.add(
            check, total > 0, status, severity, total, examples,
            column=t.column, worst=worst, worst_rows=hits.get(worst, 0),
        )


def check_rows(s: TableStats, cfg: AuditConfig = DEFAULT) -> list[tuple]:
    """At most 18 rows (more with several text columns), in fixed order."""
    out = _Rows()
    shown = ", ".join(s.columns[:12]) + ("..." if len(s.columns) > 12 else "")
    out.add("columns", n=len(s.columns), columns=shown)
    out.add("dtypes", bool(s.mixed), FAIL, "HIGH", len(s.mixed), columns=", ".join(s.mixed))

    grave = s.exact_rows > cfg.duplicate_high_share * max(s.rows, 1)
    out.add(
        "exact_duplicates", s.exact_rows > 0, FAIL, "HIGH" if grave else "MEDIUM",
        s.exact_rows, pct=s.exact_pct,
    )
    for t in s.text:
        out.add(
            "near_duplicates", t.near_rows > 0, WARN, "MEDIUM", t.near_rows,
            column=t.column, pct=t.near_pct,
        )
    if s.leaked is not None:
        out.add("leakage", s.leaked > 0, FAIL, "CRITICAL", s.leaked, train=s.train)
    for t in s.text:
        _text_checks(out, t, s, cfg)

    generic = cfg.generic_format_warns and list(s.formats) == [GENERIC]
    out.add(
        "format", generic, WARN, "LOW", formats=", ".join(s.formats),
        advice="format_generic" if generic else None,
    )
    if s.chat is not None:
        for check, flag, status, severity in (
            ("turn_order", "broken_ordering", FAIL, "HIGH"),
            ("empty_turns", "empty_turn", WARN, "MEDIUM"),
        ):
            n = s.chat[flag]
            out.add(check, n > 0, status, severity, n, s.examples.get(flag, ()))
    for t in s.text:
        _safety_checks(out, t, s)
    if s.responses is not None:
        n = s.responses["empty_response"]
        out.add("empty_responses", n > 0, FAIL, "HIGH", n, column=s.output_column)
        n = s.responses["length_ratio"]
        out.add("length_ratio", n > 0, WARN, "LOW", n, s.examples.get("length_ratio", ()))
    for t in s.text:
        low = 0 < t.ttr < cfg.low_ttr
        out.add(
            "diversity", low, WARN, "LOW", column=t.column, ttr=t.ttr, tokens=t.total_tokens
        )
    if s.severe is not None:
        out.add(
            "class_balance", bool(s.severe), WARN, "MEDIUM",
            columns=", ".join(c for c, _ in s.severe),
            strategy=s.severe[0][1] if s.severe else "none",
        )
    return out.rows


def checks_table(spark: SparkSession, s: TableStats, cfg: AuditConfig = DEFAULT) -> DataFrame:
    return spark.createDataFrame(check_rows(s, cfg), CHECK_SCHEMA)


def by_severity(checks: DataFrame) -> DataFrame:
    """Worst first, then by category."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity"))
    return checks.orderBy(rank, "category", "position")


def issues(checks: DataFrame) -> DataFrame:
    """Failing and warning checks, worst first."""
    return by_severity(checks.filter(F.col("status") != PASS))


def callout(checks: DataFrame) -> DataFrame:
    """The critical and high-severity issues."""
    return issues(checks.filter(F.col("severity").isin("CRITICAL", "HIGH")))
