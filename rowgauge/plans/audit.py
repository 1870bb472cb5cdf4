"""One audit from splits to score."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel

from ..config import DEFAULT, AuditConfig
from ..functions import text
from ..functions.canonical import column, row_hash
from ..operators import chat, corpus, numeric, profile, responses
from ..operators.flags import evidence, text_flags
from ..operators.leakage import leaked_keys, training_split
from ..operators.types import dtype_consistency
from ..sources.ranges import primary_split, split_metadata
from ..sources.readers import is_mixed, union_splits
from .checks import TableStats, TextStats, checks_table
from .score import score_dimensions, score_overall


@dataclass
class AuditReport:
    """Results of an audit. The tables are small; ``analysis`` is lazy."""

    splits: DataFrame
    primary_split: str
    checks: DataFrame
    evidence: DataFrame
    leakage: DataFrame | None
    leakage_reason: str
    formats: list[str]
    text_columns: list[str]
    link: str = ""
    analysis: Mapping[str, DataFrame] = field(default_factory=dict)
    cfg: AuditConfig = DEFAULT

    @cached_property
    def dimensions(self) -> DataFrame:
        return score_dimensions(self.checks, self.cfg)

    @cached_property
    def overall(self) -> DataFrame:
        return score_overall(self.checks, self.cfg)


def _analysis(df, row_id, text_cols, cfg) -> Mapping[str, DataFrame]:
    """Statistics that feed no check, ready to run when asked for."""
    body = df.drop(row_id) if row_id else df
    tables = {
        "schema": lambda: profile.schema_report(body),
        "missingness": lambda: profile.missingness(body),
        "fully_empty_rows": lambda: profile.fully_empty_rows(body),
        "correlated_missingness": lambda: profile.correlated_missingness(body, cfg),
        "cardinality": lambda: profile.cardinality(body, cfg),
        "imbalance": lambda: profile.class_balance(body, cfg),
        "outliers": lambda: numeric.numeric_outliers(df, row_id, cfg=cfg),
        "correlation": lambda: numeric.numeric_correlation(body, cfg=cfg),
    }
    if text_cols:
        first = text_cols[0]
        tables.update(
            tokens=lambda: corpus.token_distribution(df, text_cols, cfg),
            length_hist=lambda: corpus.length_histogram(df, first, cfg),
            noise=lambda: corpus.noise(df, [first], cfg),
            openings=lambda: corpus.boilerplate_openings(df, first, cfg),
            vocab=lambda: corpus.vocabulary(df, text_cols),
        )
    return _OnDemand(tables)


class _OnDemand(Mapping):
    """Builds a table at its first use; some need a small aggregate for that."""

    def __init__(self, builders):
        self._builders, self._built = builders, {}

    def __getitem__(self, key):
        if key not in self._built:
            self._built[key] = self._builders[key]()
        return self._built[key]

    def __iter__(self):
        return iter(self._builders)

    def __len__(self):
        return len(self._builders)


#: Id of rows without one of their own: their place in the scan.
SCAN_ID = "row/"


def _slim_table(df, row_id, text_cols, fmt, pair, cfg):
    """Id, flags, token counts and keys of every row: one scan, no texts kept.

    Keys are 16 bytes; a text column's key is kept once for copies and leakage.
    """
    flags, extra = {}, []
    for i, c in enumerate(text_cols):
        flags.update({f"{c}/{k}": v for k, v in text_flags(column(c), cfg).items()})
        extra.append(text.token_estimate(column(c), cfg).alias(f"tokens/{i}"))
        extra.append(F.unhex(text.normal_hash(column(c))).alias(f"near/{i}"))
    if fmt.chat_column:
        flags.update(chat.chat_flags(df, fmt.chat_column))
    if pair:
        flags.update(responses.response_flags(df, *pair, cfg))
    ids = column(row_id) if row_id else F.monotonically_increasing_id().alias(SCAN_ID)
    whole = F.unhex(row_hash(df, [c for c in df.columns if c != row_id])).alias("whole/")
    named = [F.coalesce(v, F.lit(False)).alias(k) for k, v in flags.items()]
    return df.select(ids, whole, *extra, *named), list(flags)


def _leaked(slim, primary, rest, names):
    """Leaked rows per split; the training split's keys are in the slim table, the
    other splits' are made in one scan however many there are, and kept meanwhile."""
    keys = slim.select(F.lit(primary).alias("split"), column("near/0").alias("key"))
    other = rest.select("split", F.unhex(text.normal_hash(F.col("text"))).alias("key"))
    other = other.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return leaked_keys(keys.unionAll(other), [primary, *names]).collect()
    finally:
        other.unpersist()


def _lengths(slim: DataFrame, text_cols) -> dict:
    cells = [
        F.struct(F.lit(c).alias("column"), F.col(f"`tokens/{i}`").alias("tokens"))
        for i, c in enumerate(text_cols)
    ]
    per_length = (
        slim.select(F.inline(F.array(*cells)))
        .filter(F.col("tokens").isNotNull())
        .groupBy("column", "tokens")
        .agg(F.count("*").alias("n"))
    )
    return {r["column"]: r for r in corpus.length_summary(per_length).collect()}


def _proof(slim, row_id, hit, cfg):
    """Evidence rows, and their ids per flag: a few for each."""
    spark = slim.sparkSession
    row_id = row_id or SCAN_ID
    if not hit:
        return spark.createDataFrame([], "check string, row_id string, position bigint"), {}
    found = evidence(slim, row_id, hit, cfg.max_examples)
    rows = sorted(found.collect(), key=lambda r: (r["check"], r["position"]))
    examples = {}
    for r in rows:
        examples.setdefault(r["check"], []).append(str(r["row_id"]))
    return spark.createDataFrame(rows, found.schema), examples


def table_stats(
    df: DataFrame,
    row_id: str | None = None,
    cfg: AuditConfig = DEFAULT,
    variants: DataFrame | None = None,
    primary: str = "data",
    others: Callable[[str], tuple[list[str], DataFrame]] | None = None,
):
    """The numbers behind the checks of one split.

    The split's texts are scanned three times: for column roles, for the slim
    table that flags, lengths, duplicates and leakage share, and for the
    vocabulary; the texts of all other splits once. ``others`` gives, for a text
    column, the names of the other splits that have it and their (split, text).
    Returns the numbers, the evidence, the layout, the text columns and the
    leakage rows (None where it was not checked).
    """
    body_cols = [c for c in df.columns if c != row_id]
    body = df.select(*[column(c) for c in body_cols])
    found, labels = profile.column_roles(body, cfg)
    text_cols = found if cfg.all_text_columns else found[:1]
    fmt = chat.detect_format(body)
    pair = responses.instruction_columns(body)
    leaks = None

    slim, flags = _slim_table(df, row_id, text_cols, fmt, pair, cfg)
    slim = slim.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        named = [F.count_if(column(k)).alias(k) for k in flags]
        row = slim.agg(F.count("*").alias("n"), *named).first()
        hits = {k: row[i + 1] for i, k in enumerate(flags)}
        lengths = _lengths(slim, text_cols) if text_cols else {}
        proof, examples = _proof(slim, row_id, [k for k in flags if hits[k]], cfg)
        near = {c: column(f"near/{i}") for i, c in enumerate(text_cols)}
        repeated = profile.repeated_keys(slim, column("whole/"), near).collect()
        dup = {(r["kind"], r["column"]): r for r in repeated}
        if others and text_cols and training_split([primary]):
            names, rest = others(text_cols[0])
            leaks = _leaked(slim, primary, rest, names) if names else []
    finally:
        slim.unpersist()

    vocab = {}
    if text_cols:
        vocab = {r["column"]: r for r in corpus.vocabulary(df, text_cols).collect()}
    balance = profile.class_balance(body, cfg, labels).collect()
    balance.sort(key=lambda r: body_cols.index(r["column"]))
    mixed = _mixed(body, variants)

    per_text = []
    for c in text_cols:
        near, words, size = dup.get(("near", c)), vocab.get(c), lengths.get(c)
        per_text.append(
            TextStats(
                column=c,
                flags={k.split("/", 1)[1]: n for k, n in hits.items() if k.startswith(c + "/")},
                near_rows=near["duplicate_rows"] if near else 0,
                near_pct=near["duplicate_pct"] if near else 0.0,
                texts=size["count"] if size else 0,
                max_tokens=size["max"] if size else None,
                p99=size["p99"] if size else None,
                ttr=words["ttr"] if words else 0,
                total_tokens=words["total_tokens"] if words else 0,
            )
        )
    exact = dup.get(("exact", ""))
    stats = TableStats(
        columns=body_cols,
        rows=row["n"],
        exact_rows=exact["duplicate_rows"] if exact else 0,
        exact_pct=exact["duplicate_pct"] if exact else 0.0,
        formats=fmt.formats,
        text=per_text,
        mixed=mixed,
        chat=hits if fmt.chat_column else None,
        responses=hits if pair else None,
        output_column=pair[1] if pair else None,
        severe=(
            [
                (r["column"], r["recommended_strategy"])
                for r in balance
                if r["verdict"] == "severe_imbalance"
            ]
            if balance
            else None
        ),
        examples=examples,
    )
    if leaks is not None:
        stats.leaked, stats.train = sum(r["leaked_rows"] for r in leaks), primary
    return stats, proof, fmt, found, leaks


def _mixed(df: DataFrame, variants: DataFrame | None) -> list[str]:
    """Names of mixed columns: record keys, columns the reader marked, variant columns."""
    names = []
    if variants is not None:
        found = dtype_consistency(variants, variants.columns[0]).select("column")
        names += sorted(r[0] for r in found.collect())
    for f in df.schema:
        if is_mixed(f) and f.name not in names:
            names.append(f.name)
        if isinstance(f.dataType, T.VariantType):
            boxed = df.select(
                F.parse_json(F.concat(F.lit('{"v":'), F.to_json(column(f.name)), F.lit("}")))
                .alias("v")
            ).filter(F.col("v").isNotNull())
            if not dtype_consistency(boxed).isEmpty():
                names.append(f.name)
    return names


def audit(
    data: DataFrame | Mapping[str, DataFrame],
    row_id: str | None = None,
    cfg: AuditConfig = DEFAULT,
    split_col: str = "split",
    link: str = "",
    variants: DataFrame | None = None,
) -> AuditReport:
    """Audit one table, or several splits of one dataset.

    ``data`` is a DataFrame (with a ``split_col`` column if it has splits) or a
    DataFrame per split. ``row_id`` names a unique key for evidence rows; without
    one, they are told by their place in the scan. Columns in which ``read_jsonl``
    met several kinds of values are known to it; ``variants`` is the same data
    read as variants, for tables that come otherwise.
    """
    if isinstance(data, DataFrame):
        if split_col in data.columns:
            names = [r[0] for r in data.select(split_col).distinct().orderBy(split_col).collect()]
            parts = {s: data.filter(column(split_col) == s).drop(split_col) for s in names}
            whole = data
        else:
            names, parts = ["data"], {"data": data}
            whole = data.withColumn(split_col, F.lit("data"))
    else:
        names, parts = list(data), dict(data)
        whole = union_splits(parts, split_col)
    primary = primary_split(names)
    df = parts[primary]

    def others(text_col: str) -> tuple[list[str], DataFrame]:
        having = [s for s in names if s != primary and text_col in parts[s].columns]
        if isinstance(data, DataFrame) and having:
            rest = data.filter(~column(split_col).eqNullSafe(primary))
            return having, rest.select(column(split_col).alias("split"), column(text_col).alias("text"))
        rest = {s: parts[s].select(column(text_col).alias("text")) for s in having}
        return having, union_splits(rest) if rest else None

    stats, proof, fmt, text_cols, leaks = table_stats(df, row_id, cfg, variants, primary, others if len(names) > 1 else None)

    leakage, reason = None, ""
    if len(names) < 2 or not text_cols:
        reason = "Need >=2 splits and a text column."
    elif leaks is None:
        reason = "No split named like 'train'."
    else:
        leakage = df.sparkSession.createDataFrame(
            leaks, "split string, leaked_rows bigint, leaked_pct double"
        )

    checks = checks_table(df.sparkSession, stats, cfg)
    for extra in cfg.extra_checks:
        checks = checks.unionByName(extra(df), allowMissingColumns=True)
    return AuditReport(
        splits=split_metadata(whole.drop(row_id) if row_id else whole, split_col),
        primary_split=primary,
        checks=checks,
        evidence=proof,
        leakage=leakage,
        leakage_reason=reason,
        formats=fmt.formats,
        text_columns=text_cols,
        link=link,
        analysis=_analysis(df, row_id, text_cols, cfg),
        cfg=cfg,
    )
