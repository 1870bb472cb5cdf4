"""What to do after an audit: drop, clean, redact, map, rebalance.

Keys are 128-bit hashes, merged in each task before they move. The row that is
kept of equal ones is the one with the smallest ``row_id``, which must be unique.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, MOJIBAKE_REPAIRS, PII_PLACEHOLDERS, STRIPPED_TAG, AuditConfig
from ..functions import text
from ..functions.bloom import bloom, may_match
from ..functions.canonical import column, row_hash
from ..functions.mojibake import redecode
from ..functions.order_stats import order_statistics
from ..functions.spans import marked_parts, rebuilt, spans
from . import chat, responses
from .leakage import training_split


def _keep_first(df: DataFrame, key: Column, row_id: str) -> DataFrame:
    """The row with the smallest id of each key; rows without a key all stay."""
    own = F.coalesce(key, F.concat(F.lit("row "), column(row_id).cast("string")))
    first = (
        df.select(column(row_id).alias("__id"), own.alias("__key"))
        .groupBy("__key").agg(F.min("__id").alias("__first")).select("__first")
    )
    return df.join(first, column(row_id) == F.col("__first"), "left_semi")


def dedup_exact(df: DataFrame, row_id: str) -> DataFrame:
    """The first of rows that agree in everything but their id."""
    return _keep_first(df, row_hash(df, [c for c in df.columns if c != row_id]), row_id)


def dedup_near(df: DataFrame, text_col: str, row_id: str) -> DataFrame:
    """The first of rows with the same normalised text; rows without text stay."""
    return _keep_first(df, text.normal_hash(column(text_col)), row_id)


def drop_leaked(
    df: DataFrame, text_col: str, splits: Sequence[str], split_col: str = "split"
) -> DataFrame:
    """All rows but those of other splits whose normalised text the training split
    holds; rows without text stay.

    Training rows never move. Their keys are stopped at the scan unless another
    split may hold them, and of the other splits only rows that may be leaked are
    joined with those keys; what else there is passes the two Bloom filters in place.
    """
    train = training_split(splits)
    if train is None:
        return df
    key = text.normal_hash(column(text_col))
    in_train = column(split_col).eqNullSafe(F.lit(train))
    rest = df.filter(~in_train)
    name = f"key_{uuid.uuid4().hex}"
    keys = may_match(df.filter(in_train), key, bloom(rest, key)).select(key.alias(name)).distinct()
    seen = bloom(keys, name)
    leaked = may_match(rest, key, seen).join(keys, key == F.col(name), "left_anti")
    return df.filter(in_train).unionByName(may_match(rest, key, seen, "left_anti")).unionByName(leaked)


def drop_empty(df: DataFrame, text_col: str) -> DataFrame:
    return df.filter(~text.is_blank(column(text_col)))


def strip_tags(c: Column) -> Column:
    """Every tag becomes a space."""
    return F.regexp_replace(c, STRIPPED_TAG, " ")


def repair_text(c: Column) -> Column:
    """Wrongly decoded text becomes what was meant: first whole stretches of UTF-8
    bytes read as characters, then the known sequences that lost a byte on the way."""
    c = redecode(c)
    for broken, meant in MOJIBAKE_REPAIRS:
        c = F.replace(c, F.lit(broken), F.lit(meant))
    return c


def within_budget(df: DataFrame, text_col: str, cfg: AuditConfig = DEFAULT) -> DataFrame:
    """Rows within the token budget; rows without text stay."""
    return df.filter(~F.coalesce(text.token_estimate(column(text_col), cfg) > cfg.token_budget, F.lit(False)))


def drop_empty_responses(df: DataFrame, cfg: AuditConfig = DEFAULT) -> DataFrame:
    found = responses.instruction_columns(df)
    if found is None:
        return df
    return df.filter(~responses.response_flags(df, *found, cfg)["empty_response"])


def coerce(df: DataFrame, name: str, to: str) -> DataFrame:
    """The column as one type; values that have no such form become null."""
    return df.withColumn(name, column(name).try_cast(to))


def coerce_key(variant: Column, key: str, to: str) -> Column:
    """One key of a variant record as one type; other values become null."""
    plain = F.try_variant_get(variant, f"$.{key}", "string")
    return plain if to == "string" else plain.try_cast(to)


def redact(df: DataFrame, text_col: str, cfg: AuditConfig = DEFAULT) -> DataFrame:
    """Personal data in a column become placeholders, the most specific kinds first.

    Each kind is looked for in the text with what the kinds before it found blanked
    out byte for byte, so ranges of different kinds never overlap, what is left of a
    number is still looked at, and no placeholder is ever searched. The text is
    rebuilt once from all ranges. Card-like numbers go only if their checksum holds,
    without the separators behind them, and only where they stand.
    """
    name = lambda kind: f"{kind}_{uuid.uuid4().hex}"
    blanked, found = name("blanked"), []
    out = df.withColumn(blanked, column(text_col))
    for label, placeholder in PII_PLACEHOLDERS:
        if label not in cfg.pii_patterns:
            continue
        parts, these = name("parts"), name(label)
        out = out.withColumn(parts, marked_parts(F.col(blanked), cfg.pii_patterns[label]))
        ranges, checked = spans(F.col(parts)), label in cfg.luhn_labels
        if checked:
            ranges = F.filter(ranges, lambda m: F.call_function("luhn_check", F.regexp_replace(m["match"], "[^0-9]", "")))
        behind = lambda m, checked=checked: F.octet_length(F.regexp_extract(m["match"], r"[ \-]*$", 0)) if checked else F.lit(0)
        put = F.lit(placeholder).alias("put")
        out = out.withColumn(these, F.transform(
            ranges, lambda m: F.struct(m["start"].alias("start"), (m["end"] - behind(m)).alias("end"), put)  # noqa: B023
        ))
        out = out.withColumn(blanked, rebuilt(F.col(blanked), F.col(these), lambda m: F.repeat(F.lit("\0"), m["end"] - m["start"])))
        found += [parts, these]
    none = F.array().cast("array<struct<start:int,end:int,put:string>>")
    ranges = F.array_sort(F.concat(none, *[F.coalesce(F.col(x), none) for x in found[1::2]]))
    return out.withColumn(text_col, rebuilt(column(text_col), ranges, lambda m: m["put"])).drop(blanked, *found)


# --- Chats --------------------------------------------------------------------

#: Roles of the from/value layout by their names elsewhere.
ROLES = {"human": "user", "gpt": "assistant"}


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.cast("string").alias("content"))


def to_chat(df: DataFrame, keep: Sequence[str] = (), name: str = "messages") -> DataFrame:
    """One ``messages`` array of role and content from whatever layout the columns have.

    An ``input`` next to an instruction follows it after an empty line. Raises
    where the columns show no layout of questions and answers.
    """
    info = chat.detect_format(df)
    lowered = {c.lower(): c for c in reversed(df.columns)}
    pairs = {label: names for label, names in (*reversed(chat.FALLBACK_LAYOUTS), *chat.NAMED_LAYOUTS) if set(names) <= set(lowered)}
    label = next((f for f in info.formats if f in pairs or f in chat.KEYS_OF), None)
    if label in chat.KEYS_OF:
        source = info.conversation_column if label == "sharegpt" else info.messages_column
        role, content = chat.KEYS_OF[label]
        known = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
        made = F.transform(
            column(source),
            lambda t: F.struct(
                F.coalesce(F.try_element_at(known, F.lower(t[role])), t[role]).alias("role"), t[content].alias("content")
            ),
        )
    elif label is not None:
        ask, answer = (lowered[n] for n in pairs[label])
        asked = column(ask).cast("string")
        if label == "alpaca" and "input" in lowered:
            extra = column(lowered["input"]).cast("string")
            asked = F.when(text.is_blank(extra), asked).otherwise(F.concat_ws("\n\n", asked, extra))
        made = F.array(_message("user", asked), _message("assistant", column(answer)))
    else:
        raise ValueError(f"no layout of questions and answers in {df.columns}")
    return df.select(*[column(k) for k in keep], made.alias(name))


def fix_turns(df: DataFrame, name: str) -> DataFrame:
    """Blank turns go; then conversations whose order is still broken go whole."""
    role_key, text_key = chat.turn_keys(df, name)
    kept = df.withColumn(name, F.filter(column(name), lambda t: t.isNotNull() & ~text.is_blank(t[text_key].cast("string"))))
    return kept.filter(~chat.chat_flags(kept, name)["broken_ordering"])


def pack_turns(
    df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
    content: str = "text", name: str = "messages",
) -> DataFrame:
    """One row per conversation with its turns in order. A conversation must fit a
    row; longer ones stay as turns, for which ``long_turn_flags`` is made."""
    packed = F.array_sort(F.collect_list(F.struct(
        column(turn).alias("turn"), column(role).alias("role"), column(content).alias("content")
    )))
    bare = F.transform("__turns", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")))
    return df.groupBy(column(conv_id)).agg(packed.alias("__turns")).select(column(conv_id), bare.alias(name))


def unpack_turns(df: DataFrame, name: str = "messages", keep: Sequence[str] = ("conv_id",)) -> DataFrame:
    """One row per turn, numbered from 0, with ``role`` and ``text``."""
    role, content = chat.turn_keys(df, name)
    each = df.select(*[column(k) for k in keep], F.posexplode(column(name)).alias("turn", "__t"))
    return each.select(
        *[column(k) for k in keep], F.col("turn").cast("bigint").alias("turn"),
        F.col("__t")[role].alias("role"), F.col("__t")[content].alias("text"),
    )


# --- Review and balance ---------------------------------------------------------

def review_rows(df: DataFrame, reasons: dict[str, Column], name: str = "reasons") -> DataFrame:
    """Rows to look at, with the reasons that hold, in the order given."""
    held = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in reasons.items()]))
    return df.withColumn(name, held).filter(F.size(name) > 0)


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, rows, weight): all rows over classes times the class's own rows."""
    counts = df.filter(column(label).isNotNull()).groupBy(column(label).alias("label")).agg(F.count("*").alias("rows"))
    total = counts.agg(F.sum("rows").alias("total"), F.count("*").alias("classes"))
    (n, k), = total.collect()
    return counts.withColumn("weight", F.lit(float(n or 0)) / (F.lit(float(k or 0)) * F.col("rows")))


def _place(row_id: Column) -> Column:
    """A number that depends on the id alone: 60 bits of its md5."""
    return F.conv(F.substring(F.md5(row_id.cast("string")), 1, 15), 16, 10).cast("long")


def _smallest(df: DataFrame, columns: dict, k: dict, sizes: dict) -> dict:
    """The k-th smallest value of each column."""
    named = {str(i): c for i, c in enumerate(columns.values())}
    found = order_statistics(df, named, {str(i): [k[v] - 1] for i, v in enumerate(columns)}, **sizes)
    return {v: found[str(i), k[v] - 1] for i, v in enumerate(columns)}


def rebalance(df: DataFrame, label: str, row_id: str, how: str, max_classes: int = DEFAULT.max_classes, **sizes) -> DataFrame:
    """As many rows of each class as the smallest (``under``) or the largest (``over``)
    has, exactly. Every row of a larger goal stands goal // rows times; the rows with
    the smallest hashes of their ids, goal % rows of them, once more. Equal hashes go
    by id; ``row_id`` must be unique within a class.

    The k-th smallest hash of each class is found as an order statistic, so rows are
    neither sorted nor collected. A label column has few classes; one with more than
    ``max_classes`` raises. Rows without a label stay once.
    """
    counts = {r["label"]: r["rows"] for r in class_weights(df, label).limit(max_classes + 1).collect()}
    if len(counts) > max_classes:
        raise ValueError(f"{label} has more than {max_classes} classes")
    if not counts:
        return df
    goal = min(counts.values()) if how == "under" else max(counts.values())
    place, own = _place(column(row_id)), column(row_id)
    cut = {value: goal % n for value, n in counts.items() if goal % n}
    mine = {value: column(label) == F.lit(value) for value in cut}
    last = _smallest(df, {v: F.when(mine[v], place) for v in cut}, cut, sizes)
    level = {v: mine[v] & (place == F.lit(last[v])) for v in cut}
    # Of rows with the very hash of the last one chosen, those with the smallest ids.
    below = [F.count_if(mine[v] & (place < F.lit(last[v]))).alias(f"x{i}") for i, v in enumerate(cut)]
    seen = df.agg(*below).first() if cut else ()
    left = {v: cut[v] - n for v, n in zip(cut, seen, strict=True)}
    last_id = _smallest(df, {v: F.when(level[v], own) for v in cut}, left, sizes)
    copies = F.lit(1)
    for value, n in counts.items():
        more = F.lit(0)
        if value in cut:
            more = (place < F.lit(last[value])) | (level[value] & (own <= F.lit(last_id[value])))
        copies = F.when(column(label) == F.lit(value), F.lit(goal // n) + more.cast("int")).otherwise(copies)
    if how == "under":
        return df.filter(copies > 0)
    name = f"copies_{uuid.uuid4().hex}"
    return df.withColumn(name, F.explode(F.array_repeat(F.lit(0), copies))).drop(name)
