"""Training-format detection and chat-turn checks."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.canonical import column, type_of
from ..functions.text import bind, is_blank

# --- Fixed values: column-name layouts, in order of precedence ---------------
NAMED_LAYOUTS = (
    ("alpaca", ("instruction", "output")),
    ("prompt_completion", ("prompt", "completion")),
)
FALLBACK_LAYOUTS = (
    ("prompt_response", ("prompt", "response")),
    ("prompt_answer", ("prompt", "answer")),
    ("qa", ("question", "answer")),
    ("qa", ("question", "answers")),
    ("query_response", ("query", "response")),
    ("query_answer", ("query", "answer")),
    ("input_output", ("input", "output")),
    ("input_target", ("input", "target")),
    ("source_target", ("source", "target")),
)
PREFERENCE_LAYOUT = ("rlhf_preference_pairs", ("chosen", "rejected"))
CONVERSATION_NAMES = ("conversations", "conversation")
MESSAGES_NAMES = ("messages",)
PLAIN_TEXT_NAMES = ("text", "content", "document", "passage", "body")
GENERIC = "generic_tabular"
ALTERNATING_ROLES = ("human", "user", "assistant", "gpt")
SYSTEM_ROLE = "system"
KEYS_OF = {"sharegpt": ("from", "value"), "chatml": ("role", "content")}

# Turn numbers per group in the long layout. A group holds at most this many
# rows, however long the conversation.
TURNS_PER_BLOCK = 65_536


@dataclass(frozen=True)
class FormatInfo:
    formats: list[str] = field(default_factory=list)
    conversation_column: str | None = None
    messages_column: str | None = None

    @property
    def chat_column(self) -> str | None:
        return self.conversation_column or self.messages_column


def _valid_turns(df: DataFrame, name: str, keys: tuple[str, str]) -> Column | None:
    """Non-empty list whose every item has both keys; None if the type rules it out."""
    dtype, c = type_of(df, name), column(name)
    if not isinstance(dtype, T.ArrayType):
        return None
    item = dtype.elementType
    if isinstance(item, T.StructType) and set(keys) <= set(item.names):
        return (F.size(c) > 0) & F.forall(c, lambda t: t.isNotNull())
    if isinstance(item, T.MapType):
        return (F.size(c) > 0) & F.forall(
            c, lambda t: F.map_contains_key(t, keys[0]) & F.map_contains_key(t, keys[1])
        )
    return None


def _some_valid(df: DataFrame, name: str | None, kind: str) -> bool:
    valid = _valid_turns(df, name, KEYS_OF[kind]) if name else None
    return valid is not None and not df.filter(valid).isEmpty()


def detect_format(df: DataFrame) -> FormatInfo:
    """Layouts told by column names; chat layouts need one valid row as well."""
    lowered = {c.lower() for c in df.columns}

    def first(names):
        return next((c for c in df.columns if c.lower() in names), None)

    found = [label for label, need in NAMED_LAYOUTS if lowered >= set(need)]
    if not found:
        found = [label for label, need in FALLBACK_LAYOUTS if lowered >= set(need)][:1]
    if lowered >= set(PREFERENCE_LAYOUT[1]):
        found.append(PREFERENCE_LAYOUT[0])
    conversation, messages = first(CONVERSATION_NAMES), first(MESSAGES_NAMES)
    if _some_valid(df, conversation, "sharegpt"):
        found.append("sharegpt")
    if _some_valid(df, messages, "chatml"):
        found.append("chatml")
    if not found and first(PLAIN_TEXT_NAMES):
        found.append("plain_text")
    return FormatInfo(found or [GENERIC], conversation, messages)


def turn_keys(df: DataFrame, name: str) -> tuple[str, str]:
    """Role and content keys, told by the turn's own fields."""
    dtype = type_of(df, name)
    item = dtype.elementType if isinstance(dtype, T.ArrayType) else None
    by_name = "sharegpt" if name.lower() in CONVERSATION_NAMES else "chatml"
    order = [by_name] + [k for k in KEYS_OF if k != by_name]
    if isinstance(item, T.StructType):
        for kind in order:
            if set(KEYS_OF[kind]) <= set(item.names):
                return KEYS_OF[kind]
        for kind in order:
            if set(KEYS_OF[kind]) & set(item.names):
                return KEYS_OF[kind]
    return KEYS_OF[by_name]


def chat_flags(df: DataFrame, name: str) -> dict[str, Column]:
    """``broken_ordering`` and ``empty_turn`` of a nested conversation column.

    Both are row-local: linear in the turns, no shuffle.
    """
    c, dtype = column(name), type_of(df, name)
    no = F.lit(False)
    item = dtype.elementType if isinstance(dtype, T.ArrayType) else None
    if not isinstance(item, (T.StructType, T.MapType)):
        return {"broken_ordering": c.isNotNull(), "empty_turn": no}
    role_key, text_key = turn_keys(df, name)

    def part(turn: Column, key: str) -> Column:
        if isinstance(item, T.StructType) and key not in item.names:
            return F.lit("")
        return F.coalesce(turn[key].cast("string"), F.lit(""))

    roles = F.filter(
        F.transform(c, lambda t: F.lower(part(t, role_key))), lambda r: r != SYSTEM_ROLE
    )
    def repeats(spoken: Column) -> Column:
        return F.exists(
            F.transform(spoken, lambda r, i: F.struct(r.alias("role"), i.alias("at"))),
            lambda x: (x["at"] > 0)
            & (x["role"] == F.get(spoken, x["at"] - 1))
            & x["role"].isin(*ALTERNATING_ROLES),
        )

    broken = (F.size(c) == 0) | F.exists(c, lambda t: t.isNull())
    broken = broken | bind(roles, repeats)
    empty = F.exists(c, lambda t: t.isNotNull() & is_blank(part(t, text_key)))
    return {
        "broken_ordering": F.when(c.isNull(), no).otherwise(broken),
        "empty_turn": F.when(c.isNull(), no).otherwise(empty),
    }


def turn_validation(df: DataFrame, name: str) -> DataFrame:
    """One row: conversations with broken order, and with an empty turn."""
    flags = chat_flags(df, name)
    return df.agg(
        F.count_if(flags["broken_ordering"]).alias("broken_ordering_rows"),
        F.count_if(flags["empty_turn"]).alias("empty_turn_rows"),
    )


def long_turn_flags(
    df: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    content: str = "text",
    turns_per_block: int = TURNS_PER_BLOCK,
) -> DataFrame:
    """(conv_id, broken_ordering, empty_turn) for one row per turn.

    Turns are compared within blocks of turn numbers, and the blocks' own first
    and last roles with each other, so no task ever holds one whole conversation.
    Turns with the same number are merged before that, and their conversation
    counts as broken. Turns without a conversation have no order: they make one
    row with a null id, whose ``broken_ordering`` is null.
    """
    own = df.select(
        column(conv_id).alias("conv_id"),
        column(turn).alias("turn"),
        F.lower(F.coalesce(column(role), F.lit(""))).alias("role"),
        is_blank(column(content)).alias("blank"),
    )
    lost = (
        own.filter(F.col("conv_id").isNull())
        .agg(F.bool_or("blank").alias("empty_turn"))
        .filter(F.col("empty_turn").isNotNull())
        .select(
            F.lit(None).cast(own.schema["conv_id"].dataType).alias("conv_id"),
            F.lit(None).cast("boolean").alias("broken_ordering"), "empty_turn",
        )
    )
    turns = (
        own.filter(F.col("conv_id").isNotNull())
        .groupBy("conv_id", "turn")
        .agg(F.min("role").alias("role"), F.bool_or("blank").alias("blank"), (F.count("*") > 1).alias("again"))
        .withColumn("block", F.floor(F.col("turn") / turns_per_block))
    )
    spoken = turns.filter(F.col("role") != SYSTEM_ROLE)
    checked = F.col("role").isin(*ALTERNATING_ROLES)
    within = W.partitionBy("conv_id", "block").orderBy("turn")
    inside = spoken.select(
        "conv_id", (checked & (F.col("role") == F.lag("role").over(within))).alias("broken")
    )
    between = W.partitionBy("conv_id").orderBy("block")
    edges = (
        spoken.groupBy("conv_id", "block")
        .agg(F.min_by("role", "turn").alias("role"), F.max_by("role", "turn").alias("last"))
        .select(
            "conv_id", (checked & (F.col("role") == F.lag("last").over(between))).alias("broken")
        )
    )
    no = F.lit(False)
    return (
        turns.select("conv_id", F.col("again").alias("broken"), "blank")
        .unionAll(inside.select("conv_id", "broken", no))
        .unionAll(edges.select("conv_id", "broken", no))
        .groupBy("conv_id")
        .agg(
            F.coalesce(F.bool_or("broken"), no).alias("broken_ordering"),
            F.bool_or("blank").alias("empty_turn"),
        )
        .unionAll(lost)
    )
