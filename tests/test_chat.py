"""Format detection and turn checks."""

import random

import pytest
from pyspark.sql import functions as F

from rowgauge.operators import chat, responses

CHATML = "id int, messages array<struct<role:string,content:string>>"


def frame(spark, *names):
    return spark.createDataFrame([tuple("x" for _ in names)], ", ".join(f"`{n}` string" for n in names))


@pytest.mark.parametrize(
    "names,formats",
    [
        (("Instruction", "output", "prompt", "completion"), ["alpaca", "prompt_completion"]),
        (("prompt", "response"), ["prompt_response"]),
        (("prompt", "answer", "question"), ["prompt_answer"]),
        (("question", "answers"), ["qa"]),
        (("query", "answer"), ["query_answer"]),
        (("query", "response"), ["query_response"]),
        (("input", "output", "target"), ["input_output"]),
        (("input", "target"), ["input_target"]),
        (("source", "target"), ["source_target"]),
        (("chosen", "rejected", "prompt", "completion"), ["prompt_completion", "rlhf_preference_pairs"]),
        (("Body", "x"), ["plain_text"]),
        (("text", "chosen", "rejected"), ["rlhf_preference_pairs"]),
        (("a", "b"), ["generic_tabular"]),
        (("messages",), ["generic_tabular"]),
    ],
)
def test_named_layouts(spark, names, formats):
    assert chat.detect_format(frame(spark, *names)).formats == formats


def test_chat_layouts(spark):
    df = spark.createDataFrame([(1, [("user", "hi")])], CHATML)
    assert chat.detect_format(df).formats == ["chatml"]
    assert chat.detect_format(df.filter("id = 2")).formats == ["generic_tabular"]
    share = spark.createDataFrame(
        [(1, [{"from": "human", "value": "hi"}])], "id int, Conversations array<map<string,string>>"
    )
    info = chat.detect_format(share)
    assert info.formats == ["sharegpt"] and info.chat_column == "Conversations"
    half = spark.createDataFrame([(1, [{"from": "human"}])], "id int, conversation array<map<string,string>>")
    assert chat.detect_format(half).formats == ["generic_tabular"]


def turns(*roles, blank=None):
    return [(r, " " if i == blank else "text") for i, r in enumerate(roles)]


CONVERSATIONS = [
    (1, turns("user", "assistant", "user"), False, False),
    (2, turns("user", "user"), True, False),
    (3, turns("user", "system", "USER"), True, False),
    (4, turns("user", "tool", "user"), False, False),
    (5, turns("tool", "tool"), False, False),
    (6, turns("system", "system", "assistant"), False, False),
    (7, turns("human", "gpt", "gpt", blank=1), True, True),
    (8, [], True, False),
    (9, None, False, False),
    (10, [("user", None)], False, True),
    (11, turns("assistant", "user", blank=0), False, True),
]


def test_nested_turns(spark):
    df = spark.createDataFrame([c[:2] for c in CONVERSATIONS], CHATML)
    flags = chat.chat_flags(df, "messages")
    got = {r.id: (r.b, r.e) for r in df.select("id", flags["broken_ordering"].alias("b"), flags["empty_turn"].alias("e")).collect()}
    assert got == {c[0]: c[2:] for c in CONVERSATIONS}
    total = chat.turn_validation(df, "messages").first()
    assert (total.broken_ordering_rows, total.empty_turn_rows) == (4, 3)


@pytest.mark.parametrize("block", [1, 2, 3, 65_536])
def test_long_turns_agree_with_nested(spark, block):
    rng = random.Random(4)
    roles = ["user", "assistant", "system", "tool", "Human"]
    nested = [
        (i, [(rng.choice(roles), rng.choice(["x", "", " \n", "words"])) for _ in range(rng.randint(1, 14))])
        for i in range(120)
    ]
    df = spark.createDataFrame(nested, CHATML)
    flags = chat.chat_flags(df, "messages")
    want = {r.id: (r.b, r.e) for r in df.select("id", flags["broken_ordering"].alias("b"), flags["empty_turn"].alias("e")).collect()}
    long = df.select(F.col("id").alias("conv_id"), F.posexplode("messages").alias("turn", "m")).select(
        "conv_id", "turn", "m.role", F.col("m.content").alias("text")
    )
    found = chat.long_turn_flags(long.repartition(6), turns_per_block=block)
    assert {r.conv_id: (r.broken_ordering, r.empty_turn) for r in found.collect()} == want


def test_not_a_list_is_broken(spark):
    df = spark.createDataFrame([("text",), (None,)], "messages string")
    assert chat.turn_validation(df, "messages").first().broken_ordering_rows == 1


def test_conversation_column_with_role_keys(spark):
    df = spark.createDataFrame([(1, turns("user", "user"))], CHATML.replace("messages", "conversations"))
    row = chat.turn_validation(df, "conversations").first()
    assert (row.broken_ordering_rows, row.empty_turn_rows) == (1, 0)


def test_responses(spark):
    rows = [("q" * 60, "a" * 5), ("q" * 60, "a" * 6), ("q" * 50, ""), ("q" * 70, "a" * 7), ("q", None), (None, "ab")]
    df = spark.createDataFrame(rows, "Instruction string, output string")
    assert responses.instruction_columns(df) == ("Instruction", "output")
    row = responses.response_checks(df, "Instruction", "output").first()
    want = sum(1 for q, a in rows if len(a or "") < 0.1 * len(q or "") and len(q or "") > 50)
    assert (row.empty_responses, row.length_ratio_rows) == (2, want)
