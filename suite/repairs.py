"""Queries of the repair operators, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowgauge.config import AuditConfig
from rowgauge.operators import chat, repair, responses

from .oracles import LABELLED, LINES, PAIRED, PLANTED, SPLIT, blank, normal, tokens
from .queries import labelled, line_chats, mixed_records, paired, planted, split_documents, table

BUDGET = AuditConfig(token_budget=512)
SPLITS = ["test", "train", "validation"]


def hashed(df, *keep):
    """Texts as digests, so that results stay small and comparable."""
    return df.select(*keep, F.md5("text").alias("text_md5"))


def numbered(spark, sf):
    """near_copies with an id: each document, and its copy at a million more."""
    docs = table(spark, sf, "documents")
    first = docs.select("doc_id", "text", "lang", "source")
    other = F.concat(F.lit(" "), F.replace(F.replace("text", F.lit(" "), F.lit(" \t ")), F.lit("e"), F.lit("E")))
    return first.unionAll(docs.select(F.col("doc_id") + 1_000_000, other, "lang", "source"))


def dedup_exact(spark, sf):
    """Documents twice over with new ids: the first of each stays."""
    docs = table(spark, sf, "documents").drop("n_chars")
    return hashed(repair.dedup_exact(docs.unionAll(docs.withColumn("doc_id", F.col("doc_id") + 1_000_000)), "doc_id"), "doc_id", "lang", "source")


def dedup_near(spark, sf):
    return hashed(repair.dedup_near(numbered(spark, sf), "text", "doc_id"), "doc_id")


def drop_leaked(spark, sf):
    return repair.drop_leaked(split_documents(spark, sf), "text", SPLITS).select("doc_id", "split")


def drop_empty(spark, sf):
    return hashed(repair.drop_empty(planted(spark, sf), "text"), "doc_id")


def strip_tags(spark, sf):
    pages = table(spark, sf, "pages")
    return pages.select("page_id", F.md5(repair.strip_tags(F.col("html"))).alias("html_md5"))


#: Latin-1, punctuation, a stretch of other letters, and text that is right as it is.
BROKEN = " â€œcafÃ©â€\x9d â€“ itâ€™s fÃ¼r Ã¶l�Â crÃ¨me Ã±andÃº â‚¬5 â„¢ â€¦ Â°C Ð¿Ñ€Ð¸Ð²ÐµÑ‚ CAFÉ» Å’s"


def repair_text(spark, sf):
    broken = F.concat(F.col("text"), F.lit(BROKEN))
    return planted(spark, sf).select("doc_id", F.md5(repair.repair_text(broken)).alias("text_md5"))


def within_budget(spark, sf):
    return hashed(repair.within_budget(planted(spark, sf), "text", BUDGET), "doc_id")


def drop_empty_responses(spark, sf):
    return repair.drop_empty_responses(paired(spark, sf)).select("conv_id", "turn")


def coerce_mixed(spark, sf):
    """Every value of a key with strings, numbers and booleans, as text and as number."""
    found = mixed_records(spark, sf).select(
        repair.coerce_key(F.col("v"), "k", "string").alias("as_text"),
        repair.coerce_key(F.col("v"), "k", "bigint").alias("as_number"),
        repair.coerce_key(F.col("v"), "num", "double").alias("as_double"),
    )
    return found.groupBy("as_text", "as_number", "as_double").agg(F.count("*").alias("rows"))


def coerce_column(spark, sf):
    status = F.when(F.col("o_orderstatus") == "F", "n/a").otherwise(F.col("o_orderkey").cast("string"))
    made = table(spark, sf, "orders").select("o_orderkey", status.alias("value"))
    return repair.coerce(made, "value", "bigint")


def _flat(df, name, *keep):
    """Messages as one text per row."""
    one = lambda m: F.concat_ws(":", m["role"], F.length(m["content"]).cast("string"), F.md5(m["content"]))
    return df.select(*keep, F.array_join(F.transform(name, one), "|").alias("messages"))


def to_chat(spark, sf):
    """Instructions with an input, and from/value chats, as messages."""
    pairs = paired(spark, sf).withColumn("input", F.when(F.col("turn") % 2 == 1, F.lit("see above")).otherwise(F.lit(" ")))
    made = _flat(repair.to_chat(pairs, ["conv_id", "turn"]), "messages", "conv_id", "turn")
    value = table(spark, sf, "conversations").select(
        (F.col("conv_id") + 1_000_000).alias("conv_id"), "turn",
        F.array(F.struct(F.when(F.col("role") == "user", "human").otherwise("gpt").alias("from"), F.col("text").alias("value"))).alias("conversations"),
    )
    return made.unionAll(_flat(repair.to_chat(value, ["conv_id", "turn"]), "messages", "conv_id", "turn"))


def fix_turns(spark, sf):
    fixed = repair.fix_turns(line_chats(spark, sf), "messages")
    return fixed.select("doc_id", F.size("messages").alias("turns"))


#: Cards alone, twice, and inside a longer number; numbers next to each other.
PERSONAL = " 4111 1111 1111 1111, 94111111111111111 4111111111111111- é 10.1.2.3 555-123-4567 a@b.co 4111 1111 1111 1111"


def redact(spark, sf):
    more = F.when(F.col("doc_id") % 3 == 0, F.concat(F.col("text"), F.lit(PERSONAL))).otherwise(F.col("text"))
    return hashed(repair.redact(planted(spark, sf).withColumn("text", more), "text"), "doc_id")


def review_rows(spark, sf):
    pairs = paired(spark, sf)
    flags = responses.response_flags(pairs, "instruction", "output")
    found = repair.review_rows(pairs, {**flags, "asks_little": F.length("instruction") < 20})
    return found.select("conv_id", "turn", F.array_join("reasons", ",").alias("reasons"))


def class_weights(spark, sf):
    return repair.class_weights(labelled(spark, sf), "quality")


def undersample(spark, sf):
    return repair.rebalance(labelled(spark, sf), "quality", "doc_id", "under").select("doc_id", "quality")


def oversample(spark, sf):
    kept = repair.rebalance(labelled(spark, sf), "quality", "doc_id", "over")
    return kept.groupBy("doc_id", "quality").agg(F.count("*").alias("copies"))


def chat_pack(spark, sf):
    return _flat(repair.pack_turns(table(spark, sf, "conversations")), "messages", "conv_id")


def chat_unpack(spark, sf):
    packed = repair.pack_turns(table(spark, sf, "conversations"))
    return hashed(repair.unpack_turns(packed), "conv_id", "turn", "role")


def chat_from_value(spark, sf):
    """Turn checks of from/value chats."""
    chats = line_chats(spark, sf)
    turns = F.transform("messages", lambda m: F.struct(m["role"].alias("from"), m["content"].alias("value")))
    return chat.turn_validation(chats.select("doc_id", turns.alias("conversations")), "conversations")


QUERIES = {
    f.__name__: f
    for f in (
        dedup_exact, dedup_near, drop_leaked, drop_empty, strip_tags, repair_text, within_budget,
        drop_empty_responses, coerce_mixed, coerce_column, to_chat, fix_turns, redact, review_rows,
        class_weights, undersample, oversample, chat_pack, chat_unpack, chat_from_value,
    )
}

# --- SQL --------------------------------------------------------------------------

NUMBERED = (
    "numbered AS (SELECT doc_id, text FROM documents UNION ALL SELECT doc_id + 1000000, "
    "' ' || replace(replace(text, ' ', ' \t '), 'e', 'E') FROM documents)"
)
#: A sequence and what was meant, in the order in which they are replaced.
REPAIRS = (
    ("Ã©", "é"), ("Ã¨", "è"), ("Ã¶", "ö"), ("Ã¼", "ü"), ("â€™", "’"), ("â€œ", "“"),
    ("â€\x9d", "”"), ("â€“", "–"), ("Â ", " "), ("�", ""),
)
EMAIL = r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"
SSN = r"\b\p{Nd}{3}-\p{Nd}{2}-\p{Nd}{4}\b"
IPV4 = r"\b(?:\p{Nd}{1,3}\.){3}\p{Nd}{1,3}\b"
CARD = r"\b(?:[0-9][ \-]?){13,16}\b"
SPACE = r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
PHONE = (
    rf"(?:\+?\p{{Nd}}{{1,3}}[{SPACE}.\-]?)?(?:\(\p{{Nd}}{{2,4}}\)[{SPACE}.\-]?)?"
    rf"\p{{Nd}}{{3}}[{SPACE}.\-]\p{{Nd}}{{3,4}}[{SPACE}.\-]?\p{{Nd}}{{0,4}}"
)


def _repaired(c: str) -> str:
    read = lambda x: "".join(bytes([b]).decode("cp1252", "replace").replace("\ufffd", chr(b)) for b in x.encode())
    meant = [*map(chr, range(0xA0, 0x100)), *"–—‘’“”„…•‹›€™", "привет"]
    for broken, good in [*((read(m), m) for m in meant), *REPAIRS]:
        c = f"replace({c}, '{broken}', '{good}')"
    return c


def _redacted() -> str:
    c = "text"
    for pattern, placeholder in ((EMAIL, "[EMAIL]"), (SSN, "[SSN]"), (IPV4, "[IP]")):
        c = f"regexp_replace({c}, '{pattern}', '{placeholder}', 'g')"
    digit = "(length(d) - i) % 2 = 1"
    luhn = (
        "list_sum(list_transform(range(1, length(d) + 1), lambda i: "
        f"CASE WHEN {digit} THEN (2 * d[i]::INT) // 10 + (2 * d[i]::INT) % 10 ELSE d[i]::INT END)) % 10 = 0"
    )
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    return f"""WITH {PLANTED}, more AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text || '{PERSONAL}' ELSE text END AS text FROM planted),
a AS (SELECT doc_id, {c} AS t FROM more),
lists AS (SELECT doc_id, t, string_split_regex(t, '{CARD}') AS gaps, regexp_extract_all(t, '{CARD}') AS ms FROM a),
cut AS (SELECT doc_id, unnest(gaps) AS gap, unnest(list_append(ms, '')) AS m, generate_subscripts(gaps, 1) AS i FROM lists WHERE len(ms) > 0),
judged AS (SELECT doc_id, i, gap, CASE WHEN m <> '' AND {luhn} THEN '[CARD]' || substr(m, length(rtrim(m, ' -')) + 1) ELSE m END AS put
  FROM (SELECT *, {digits} AS d FROM cut)),
joined AS (SELECT doc_id, string_agg(gap || put, '' ORDER BY i) AS t FROM judged GROUP BY doc_id),
c AS (SELECT a.doc_id, coalesce(joined.t, a.t) AS t FROM a LEFT JOIN joined ON joined.doc_id = a.doc_id)
SELECT doc_id, md5(regexp_replace(t, '{PHONE}', '[PHONE]', 'g')) AS text_md5 FROM c"""


def _message(role: str, content: str) -> str:
    return f"'{role}:' || length({content}) || ':' || md5({content})"


MIXED = """records AS (SELECT event_type AS kind, json_extract_string(props, '$.k') AS k FROM events),
mixed AS (SELECT CASE kind WHEN 'error' THEN 'true' ELSE k END AS k,
  CASE kind WHEN 'click' THEN k || '.5' ELSE k END AS num FROM records)"""
PLACE = "('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT"
FACTORS = f"""{LABELLED}, sizes AS (SELECT quality AS q, count(*) AS n FROM labelled WHERE quality IS NOT NULL GROUP BY quality),
goal AS (SELECT min(n) AS low, max(n) AS high FROM sizes)"""


def _rebalanced(goal: str) -> str:
    return f"""WITH {FACTORS}, ranked AS (SELECT doc_id, quality, {goal} AS goal, n,
    row_number() OVER (PARTITION BY quality ORDER BY {PLACE}, doc_id) AS place
  FROM labelled LEFT JOIN sizes ON quality = q, goal),
copied AS (SELECT doc_id, quality, CASE WHEN quality IS NULL THEN 1 ELSE goal // n + (place <= goal % n)::INT END::BIGINT AS copies FROM ranked)"""


FIXED = f"""kept AS (SELECT * FROM turns WHERE NOT {blank('text')}),
spoken AS (SELECT conv_id, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM kept WHERE role <> 'system'),
bad AS (SELECT DISTINCT conv_id FROM spoken WHERE role = before AND role IN ('human', 'user', 'assistant', 'gpt'))"""

ORACLES = {
    "dedup_exact": "SELECT min(doc_id) AS doc_id, lang, source, md5(text) AS text_md5 FROM documents GROUP BY text, lang, source",
    "dedup_near": f"WITH {NUMBERED} SELECT doc_id, md5(text) AS text_md5 FROM numbered QUALIFY text IS NULL OR row_number() OVER (PARTITION BY {normal('text')} ORDER BY doc_id) = 1",
    "drop_leaked": f"""WITH d AS (SELECT doc_id, {normal('text')} AS k, {SPLIT} AS split FROM documents)
SELECT doc_id, split FROM d WHERE split = 'train' OR k IS NULL OR NOT EXISTS (SELECT 1 FROM d t WHERE t.split = 'train' AND t.k = d.k)""",
    "drop_empty": f"WITH {PLANTED} SELECT doc_id, md5(text) AS text_md5 FROM planted WHERE NOT {blank('text')}",
    "strip_tags": "SELECT page_id, md5(regexp_replace(html, '</?[^>]+>', ' ', 'g')) AS html_md5 FROM pages",
    "repair_text": f"WITH {PLANTED}, t AS (SELECT doc_id, text || '{BROKEN}' AS text FROM planted) SELECT doc_id, md5({_repaired('text')}) AS text_md5 FROM t",
    "within_budget": f"WITH {PLANTED} SELECT doc_id, md5(text) AS text_md5 FROM planted WHERE text IS NULL OR {tokens('text')} <= 512",
    "drop_empty_responses": f"WITH {PAIRED} SELECT conv_id, turn FROM pairs WHERE length(coalesce(output, '')) > 1",
    "coerce_mixed": f"""WITH {MIXED} SELECT k AS as_text, try_cast(k AS BIGINT) AS as_number, try_cast(num AS DOUBLE) AS as_double, count(*) AS rows
FROM mixed GROUP BY ALL""",
    "coerce_column": "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN o_orderkey END AS value FROM orders",
    "to_chat": f"""WITH {PAIRED}, asked AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 1 THEN instruction || chr(10) || chr(10) || 'see above' ELSE instruction END AS a, output AS b FROM pairs)
SELECT conv_id, turn, {_message('user', 'a')} || '|' || CASE WHEN b IS NULL THEN 'assistant' ELSE {_message('assistant', 'b')} END AS messages FROM asked
UNION ALL SELECT conv_id + 1000000, turn, CASE WHEN role = 'user' THEN {_message('user', 'text')} ELSE {_message('assistant', 'text')} END FROM conversations""",
    "fix_turns": f"""WITH {LINES}, {FIXED} SELECT conv_id AS doc_id, count(*)::INT AS turns FROM kept
WHERE conv_id NOT IN (SELECT conv_id FROM bad) GROUP BY conv_id""",
    "redact": _redacted(),
    "review_rows": f"""WITH {PAIRED}, r AS (SELECT conv_id, turn, concat_ws(',',
  CASE WHEN length(coalesce(output, '')) <= 1 THEN 'empty_response' END,
  CASE WHEN length(coalesce(output, '')) < 0.1::DOUBLE * length(instruction) AND length(instruction) > 50 THEN 'length_ratio' END,
  CASE WHEN length(instruction) < 20 THEN 'asks_little' END) AS reasons FROM pairs) SELECT * FROM r WHERE reasons <> ''""",
    "class_weights": f"WITH {FACTORS}, t AS (SELECT sum(n)::DOUBLE AS total, count(*)::DOUBLE AS k FROM sizes) SELECT q AS label, n AS rows, total / (k * n) AS weight FROM sizes, t",
    "undersample": f"{_rebalanced('low')} SELECT doc_id, quality FROM copied WHERE copies > 0",
    "oversample": f"{_rebalanced('high')} SELECT doc_id, quality, copies FROM copied",
    "chat_pack": """SELECT conv_id, string_agg(role || ':' || length(text) || ':' || md5(text), '|' ORDER BY turn) AS messages FROM conversations GROUP BY conv_id""",
    "chat_unpack": "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn, role, md5(text) AS text_md5 FROM conversations",
    "chat_from_value": f"""WITH {LINES}, per AS (SELECT conv_id, bool_or({blank('text')}) AS empty FROM turns GROUP BY conv_id),
spoken AS (SELECT conv_id, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM turns WHERE role <> 'system'),
bad AS (SELECT DISTINCT conv_id FROM spoken WHERE role = before AND role IN ('human', 'user', 'assistant', 'gpt'))
SELECT (SELECT count(*) FROM bad) AS broken_ordering_rows, count(*) FILTER (empty) AS empty_turn_rows FROM per""",
}
