"""The checks: names, texts and advice."""

from __future__ import annotations

PASS, WARN, FAIL = "PASS", "WARN", "FAIL"

# --- Fixed values: category, name, effort and texts of every check -----------
# ``good`` is the text without findings, ``bad`` the text with some; one text
# serves both where ``bad`` is absent.
CHECKS = {
    "columns": {
        "category": "SCHEMA", "name": "Columns present", "effort": "small",
        "good": "{n} columns detected: {columns}",
    },
    "dtypes": {
        "category": "SCHEMA", "name": "Dtype consistency", "effort": "small",
        "good": "No mixed-type object columns detected.",
        "bad": "Mixed python types in: {columns}",
    },
    "exact_duplicates": {
        "category": "INTEGRITY", "name": "Exact duplicate rows", "effort": "trivial",
        "good": "{rows} exact duplicate rows ({pct}%).",
    },
    "near_duplicates": {
        "category": "INTEGRITY", "name": "Near-duplicate text ({column})", "effort": "small",
        "good": "{rows} rows duplicate after whitespace/case normalisation ({pct}%).",
    },
    "leakage": {
        "category": "INTEGRITY", "name": "Train/eval split leakage", "effort": "medium",
        "good": "No normalised overlap between train and eval splits.",
        "bad": "{rows} eval rows also appear in '{train}'. This inflates evaluation metrics.",
    },
    "empty_text": {
        "category": "QUALITY", "name": "Empty/whitespace text ({column})", "effort": "trivial",
        "good": "{rows} rows are empty or whitespace-only.",
    },
    "html": {
        "category": "QUALITY", "name": "HTML/XML bleed ({column})", "effort": "small",
        "good": "{rows} rows contain HTML/XML tags.",
    },
    "encoding": {
        "category": "QUALITY", "name": "Encoding artifacts ({column})", "effort": "small",
        "good": "{rows} rows show mojibake / replacement chars.",
    },
    "token_budget": {
        "category": "QUALITY", "name": "Token budget ({column})", "effort": "small",
        "good": "Max sample is {max} tokens (p99={p99}). Confirm this fits your context window.",
    },
    "format": {
        "category": "FORMAT", "name": "Instruction format", "effort": "medium",
        "good": "Detected format(s): {formats}",
    },
    "turn_order": {
        "category": "FORMAT", "name": "Chat turn ordering", "effort": "medium",
        "good": "{rows} conversations have broken role alternation.",
    },
    "empty_turns": {
        "category": "FORMAT", "name": "Empty conversation turns", "effort": "small",
        "good": "{rows} conversations contain an empty turn.",
    },
    "pii": {
        "category": "SAFETY", "name": "PII presence ({column})", "effort": "medium",
        "good": "No PII patterns matched.",
        "bad": "{rows} PII hits; most common: {worst} ({worst_rows} rows). "
        "Email/phone/SSN/IP/card patterns.",
    },
    "toxicity": {
        "category": "SAFETY", "name": "Toxicity surface flags ({column})", "effort": "medium",
        "good": "No keyword surface hits (does not prove the data is clean).",
        "bad": "{rows} rows hit the keyword surface scan. "
        "Keyword flag only - route to a classifier/human review.",
    },
    "empty_responses": {
        "category": "CONSISTENCY", "name": "Empty responses", "effort": "trivial",
        "good": "{rows} rows have an empty/near-empty output.",
    },
    "length_ratio": {
        "category": "CONSISTENCY", "name": "Instruction/response length ratio", "effort": "medium",
        "good": "{rows} rows have a response <10% the instruction length.",
    },
    "diversity": {
        "category": "COVERAGE", "name": "Lexical diversity ({column})", "effort": "large",
        "good": "Type-token ratio = {ttr} over {tokens} tokens. "
        "Very low TTR can signal templated/repetitive data.",
    },
    "class_balance": {
        "category": "COVERAGE", "name": "Class balance", "effort": "medium",
        "good": "No severe class imbalance detected.",
        "bad": "Severe imbalance in: {columns}",
    },
}

# What to do about a finding, as Spark code or as plain advice.
ADVICE = {
    "columns": "",
    "dtypes": "df.withColumn(c, F.col(c).cast('string'))  # or the type it should have",
    "exact_duplicates": "df.dropDuplicates()",
    "near_duplicates": "df.withColumn('k', F.md5(F.lower(F.trim(F.regexp_replace('{column}', "
    "r'\\s+', ' '))))).dropDuplicates(['k']).drop('k')",
    "leakage": "Anti-join the eval splits with the training split on the normalised text hash.",
    "empty_text": "df.filter(F.col('{column}').rlike(r'\\S'))",
    "html": "df.withColumn('{column}', F.regexp_replace('{column}', r'</?[^>]+>', ' '))",
    "encoding": "Decode the source again with its right charset; what remains needs a repair tool.",
    "token_budget": "df.filter(F.length('{column}') / 4 <= max_tokens)",
    "format": "",
    "format_generic": "Rename columns to a known instruction or chat layout before training.",
    "turn_order": "Make user and assistant alternate, starting with the user or system and user.",
    "empty_turns": "Remove or fill blank turns before applying a chat template.",
    "pii": "Redact matches before training, by pattern or with a dedicated tool.",
    "toxicity": "Score flagged rows with a classifier and review them before removing any.",
    "empty_responses": "df.filter(F.length('{column}') > 1)",
    "length_ratio": "Review by hand: a terse answer to a long instruction may be cut off.",
    "diversity": "Look for templated text; add more varied sources.",
    "class_balance": "{strategy}",
}

CHECK_SCHEMA = (
    "position int, check string, category string, name string, status string, "
    "affected_rows bigint, severity string, detail string, example_rows array<string>, "
    "fix string, effort string"
)
