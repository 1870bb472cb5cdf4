"""SQL for the registered queries, written for DuckDB."""

from __future__ import annotations

WS_SET = (
    r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
WS, NOT_WS = f"[{WS_SET}]", f"[^{WS_SET}]"
W, NOT_W = r"[\p{L}\p{N}_]", r"[^\p{L}\p{N}_]"
START, END = rf"(?:\A|{NOT_W})", rf"(?:{NOT_W}|\z)"

HTML = r"</?[a-zA-Z][^>]{0,200}>"
# --- Fixed values: patterns and words of the checks --------------------------------
MOJIBAKE = r"Ã©|Ã¨|Ã¶|Ã¼|â€™|â€œ|â€\x{9d}|â€“|Â |�"
ODD_WS = rf"[ \t]{{3,}}|\n{{4,}}|\A{WS}|{WS}\z"
EMAIL = (
    rf"(?:{START}[A-Za-z0-9_]|{W}[.%+\-])[A-Za-z0-9._%+\-]*@[A-Za-z0-9.\-]+\.[A-Za-z]{{2,}}{END}"
)
PHONE = (
    rf"(?:\+?\p{{Nd}}{{1,3}}[{WS_SET}.\-]?)?(?:\(\p{{Nd}}{{2,4}}\)[{WS_SET}.\-]?)?"
    rf"\p{{Nd}}{{3}}[{WS_SET}.\-]\p{{Nd}}{{3,4}}[{WS_SET}.\-]?\p{{Nd}}{{0,4}}"
)
SSN = START + r"\p{Nd}{3}-\p{Nd}{2}-\p{Nd}{4}" + END
IPV4 = START + r"(?:\p{Nd}{1,3}\.){3}\p{Nd}{1,3}" + END
CARD = r"\b(?:[0-9][ \-]?){13,16}\b"


def has(c: str, pattern: str) -> str:
    return f"coalesce(regexp_matches({c}, '{pattern}'), false)"


def blank(c: str) -> str:
    return f"({c} IS NULL OR NOT regexp_matches({c}, '{NOT_WS}'))"


def normal(c: str) -> str:
    return f"lower(trim(regexp_replace({c}, '{WS}+', ' ', 'g')))"


def tokens(c: str) -> str:
    return f"greatest(1, round_even(length({c}) / 4.0, 0)::BIGINT)::BIGINT"


def luhn(c: str) -> str:
    digits = f"list_transform(regexp_extract_all({c}, '{CARD}'), lambda m: regexp_replace(m, '[^0-9]', '', 'g'))"
    total = (
        "list_sum(list_transform(range(1, length(d) + 1), lambda i: "
        "CASE WHEN (length(d) - i) % 2 = 1 THEN "
        "CASE WHEN 2 * d[i]::INT > 9 THEN 2 * d[i]::INT - 9 ELSE 2 * d[i]::INT END "
        "ELSE d[i]::INT END))"
    )
    return f"coalesce(len(list_filter({digits}, lambda d: {total} % 10 = 0)) > 0, false)"


def keyword(c: str, words: list[str]) -> str:
    def one(word):
        body = "".join(ch if ch.isalnum() or ch == " " else "\\" + ch for ch in word)
        left = START if word[0].isalnum() else W
        right = END if word[-1].isalnum() else W
        return left + body + right

    return has(f"lower({c})", "|".join(one(w) for w in words))


# --- Fixed values: keyword lists -----------------------------------------------------
KEYWORDS = {
    "profanity": ["fuck", "shit", "bitch", "asshole", "bastard"],
    "violence": ["kill", "murder", "bomb", "shoot", "stab", "attack"],
    "self_harm": ["suicide", "self-harm", "kill myself"],
}
CORPUS_WORDS = {"short": ["the", "und", "les"], "longer": ["ththe", "worthless", "c++", "est"]}


def quality(c: str) -> dict[str, str]:
    return {
        "empty_or_whitespace": blank(c),
        "html_bleed": has(c, HTML),
        "encoding_artifacts": has(c, MOJIBAKE),
        "whitespace_anomalies": has(c, ODD_WS),
    }


def pii(c: str) -> dict[str, str]:
    return {
        "email": has(c, EMAIL),
        "phone": has(c, PHONE),
        "ssn": has(c, SSN),
        "ipv4": has(c, IPV4),
        "credit_card": luhn(c),
    }


def all_flags(c: str) -> dict[str, str]:
    found = dict(quality(c))
    found.update({f"pii_{k}": v for k, v in pii(c).items()})
    found.update({f"toxicity_{k}": keyword(c, w) for k, w in KEYWORDS.items()})
    return found


def select_flags(flags: dict[str, str]) -> str:
    return ", ".join(f"{v} AS {k}" for k, v in flags.items())


def count_flags(flags: dict[str, str]) -> str:
    return ", ".join(f"count(*) FILTER ({v})::BIGINT AS {k}" for k, v in flags.items())


def pct(part: str, whole: str) -> str:
    return f"coalesce({near(f'100.0::DOUBLE * ({part}) / nullif(({whole}), 0)', 2)}, 0.0)"


def near(expr: str, digits: int) -> str:
    """The nearest decimal of the double, ties to even."""
    return f"(round_even(({expr})::DOUBLE * 1e{digits}, 0)::DOUBLE / 1e{digits})"


def quantile(values: str, p: float) -> str:
    """Linear interpolation in a sorted list, measured from the nearer end."""
    at = f"({p}::DOUBLE * (len({values}) - 1))"
    low, high = f"{values}[floor({at})::BIGINT + 1]::DOUBLE", f"{values}[ceil({at})::BIGINT + 1]::DOUBLE"
    share = f"({at} - floor({at}))"
    return (
        f"CASE WHEN {share} >= 0.5 THEN {high} - ({high} - {low}) * (1 - {share}) "
        f"ELSE {low} + ({high} - {low}) * {share} END"
    )


SPLIT = (
    "CASE WHEN source IN ('src0', 'src1', 'src2') THEN 'test' "
    "WHEN source IN ('src3', 'src4') THEN 'validation' ELSE 'train' END"
)
LABELLED = (
    "labelled AS (SELECT d.doc_id, text, lang, source, "
    "CASE WHEN lang <> 'en' OR quality IS NOT NULL THEN n_chars END AS n_chars, quality, toxic "
    "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"
)
PLANTED = """planted AS (SELECT doc_id, CASE source
  WHEN 'src0' THEN '  ' || text
  WHEN 'src1' THEN text || ' cafÃ©'
  WHEN 'src2' THEN text || '   tail'
  WHEN 'src3' THEN '<p>' || text || '</p>'
  WHEN 'src4' THEN '   '
  WHEN 'src5' THEN NULL
  WHEN 'src6' THEN text || ' SSN 123-45-6789.'
  WHEN 'src7' THEN repeat('over and over again, ', 30) || text
  WHEN 'src8' THEN 'Kill it. ' || text
  WHEN 'src9' THEN text || ' Self-Harm'
  WHEN 'src10' THEN text || ' '
  WHEN 'src11' THEN text || ' card 4111 1111 1111 1111 and 10.1.2.3'
  ELSE text END AS text, lang, source FROM documents)"""
COPIES = (
    "copies AS (SELECT text, lang, source FROM documents UNION ALL "
    "SELECT ' ' || replace(replace(text, ' ', ' \t '), 'e', 'E'), lang, source FROM documents)"
)
PAIRED = (
    "pairs AS (SELECT a.conv_id, a.turn + 1 AS turn, a.text AS instruction, "
    "CASE WHEN length(b.text) > 300 THEN substr(b.text, 1, 3) ELSE b.text END AS output "
    "FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id "
    "AND b.turn = a.turn + 1 AND b.role = 'assistant' WHERE a.role = 'user')"
)
SHUFFLED = (
    "turns AS (SELECT conv_id, turn, "
    "CASE WHEN role = 'assistant' AND length(text) < 120 THEN 'user' ELSE role END AS role, "
    "CASE WHEN length(text) > 400 AND role = 'user' THEN ' \n' ELSE text END AS text "
    "FROM conversations)"
)
LINES = (
    "lines AS (SELECT doc_id, generate_subscripts(string_split(text, '\n'), 1) AS turn, "
    "unnest(string_split(text, '\n')) AS content FROM documents), "
    "turns AS (SELECT doc_id AS conv_id, turn, content AS text, "
    "CASE WHEN turn = 1 AND starts_with(content, 'T') THEN 'system' "
    "WHEN length(content) < 40 THEN 'user' ELSE 'assistant' END AS role FROM lines)"
)
TURN_FLAGS = f"""spoken AS (SELECT conv_id, role,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before
  FROM turns WHERE role <> 'system'),
bad AS (SELECT DISTINCT conv_id FROM spoken
  WHERE role = before AND role IN ('human', 'user', 'assistant', 'gpt')),
turn_flags AS (SELECT t.conv_id,
    bool_or(b.conv_id IS NOT NULL) AS broken_ordering,
    bool_or({blank('t.text')}) AS empty_turn
  FROM turns t LEFT JOIN bad b ON t.conv_id = b.conv_id GROUP BY t.conv_id)"""
PRICED = (
    "priced AS (SELECT l_quantity, l_extendedprice, l_discount, l_tax, "
    "l_extendedprice * (1 - l_discount) AS net_price, 100.0::DOUBLE - l_quantity AS quantity_left "
    "FROM lineitem)"
)
PRICED_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "net_price", "quantity_left"]


def _links() -> str:
    i = "page_id::VARCHAR"
    made = [
        "url", "url || '.csv'", "url || '/x.JSONL.gz'",
        f"'s3://bucket/p' || {i} || '.parquet'", f"'gs://bucket/p' || {i}",
        f"'https://github.com/owner/repo/blob/main/p' || {i} || '.csv'",
        f"'https://github.com/owner/repo/p' || {i}",
        f"'https://raw.githubusercontent.com/owner/repo/p' || {i} || '.json'",
        f"'https://huggingface.co/datasets/owner/d' || {i}",
        f"'/data/p' || {i} || '.tsv.gz'", f"'file:///data/p' || {i} || '.json'",
        f"' HTTPS://acct.blob.core.windows.net/c/p' || {i} || '.parquet '",
        f"'https://b.s3.amazonaws.com/p' || {i} || '.txt'", f"'ftp://host/p' || {i} || '.gz'",
    ]
    return f"links AS (SELECT page_id, unnest([{', '.join(made)}]) AS link FROM pages)"


SOURCE_MANIFEST = rf"""WITH {_links()},
parts AS (SELECT *, trim(link) AS l, lower(trim(link)) AS low FROM links),
facts AS (SELECT *, regexp_replace(low, '\.gz$', '') AS stem,
    lower(regexp_extract(l, '^([a-zA-Z][a-zA-Z0-9+.\-]*):', 1)) AS scheme,
    contains(low, 'github.com') AND contains(l, '/blob/') AS blob FROM parts),
named AS (SELECT *, coalesce(nullif(regexp_extract(stem, '\.(csv|tsv|json|jsonl|parquet)$', 1), ''),
    'unknown') AS file_format FROM facts),
kinds AS (SELECT *, CASE
    WHEN scheme IN ('', 'file') THEN 'local'
    WHEN contains(low, 'huggingface.co/datasets/') THEN 'huggingface'
    WHEN blob OR contains(low, 'raw.githubusercontent.com') THEN 'github'
    WHEN scheme IN ('s3', 'gs') OR contains(low, 'amazonaws.com')
      OR contains(low, 'storage.googleapis.com') OR contains(low, 'blob.core.windows.net') THEN 'cloud'
    WHEN file_format <> 'unknown' THEN 'direct_file' ELSE 'unknown' END AS source_type FROM named)
SELECT page_id, link, source_type,
  CASE WHEN source_type = 'github' AND blob
    THEN replace(replace(l, 'github.com', 'raw.githubusercontent.com'), '/blob/', '/')
    ELSE l END AS resolved_url,
  file_format, CASE WHEN low LIKE '%.gz' THEN 'gzip' ELSE 'none' END AS compression,
  CASE WHEN source_type = 'github' AND blob THEN 'Converted GitHub blob URL to raw URL.'
    WHEN source_type = 'huggingface' THEN 'Will load via the `datasets` library.'
    WHEN source_type = 'cloud' THEN 'Cloud object storage URL.'
    WHEN source_type = 'unknown' THEN 'Could not infer a supported file format from the URL.'
    ELSE '' END AS notes
FROM kinds"""


def _flag_counts() -> str:
    parts = []
    for c in ("text", "source"):
        for flag, expr in all_flags(c).items():
            parts.append((c, flag, expr))
    body = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{flag}' AS flag, count(*) FILTER ({expr})::BIGINT AS rows FROM planted"
        for c, flag, expr in parts
    )
    return f"WITH {PLANTED} {body}"


def _quality_select(c: str, source: str) -> str:
    return (
        f"SELECT '{c}' AS \"column\", count({c})::BIGINT AS count, "
        f"min(length({c}))::BIGINT AS min_chars, max(length({c}))::BIGINT AS max_chars, "
        f"{near(f"avg(length({c}))", 1)} AS mean_chars, {count_flags(quality(c))} FROM {source}"
    )


REPETITIVE = f"""words AS (SELECT doc_id,
    list_filter(regexp_split_to_array(text, '{WS}+'), lambda x: x <> '') AS toks FROM planted),
grams AS (SELECT doc_id, unnest(list_transform(range(1, len(toks) - 1),
    lambda i: toks[i] || ' ' || toks[i + 1] || ' ' || toks[i + 2])) AS gram
  FROM words WHERE len(toks) >= 9),
gram_counts AS (SELECT doc_id, gram, count(*) AS n FROM grams GROUP BY doc_id, gram),
repetitive AS (SELECT doc_id FROM gram_counts GROUP BY doc_id
  HAVING max(n)::DOUBLE / sum(n) > 0.3)"""

OPENING = (
    rf"regexp_replace(regexp_extract(text, '\A{WS}*((?:{NOT_WS}+{WS}+){{0,7}}{NOT_WS}+)', 1), "
    rf"'{WS}+', ' ', 'g')"
)

LABELLED_COLUMNS = {
    "doc_id": "bigint", "text": "string", "lang": "string", "source": "string",
    "n_chars": "bigint", "quality": "int", "toxic": "int",
}
LINEITEM_COLUMNS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]


def _schema_report() -> str:
    return f"WITH {LABELLED} " + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{t}' AS dtype, count({c})::BIGINT AS non_null, "
        f"count(*) FILTER ({c} IS NULL)::BIGINT AS null_count, "
        f"{pct(f'count(*) FILTER ({c} IS NULL)', 'count(*)')} AS null_pct, "
        f"count(DISTINCT {c})::BIGINT AS \"unique\" FROM labelled"
        for c, t in LABELLED_COLUMNS.items()
    )


def _missingness() -> str:
    return f"WITH {LABELLED} " + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL)::BIGINT AS null_count, "
        f"{pct(f'count(*) FILTER ({c} IS NULL)', 'count(*)')} AS null_pct FROM labelled"
        for c in LABELLED_COLUMNS
    )


def _co_missing() -> str:
    names = list(LABELLED_COLUMNS)
    masks = ", ".join(f"({c} IS NULL)::INT::DOUBLE AS {c}" for c in names)
    pairs = " UNION ALL ".join(
        f"SELECT '{a}' AS col_a, '{b}' AS col_b, "
        f"CASE WHEN stddev_samp({a}) > 0 AND stddev_samp({b}) > 0 THEN corr({a}, {b}) END AS r FROM masks"
        for i, a in enumerate(names) for b in names[i + 1 :]
    )
    return (
        f"WITH {LABELLED}, masks AS (SELECT {masks} FROM labelled), pairs AS ({pairs}) "
        f"SELECT col_a, col_b, {near('r', 2)} AS corr FROM pairs WHERE abs(r) >= 0.5"
    )


def _cardinality(columns, source: str, cte: str = "") -> str:
    rows = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(DISTINCT {c})::BIGINT AS u, count(*) AS n FROM {source}"
        for c in columns
    )
    lead = f"WITH {cte}, " if cte else "WITH "
    return (
        f"{lead}counted AS ({rows}) SELECT \"column\", u AS \"unique\", "
        f"{near('u::DOUBLE / n', 4)} AS unique_ratio, (u::DOUBLE / n >= 0.9 AND n > 1) AS high_cardinality, "
        "u <= 1 AS constant FROM counted"
    )


def _balance(columns, source: str, cte: str = "") -> str:
    cells = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {c}::VARCHAR AS label FROM {source}" for c in columns
    )
    lead = f"WITH {cte}, " if cte else "WITH "
    return f"""{lead}cells AS ({cells}),
totals AS (SELECT "column", count(*) AS total FROM cells GROUP BY 1),
classes AS (SELECT "column", label, count(*) AS n FROM cells WHERE label IS NOT NULL GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, label) AS first,
    row_number() OVER (PARTITION BY "column" ORDER BY n, label DESC) AS last,
    count(*) OVER (PARTITION BY "column") AS k FROM classes),
ends AS (SELECT "column", max(k) AS k,
    max(CASE WHEN first = 1 THEN label END) AS a, max(CASE WHEN first = 1 THEN n END) AS an,
    max(CASE WHEN last = 1 THEN label END) AS b, max(CASE WHEN last = 1 THEN n END) AS bn
  FROM ranked WHERE k BETWEEN 2 AND 50 GROUP BY 1)
SELECT e."column", k::BIGINT AS classes, a AS majority_label, an::BIGINT AS majority_count,
  {pct('an', 'total')} AS majority_pct, b AS minority_label, bn::BIGINT AS minority_count,
  {pct('bn', 'total')} AS minority_pct, {near('an::DOUBLE / bn', 2)} AS imbalance_ratio,
  CASE WHEN an::DOUBLE / bn < 1.5 THEN 'balanced' WHEN an::DOUBLE / bn < 10 THEN 'moderate_imbalance'
    ELSE 'severe_imbalance' END AS verdict,
  CASE WHEN an::DOUBLE / bn < 1.5 THEN 'none'
    WHEN an::DOUBLE / bn < 10 THEN 'class weights or mild oversampling'
    ELSE 'oversample minority / undersample majority / focal loss' END AS recommended_strategy
FROM ends e JOIN totals t ON e."column" = t."column\""""


def _outliers(columns, source: str, cte: str, row_id: str | None) -> str:
    parts = []
    for c in columns:
        stats = (
            f"(SELECT quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.75) AS q3, "
            f"avg({c}::DOUBLE) AS m, stddev_samp({c}::DOUBLE) AS s FROM {source}) st"
        )
        low, high = "q1 - 1.5 * (q3 - q1)", "q3 + 1.5 * (q3 - q1)"
        out = f"({c} < {low} OR {c} > {high})"
        ids = (
            f", nullif(array_to_string(list_slice(list({row_id} ORDER BY {row_id}) FILTER ({out}), 1, 5), ','), '') "
            "AS example_rows" if row_id else ""
        )
        parts.append(
            f"SELECT '{c}' AS \"column\", count(*) FILTER ({out})::BIGINT AS iqr_outliers, "
            f"count(*) FILTER (abs({c} - m) / s > 3.0)::BIGINT AS zscore_outliers{ids} "
            f"FROM {source}, {stats}"
        )
    lead = f"WITH {cte} " if cte else ""
    return lead + " UNION ALL ".join(parts)


def _correlation() -> str:
    pairs = " UNION ALL ".join(
        f"SELECT '{a}' AS col_a, '{b}' AS col_b, corr({a}, {b}) AS r FROM priced"
        for i, a in enumerate(PRICED_COLUMNS) for b in PRICED_COLUMNS[i + 1 :]
    )
    return (
        f"WITH {PRICED}, pairs AS ({pairs}) "
        f"SELECT col_a, col_b, {near('r', 3)} AS correlation FROM pairs WHERE abs(r) >= 0.8"
    )


def _tokens_select(c: str, source: str) -> str:
    qs = ", ".join(f"{near(quantile('l', p / 100), 1)} AS p{p}" for p in (5, 25, 50, 75, 95, 99))
    return (
        f"SELECT '{c}' AS \"column\", 'estimate(char/4)' AS tokenizer, len(l)::BIGINT AS count, "
        f"l[1] AS min, l[-1] AS max, {near('list_sum(l)::DOUBLE / len(l)', 1)} AS mean, {qs}, "
        f"list_sum(l)::BIGINT AS total_tokens FROM (SELECT list({tokens(c)} ORDER BY {tokens(c)}) AS l "
        f"FROM {source} WHERE {c} IS NOT NULL)"
    )


HISTOGRAM = f"""WITH k AS (SELECT {tokens('text')} AS t FROM documents WHERE text IS NOT NULL),
s AS (SELECT min(t)::DOUBLE AS low, max(t)::DOUBLE AS high, least(12, count(DISTINCT t)) AS bins FROM k),
edges AS (SELECT i, CASE WHEN i = bins THEN high ELSE low + i * ((high - low) / bins) END AS e,
    CASE WHEN i = 0 THEN low - (high - low) * 0.001 WHEN i = bins THEN high
      ELSE low + i * ((high - low) / bins) END AS shown, bins
  FROM s, range(0, 13) r(i) WHERE i <= bins),
bins AS (SELECT b.i AS bin, a.e AS a, b.e AS b, a.shown AS sa, b.shown AS sb
  FROM edges a JOIN edges b ON b.i = a.i + 1),
counts AS (SELECT bin, count(*) AS n FROM k JOIN bins
  ON (t > a OR bin = 1) AND (t <= b) GROUP BY bin)
SELECT bins.bin::BIGINT AS bin,
  trunc(round(sa, 3))::BIGINT::VARCHAR || '-' || trunc(round(sb, 3))::BIGINT::VARCHAR AS range,
  coalesce(n, 0)::BIGINT AS count
FROM bins LEFT JOIN counts ON bins.bin = counts.bin"""


def _vocabulary_select(c: str, source: str) -> str:
    return f"""SELECT '{c}' AS "column",
  (SELECT count({c}) FROM {source})::BIGINT AS sampled_rows, coalesce(sum(n), 0)::BIGINT AS total_tokens,
  count(*)::BIGINT AS unique_tokens,
  coalesce({near('count(*)::DOUBLE / sum(n)', 4)}, 0.0) AS ttr
FROM (SELECT lower(w) AS w, count(*) AS n FROM
  (SELECT unnest(regexp_extract_all({c}, '{W}+')) AS w FROM {source}) GROUP BY 1)"""


MIXED = """WITH e AS (SELECT event_type AS t, json_extract_string(props, '$.k') AS k FROM events),
r AS (SELECT json('{"k": ' || CASE WHEN t = 'view' THEN '"' || k || '"' WHEN t = 'error' THEN 'true' ELSE k END
    || ', "num": ' || CASE WHEN t = 'click' THEN k || '.5' ELSE k END
    || ', "o": {"p": ' || CASE WHEN t = 'signup' THEN '{"z": 1}' ELSE k END
    || '}, "l": ' || CASE WHEN t = 'purchase' THEN 'null' ELSE '[' || k || ']' END || '}') AS j FROM e),
cells AS (SELECT 'k' AS c, json_type(j, '$.k') AS t FROM r UNION ALL
  SELECT 'num', json_type(j, '$.num') FROM r UNION ALL
  SELECT 'o.p', json_type(j, '$.o.p') FROM r UNION ALL
  SELECT 'l', json_type(j, '$.l') FROM r),
kinds AS (SELECT DISTINCT c, CASE t WHEN 'UBIGINT' THEN 'int' WHEN 'BIGINT' THEN 'int' WHEN 'DOUBLE' THEN 'float'
    WHEN 'VARCHAR' THEN 'str' WHEN 'BOOLEAN' THEN 'bool' WHEN 'ARRAY' THEN 'list' WHEN 'OBJECT' THEN 'dict' END AS kind
  FROM cells WHERE t <> 'NULL')
SELECT c AS "column", string_agg(kind, ',' ORDER BY kind) AS observed_types FROM kinds
GROUP BY c HAVING count(*) > 1 AND count(*) FILTER (kind NOT IN ('int', 'float')) > 0"""

_HASHED = f"SELECT {SPLIT} AS split, md5({normal('text')}) AS h FROM documents"
LEAKAGE = f"""WITH h AS ({_HASHED}),
train AS (SELECT DISTINCT h FROM h WHERE split = 'train' AND h IS NOT NULL)
SELECT split, count(t.h)::BIGINT AS leaked_rows, {pct('count(t.h)', 'count(*)')} AS leaked_pct
FROM h LEFT JOIN train t ON h.h = t.h WHERE split <> 'train' GROUP BY split"""


def _evidence_cte(flags: dict[str, str], source: str) -> str:
    hits = " UNION ALL ".join(
        f"SELECT '{k}' AS \"check\", doc_id FROM {source} WHERE {v}" for k, v in flags.items()
    )
    return (
        f"hits AS ({hits}), proof AS (SELECT \"check\", doc_id AS row_id, position FROM (SELECT *, "
        "row_number() OVER (PARTITION BY \"check\" ORDER BY doc_id)::BIGINT AS position FROM hits) WHERE position <= 5)"
    )


def _column_summary() -> str:
    parts = []
    for c in ("text", "source"):
        q = quality(c)
        hits = " + ".join(f"count(*) FILTER ({v})" for v in pii(c).values())
        parts.append(
            f"SELECT '{c}' AS \"column\", {pct(f'count(*) FILTER ({c} IS NULL)', 'count(*)')} AS null_pct, "
            f"floor({near(f'quantile_cont({tokens(c)}, 0.5) FILTER ({c} IS NOT NULL)', 1)})::BIGINT AS median_tokens, "
            f"max({tokens(c)}) FILTER ({c} IS NOT NULL) AS max_tokens, "
            f"(sum({tokens(c)}) FILTER ({c} IS NOT NULL))::BIGINT AS total_tokens, "
            f"count(*) FILTER ({q['empty_or_whitespace']})::BIGINT AS empty_cells, "
            f"count(*) FILTER ({q['html_bleed']})::BIGINT AS html_bleed, "
            f"count(*) FILTER ({q['encoding_artifacts']})::BIGINT AS encoding_artifacts, "
            f"count(*) FILTER ({q['whitespace_anomalies']})::BIGINT AS whitespace_anomalies, "
            f"({hits})::BIGINT AS pii_hits FROM planted"
        )
    return f"WITH {PLANTED} " + " UNION ALL ".join(parts)


def _checks_ctes() -> str:
    """The checks of the documents' training split, one row each."""
    q, p = quality("text"), pii("text")
    tox = {k: keyword("text", w) for k, w in KEYWORDS.items()}
    p_cols = ", ".join(f"count(*) FILTER ({v}) AS p_{k}" for k, v in p.items())
    t_cols = ", ".join(f"count(*) FILTER ({v}) AS t_{k}" for k, v in tox.items())
    q_cols = ", ".join(f"count(*) FILTER ({v}) AS q_{k}" for k, v in q.items())
    p_sum = " + ".join(f"p_{k}" for k in p)
    t_sum = " + ".join(f"t_{k}" for k in tox)
    worst = "CASE " + " ".join(f"WHEN p_{k} = w THEN '{k}'" for k in p) + " END"

    def examples(flags):
        cases = " ".join(
            f"WHEN count(*) FILTER ({v}) > 0 THEN array_to_string(list_slice("
            f"list(doc_id ORDER BY doc_id) FILTER ({v}), 1, 5), ',')"
            for v in flags.values()
        )
        return f"CASE {cases} ELSE '' END"

    def one(flag):
        return examples({"x": flag})

    def row(category, name, bad, status, severity, rows, detail, ex, effort):
        return (
            f"SELECT '{category}' AS category, '{name}' AS name, "
            f"CASE WHEN {bad} THEN '{status}' ELSE 'PASS' END AS status, ({rows})::BIGINT AS affected_rows, "
            f"CASE WHEN {bad} THEN {severity} ELSE 'INFO' END AS severity, {detail} AS detail, "
            f"{ex} AS example_rows, '{effort}' AS effort FROM facts"
        )

    def n(c):
        return f"({c})::VARCHAR"

    dup_pct = pct("exact", "n") + "::VARCHAR"
    near_pct = pct("near", "n") + "::VARCHAR"
    rows = [
        row("SCHEMA", "Columns present", "false", "FAIL", "'HIGH'", "0",
            "'4 columns detected: text, lang, source, n_chars'", "''", "small"),
        row("SCHEMA", "Dtype consistency", "false", "FAIL", "'HIGH'", "0",
            "'No mixed-type object columns detected.'", "''", "small"),
        row("INTEGRITY", "Exact duplicate rows", "exact > 0", "FAIL",
            "CASE WHEN exact > 0.01 * n THEN 'HIGH' ELSE 'MEDIUM' END", "exact",
            f"{n('exact')} || ' exact duplicate rows (' || {dup_pct} || '%).'", "''", "trivial"),
        row("INTEGRITY", "Near-duplicate text (text)", "near > 0", "WARN", "'MEDIUM'", "near",
            f"{n('near')} || ' rows duplicate after whitespace/case normalisation (' || {near_pct} || '%).'",
            "''", "small"),
        row("INTEGRITY", "Train/eval split leakage", "leaked > 0", "FAIL", "'CRITICAL'", "leaked",
            f"CASE WHEN leaked > 0 THEN {n('leaked')} || ' eval rows also appear in ''train''. "
            "This inflates evaluation metrics.' "
            "ELSE 'No normalised overlap between train and eval splits.' END", "''", "medium"),
        row("QUALITY", "Empty/whitespace text (text)", "q_empty_or_whitespace > 0", "FAIL", "'HIGH'",
            "q_empty_or_whitespace",
            f"{n('q_empty_or_whitespace')} || ' rows are empty or whitespace-only.'", "x_empty", "trivial"),
        row("QUALITY", "HTML/XML bleed (text)", "q_html_bleed > 0", "WARN", "'MEDIUM'", "q_html_bleed",
            f"{n('q_html_bleed')} || ' rows contain HTML/XML tags.'", "x_html", "small"),
        row("QUALITY", "Encoding artifacts (text)", "q_encoding_artifacts > 0", "WARN", "'MEDIUM'",
            "q_encoding_artifacts",
            f"{n('q_encoding_artifacts')} || ' rows show mojibake / replacement chars.'", "x_moji", "small"),
        row("QUALITY", "Token budget (text)", "mx > 8192", "WARN", "'MEDIUM'", "0",
            f"'Max sample is ' || {n('mx')} || ' tokens (p99=' || {n('p99')} || '). "
            "Confirm this fits your context window.'", "''", "small"),
        row("FORMAT", "Instruction format", "false", "WARN", "'LOW'", "0",
            "'Detected format(s): plain_text'", "''", "medium"),
        row("SAFETY", "PII presence (text)", f"{p_sum} > 0", "FAIL", "'CRITICAL'", p_sum,
            f"CASE WHEN {p_sum} > 0 THEN {n(p_sum)} || ' PII hits; most common: ' || ({worst}) || ' (' || "
            f"{n('w')} || ' rows). Email/phone/SSN/IP/card patterns.' ELSE 'No PII patterns matched.' END",
            "x_pii", "medium"),
        row("SAFETY", "Toxicity surface flags (text)", f"{t_sum} > 0", "WARN", "'HIGH'", t_sum,
            f"CASE WHEN {t_sum} > 0 THEN {n(t_sum)} || ' rows hit the keyword surface scan. "
            "Keyword flag only - route to a classifier/human review.' "
            "ELSE 'No keyword surface hits (does not prove the data is clean).' END", "x_tox", "medium"),
        row("COVERAGE", "Lexical diversity (text)", "ttr > 0 AND ttr < 0.05", "WARN", "'LOW'", "0",
            f"'Type-token ratio = ' || {n('ttr')} || ' over ' || {n('total_tokens')} || ' tokens. "
            "Very low TTR can signal templated/repetitive data.'", "''", "large"),
        row("COVERAGE", "Class balance", "severe <> ''", "WARN", "'MEDIUM'", "0",
            "CASE WHEN severe <> '' THEN 'Severe imbalance in: ' || severe "
            "ELSE 'No severe class imbalance detected.' END", "''", "medium"),
    ]
    greatest_p = ", ".join(f"p_{k}" for k in p)
    return f"""train AS (SELECT * FROM documents WHERE {SPLIT} = 'train'),
flags AS (SELECT count(*) AS n, {q_cols}, {p_cols}, {t_cols},
    max({tokens('text')}) AS mx, {near(quantile("list(" + tokens('text') + " ORDER BY " + tokens('text') + ")", 0.99), 1)} AS p99,
    {one(q['empty_or_whitespace'])} AS x_empty, {one(q['html_bleed'])} AS x_html,
    {one(q['encoding_artifacts'])} AS x_moji, {examples(p)} AS x_pii, {examples(tox)} AS x_tox FROM train),
dups AS (SELECT (SELECT count(*) FROM train)
      - (SELECT count(*) FROM (SELECT DISTINCT text, lang, source, n_chars FROM train)) AS exact,
    (SELECT count(text) - count(DISTINCT {normal('text')}) FROM train) AS near),
leak AS (SELECT sum(leaked_rows)::BIGINT AS leaked FROM ({LEAKAGE})),
voc AS ({_vocabulary_select('text', 'train')}),
balance AS ({_balance(['lang', 'source', 'n_chars', 'text'], 'train')}),
sev AS (SELECT coalesce(string_agg("column", ', ' ORDER BY CASE "column" WHEN 'text' THEN 1 WHEN 'lang' THEN 2
    WHEN 'source' THEN 3 ELSE 4 END), '') AS severe FROM balance WHERE verdict = 'severe_imbalance'),
facts AS (SELECT *, greatest({greatest_p}) AS w FROM flags, dups, leak, voc, sev),
checks AS ({' UNION ALL '.join(rows)})"""


CHECKS = _checks_ctes()
SCORES = f"""{CHECKS},
costs AS (SELECT category, (CASE severity WHEN 'CRITICAL' THEN 60 WHEN 'HIGH' THEN 30 WHEN 'MEDIUM' THEN 15
    WHEN 'LOW' THEN 6 ELSE 0 END) * (CASE status WHEN 'FAIL' THEN 1.0 WHEN 'WARN' THEN 0.5 ELSE 0.0 END) AS cost
  FROM checks),
dims AS (SELECT * FROM (VALUES ('Completeness', 0.20, ['SCHEMA', 'INTEGRITY']),
    ('Quality', 0.25, ['QUALITY', 'CONSISTENCY']), ('Format', 0.20, ['FORMAT']),
    ('Safety', 0.20, ['SAFETY']), ('Diversity', 0.15, ['COVERAGE'])) d(dimension, weight, cats)),
scores AS (SELECT dimension, weight, greatest(0, 100 - coalesce(sum(cost), 0))::DECIMAL(10,1) AS score
  FROM dims LEFT JOIN costs ON list_contains(cats, category) GROUP BY dimension, weight),
total AS (SELECT round_even(sum(score * weight)::DOUBLE, 1) AS overall,
    (SELECT count(*) FROM checks WHERE status = 'FAIL')::BIGINT AS fail,
    (SELECT count(*) FROM checks WHERE status = 'WARN')::BIGINT AS warn,
    (SELECT count(*) FROM checks WHERE status = 'PASS')::BIGINT AS pass,
    (SELECT count(*) FROM checks WHERE status = 'FAIL' AND severity = 'CRITICAL')::BIGINT AS critical,
    (SELECT count(*) FROM checks WHERE status <> 'PASS' AND severity = 'HIGH')::BIGINT AS high FROM scores)"""


def rating(c: str) -> str:
    return (
        f"CASE WHEN {c} >= 90 THEN 'Excellent' WHEN {c} >= 75 THEN 'Good' "
        f"WHEN {c} >= 50 THEN 'Needs Work' ELSE 'Critical' END"
    )


DOCS = "SELECT doc_id, text, lang, source, n_chars FROM documents"
BAD_RATIO = "length(coalesce(output, '')) < 0.1::DOUBLE * length(instruction) AND length(instruction) > 50"

ORACLES = {
    "source_manifest": SOURCE_MANIFEST,
    "csv_scan": DOCS,
    "tsv_scan": "SELECT * EXCLUDE (o_orderstatus, o_orderdate), "
    "CASE WHEN o_orderstatus <> 'F' THEN o_orderstatus END AS status FROM orders",
    "json_document_scan": "SELECT doc_id, text FROM documents",
    "jsonl_scan": "SELECT doc_id, lang AS meta_lang, source AS meta_source, text, n_chars FROM documents",
    "parquet_scan": DOCS,
    "split_union": "SELECT doc_id, text, 'train' AS split, NULL::BIGINT AS item_id FROM documents UNION ALL "
    "SELECT NULL, text, 'test', item_id FROM benchmark",
    "sketched_cardinality": " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(DISTINCT {c})::BIGINT AS exact, true AS near FROM documents" for c in ("doc_id", "text", "source", "n_chars")
    ),
    "sketched_quantiles": "SELECT c AS \"column\", p::DOUBLE AS share, true AS near FROM (SELECT unnest(['n_chars', 'doc_id']) AS c), "
    "(SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.95, 0.99]) AS p)",
    "own_flags": "SELECT doc_id, len(string_split(text, ' '))::BIGINT AS tokens, len(string_split(text, ' ')) > 300 AS over_budget, "
    "contains(text, '!') AS exclaims, regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}_])(he|she|it)($|[^\\p{L}\\p{N}_])') AS toxicity_pronouns FROM documents",
    "row_positions": "SELECT md5(text) AS text_md5, lang, source FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 450 OFFSET 100)",
    "row_range": "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang "
    "ORDER BY doc_id) AS r FROM documents) WHERE r BETWEEN 11 AND 60",
    "split_metadata": f"SELECT {SPLIT} AS split, count(*)::BIGINT AS rows, 5::BIGINT AS cols, "
    "round(sum(8 + strlen(text) + strlen(lang) + strlen(source) + 8)::DOUBLE / 1e6, 2) AS data_mb "
    "FROM documents GROUP BY 1",
    "primary_split": f"SELECT doc_id, 'train' AS split FROM documents WHERE {SPLIT} = 'train'",
    "report_sink": f"WITH {CHECKS} SELECT category, name, status, affected_rows, severity FROM checks",
    "normalised_text": f"WITH {COPIES} SELECT md5({normal('text')}) AS key, count(*)::BIGINT AS rows "
    "FROM copies GROUP BY 1",
    "row_flags": f"WITH {PLANTED}, {REPETITIVE} SELECT p.doc_id, length(text)::BIGINT AS chars, "
    f"CASE WHEN text IS NOT NULL THEN {tokens('text')} END AS tokens, {select_flags(all_flags('text'))}, "
    f"coalesce({tokens('text')} > 8192 AND text IS NOT NULL, false) AS over_budget, r.doc_id IS NOT NULL AS repetitive "
    "FROM planted p LEFT JOIN repetitive r ON p.doc_id = r.doc_id",
    "flag_counts": _flag_counts(),
    "stream_flag_counts": _flag_counts(),
    "text_quality": f"WITH {PLANTED} " + _quality_select("text", "planted"),
    "html_pages": _quality_select("url", "pages") + " UNION ALL " + _quality_select("html", "pages"),
    "pii_by_source": f"SELECT source, {count_flags(pii('text'))} FROM documents GROUP BY source",
    "pii_counts": f"WITH {PLANTED} " + " UNION ALL ".join(
        f"SELECT '{k}' AS label, count(*) FILTER ({v})::BIGINT AS rows FROM planted"
        for k, v in pii("text").items()
    ),
    "toxicity": f"WITH {PLANTED} SELECT lang, "
    + count_flags({k: keyword("text", w) for k, w in {**KEYWORDS, **CORPUS_WORDS}.items()})
    + " FROM planted GROUP BY lang",
    "over_budget": f"SELECT doc_id, {tokens('text')} AS tokens, {tokens('text')} > 512 AS over_budget FROM documents",
    "repetition": f"WITH {PLANTED}, {REPETITIVE} SELECT 'text' AS \"column\", count(text)::BIGINT AS count, "
    "(SELECT count(*) FROM repetitive)::BIGINT AS repetitive_rows FROM planted",
    "openings": f"WITH {COPIES} SELECT {OPENING} AS opening, count(*)::BIGINT AS rows FROM copies "
    "GROUP BY 1 HAVING count(*) > 1 AND opening <> '' ORDER BY rows DESC, opening LIMIT 10",
    "opening_words": f"WITH {PLANTED} SELECT doc_id, {OPENING} AS opening FROM planted",
    "text_columns": f"WITH {LABELLED} " + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c})::BIGINT AS count, {near(f"avg(length({c}))", 1)} AS mean_chars "
        f"FROM labelled HAVING avg(length({c})) >= 12" for c in ("text", "lang", "source")
    ),
    "schema_report": _schema_report(),
    "missingness": _missingness(),
    "fully_empty_rows": f"WITH {LABELLED} SELECT count(*) FILTER (quality IS NULL AND doc_id % 3 = 0)::BIGINT "
    "AS fully_empty_rows FROM labelled",
    "correlated_missingness": _co_missing(),
    "cardinality": _cardinality(LABELLED_COLUMNS, "labelled", LABELLED),
    "cardinality_lineitem": _cardinality(LINEITEM_COLUMNS, "lineitem"),
    "cardinality_nested": _cardinality(
        ["embedding", "label", "pair", "entries"], "made",
        "made AS (SELECT embedding, label, coalesce(label::VARCHAR, '') || '/' || vec_id % 7 AS pair, 'ab' AS entries FROM embeddings)",
    ),
    "class_balance": _balance(LABELLED_COLUMNS, "labelled", LABELLED),
    "class_balance_lineitem": _balance(LINEITEM_COLUMNS, "lineitem"),
    "duplicates": f"WITH {COPIES}, c AS (SELECT (SELECT count(*) FROM copies) AS n, "
    "(SELECT count(*) FROM (SELECT DISTINCT * FROM copies)) AS rows, "
    f"(SELECT count(text) - count(DISTINCT {normal('text')}) FROM copies) AS near) "
    f"SELECT 'exact' AS kind, '' AS \"column\", (n - rows)::BIGINT AS duplicate_rows, {pct('n - rows', 'n')} "
    f"AS duplicate_pct FROM c UNION ALL SELECT 'near', 'text', near::BIGINT, {pct('near', 'n')} FROM c",
    "dtype_consistency": MIXED,
    "split_leakage": LEAKAGE,
    "outliers": _outliers(["user_id", "value"], "events", "", "event_id"),
    "outliers_lineitem": _outliers(PRICED_COLUMNS, "priced", PRICED, None),
    "correlation": _correlation(),
    "token_distribution": f"WITH {PLANTED} " + _tokens_select("text", "planted") + " UNION ALL "
    + _tokens_select("source", "planted"),
    "token_histogram": HISTOGRAM,
    "vocabulary": f"WITH {PLANTED} " + _vocabulary_select("text", "planted") + " UNION ALL "
    + _vocabulary_select("source", "planted"),
    "format_detection": f"WITH {PAIRED} SELECT 'documents' AS table_name, 'plain_text' AS formats, "
    "count(*)::BIGINT AS rows FROM documents UNION ALL SELECT 'pairs', 'alpaca', count(*) FROM pairs UNION ALL "
    "SELECT 'line_chats', 'chatml', count(*) FROM documents UNION ALL "
    "SELECT 'orders', 'generic_tabular', count(*) FROM orders UNION ALL "
    "SELECT 'question_answer', 'qa', count(*) FROM pairs",
    "turn_order_nested": f"WITH {LINES}, {TURN_FLAGS} SELECT count(*) FILTER (broken_ordering)::BIGINT "
    "AS broken_ordering_rows, count(*) FILTER (empty_turn)::BIGINT AS empty_turn_rows FROM turn_flags",
    "chat_flags_nested": f"WITH {LINES}, {TURN_FLAGS} SELECT conv_id AS doc_id, broken_ordering, empty_turn "
    "FROM turn_flags",
    "turn_order_long": f"WITH {SHUFFLED}, {TURN_FLAGS} SELECT conv_id, broken_ordering, empty_turn FROM turn_flags",
    "response_checks": f"WITH {PAIRED} SELECT count(*) FILTER (length(coalesce(output, '')) <= 1)::BIGINT "
    f"AS empty_responses, count(*) FILTER ({BAD_RATIO})::BIGINT AS length_ratio_rows FROM pairs",
    "evidence": f"WITH {PLANTED}, {_evidence_cte(quality('text'), 'planted')} SELECT * FROM proof",
    "flagged_rows": f"WITH {PLANTED}, {_evidence_cte(quality('text'), 'planted')} "
    "SELECT p.doc_id, text, lang, source, \"check\" FROM planted p JOIN proof ON p.doc_id = proof.row_id",
    "column_summary": _column_summary(),
    "checks": f"WITH {CHECKS} SELECT * FROM checks",
    "checks_mixed": """WITH kinds AS (SELECT count(DISTINCT CASE event_type WHEN 'view' THEN 's' WHEN 'error' THEN 'b' ELSE 'i' END) AS k,
  count(DISTINCT event_type = 'signup') AS p FROM events),
found AS (SELECT concat_ws(', ', CASE WHEN k > 1 THEN 'k' END, CASE WHEN p > 1 THEN 'o.p' END) AS c, (k > 1)::INT + (p > 1)::INT AS n FROM kinds)
SELECT 'Columns present' AS name, 'PASS' AS status, 0::BIGINT AS affected_rows, 'INFO' AS severity,
  '4 columns detected: k, l, num, o.p' AS detail
UNION ALL SELECT 'Dtype consistency', CASE WHEN n > 0 THEN 'FAIL' ELSE 'PASS' END, n::BIGINT,
  CASE WHEN n > 0 THEN 'HIGH' ELSE 'INFO' END,
  CASE WHEN n > 0 THEN 'Mixed python types in: ' || c ELSE 'No mixed-type object columns detected.' END FROM found""",
    "checks_chat": f"""WITH {LINES}, {TURN_FLAGS},
f AS (SELECT count(*) FILTER (broken_ordering) AS b, count(*) FILTER (empty_turn) AS e,
  coalesce(array_to_string(list_slice(list(conv_id ORDER BY conv_id) FILTER (broken_ordering), 1, 5), ','), '') AS bx,
  coalesce(array_to_string(list_slice(list(conv_id ORDER BY conv_id) FILTER (empty_turn), 1, 5), ','), '') AS ex FROM turn_flags)
SELECT 'Instruction format' AS name, 'PASS' AS status, 0::BIGINT AS affected_rows, 'INFO' AS severity, '' AS example_rows
UNION ALL SELECT 'Chat turn ordering', CASE WHEN b > 0 THEN 'FAIL' ELSE 'PASS' END, b, CASE WHEN b > 0 THEN 'HIGH' ELSE 'INFO' END, bx FROM f
UNION ALL SELECT 'Empty conversation turns', CASE WHEN e > 0 THEN 'WARN' ELSE 'PASS' END, e, CASE WHEN e > 0 THEN 'MEDIUM' ELSE 'INFO' END, ex FROM f""",
    "checks_pairs": f"""WITH {PAIRED}, f AS (SELECT
    count(*) FILTER (length(coalesce(output, '')) <= 1) AS e, count(*) FILTER ({BAD_RATIO}) AS r,
    coalesce(array_to_string(list_slice(list(conv_id * 1000 + turn ORDER BY conv_id * 1000 + turn)
      FILTER ({BAD_RATIO}), 1, 5), ','), '') AS x FROM pairs)
SELECT 'Instruction format' AS name, 'PASS' AS status, 0::BIGINT AS affected_rows, 'INFO' AS severity,
  'Detected format(s): alpaca' AS detail, '' AS example_rows
UNION ALL SELECT 'Empty responses', CASE WHEN e > 0 THEN 'FAIL' ELSE 'PASS' END, e,
  CASE WHEN e > 0 THEN 'HIGH' ELSE 'INFO' END, e::VARCHAR || ' rows have an empty/near-empty output.', '' FROM f
UNION ALL SELECT 'Instruction/response length ratio', CASE WHEN r > 0 THEN 'WARN' ELSE 'PASS' END, r,
  CASE WHEN r > 0 THEN 'LOW' ELSE 'INFO' END,
  r::VARCHAR || ' rows have a response <10% the instruction length.', x FROM f""",
    "score_dimensions": f"WITH {SCORES} SELECT dimension, score::DOUBLE AS score, weight::DOUBLE AS weight, "
    f"{rating('score')} AS rating FROM scores",
    "score_overall": f"WITH {SCORES} SELECT overall, {rating('overall')} AS overall_rating, fail, warn, pass, "
    "critical, high FROM total",
    "gate": f"WITH {SCORES} SELECT critical = 0 AND overall >= 75 AS passed, "
    "CASE WHEN critical > 0 THEN 'critical check failed' WHEN overall < 75 THEN 'overall score is below the limit' "
    "ELSE '' END AS reason FROM total",
    "issues": f"WITH {CHECKS} SELECT severity, status, category, name, affected_rows FROM checks WHERE status <> 'PASS'",
}
