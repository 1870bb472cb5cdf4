"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from rowgauge.llm import decontaminate, quality, secret_scan

SPACE = r"[\x20\x09-\x0D]"
#: The code points of the same set, for trim().
BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _quality() -> str:
    rules = range(len(quality.RULES))
    votes = ", ".join(
        f"CASE WHEN {r.bad} THEN -1 WHEN {r.good} THEN 1 ELSE 0 END AS v{j}" for j, r in enumerate(quality.RULES)
    )
    keys = ", ".join(f"v{j}" for j in rules)
    weight = "pi * " + " * ".join(f"CASE v{j} WHEN -1 THEN a{j} WHEN 1 THEN 1 - a{j} ELSE 1 END" for j in rules)
    first = ", ".join(
        f"({k}, {share}::DOUBLE, " + ", ".join(f"{r}::DOUBLE" for r in rates) + ")" for k, (share, rates) in enumerate(quality.start(len(rules)))
    )
    names = ", ".join(f"a{j}" for j in rules)
    steps = [f"m0(kind, pi, {names}) AS (VALUES {first})"]
    for k in range(1, quality.ROUNDS + 1):
        cast = "coalesce(sum(CASE WHEN v{0} <> 0 THEN n * q END), 0)"
        bad = "coalesce(sum(CASE WHEN v{0} < 0 THEN n * q END), 0)"
        each = ", ".join(
            f"({bad.format(j)} + {quality.WEIGHT} * {cast.format(j)} * any_value(m0.a{j}) + any_value(m0.a{j}))"
            f" / ({1 + quality.WEIGHT} * {cast.format(j)} + 1) AS a{j}"
            for j in rules
        )
        steps.append(f"w{k} AS (SELECT p.*, kind, {weight} AS w FROM patterns p, m{k - 1})")
        steps.append(f"q{k} AS (SELECT *, w / sum(w) OVER (PARTITION BY {keys}) AS q FROM w{k})")
        steps.append(
            f"m{k} AS MATERIALIZED (SELECT kind, (sum(n * q) / (SELECT sum(n) FROM patterns) + {quality.WEIGHT} * any_value(m0.pi)) / {1 + quality.WEIGHT} AS pi,"
            f" {each} FROM q{k} JOIN m0 USING (kind) GROUP BY kind)"
        )
    last = quality.ROUNDS
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT r, doc_id, t, list_filter(string_split_regex(t, '{SPACE}+'), lambda x: x <> '') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: trim(x, {BLANKS}) <> '') AS ls
  FROM d
), places AS (
  SELECT r, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w
), runs AS (
  SELECT r, i, x || ' ' || lead(x, 1) OVER o || ' ' || lead(x, 2) OVER o || ' ' || lead(x, 3) OVER o || ' ' || lead(x, 4) OVER o AS win
  FROM places WINDOW o AS (PARTITION BY r ORDER BY i)
), wins AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, win) AS c FROM runs WHERE win IS NOT NULL
), covered AS (
  SELECT r, count(DISTINCT i + k) AS n FROM wins, range(0, 5) x(k) WHERE c > 1 GROUP BY r
), counts AS (
  SELECT w.r, doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
    length(regexp_replace(t, '[^A-Z]', '', 'g'))::BIGINT AS n_capitals
  FROM w LEFT JOIN covered ON covered.r = w.r
), voted AS MATERIALIZED (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, {votes} FROM counts
), patterns AS MATERIALIZED (
  SELECT {keys}, count(*) AS n FROM voted GROUP BY {keys}
), {", ".join(steps)}, post AS (
  SELECT {keys}, sum(CASE WHEN kind = 0 THEN w END) / sum(w) AS good FROM (SELECT p.*, kind, {weight} AS w FROM patterns p, m{last}) GROUP BY {keys}
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND good >= 0.5 AS kept, round(good, 4) AS quality
FROM voted JOIN post USING ({keys})"""


def _decontamination() -> str:
    span, flank = len(decontaminate.MASKS[0]), decontaminate.FLANK

    def seeds(name: str, source: str, masks: tuple[str, ...], where: str) -> str:
        parts = []
        for m, mask in enumerate(masks):
            picked = " || ' ' || ".join(f"ws[i + {k}]" for k in range(len(mask)) if mask[k] == "1")
            parts.append(
                f"SELECT r, id, i, '{mask}' AS mask, {picked} AS seed FROM"
                f" (SELECT *, unnest(range(1, len(ws) - {len(mask) - 2})) AS i FROM {source} WHERE {where} AND len(ws) >= {len(mask)})"
            )
        return f"{name} AS (" + " UNION ALL ".join(parts) + ")"

    short = ("1" * decontaminate.SHORT,)
    words = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id AS id, {words} AS ws FROM documents
), b AS (
  SELECT row_number() OVER () AS r, item_id AS id, {words} AS ws FROM benchmark
),
{seeds("ds", "d", decontaminate.MASKS + short, "true")},
{seeds("bl", "b", decontaminate.MASKS, f"len(ws) >= {span}")},
{seeds("bs", "b", short, f"len(ws) < {span}")},
hits AS (
  SELECT DISTINCT ds.r AS dr, bb.r AS br, ds.i AS di, bb.i AS bi, length(ds.mask) AS span
  FROM ds JOIN (SELECT * FROM bl UNION ALL SELECT * FROM bs) bb ON ds.mask = bb.mask AND ds.seed = bb.seed
), sized AS (
  SELECT hits.*, d.id AS doc_id, b.id AS item_id, d.ws AS dw, b.ws AS bw,
    least({flank}, di - 1, bi - 1) AS before,
    least(span + {flank}, len(d.ws) - di + 1, len(b.ws) - bi + 1) AS after
  FROM hits JOIN d ON d.r = hits.dr JOIN b ON b.r = hits.br
), judged AS (
  SELECT *, len(list_filter(range(-before, after), lambda k: dw[(di + k)::BIGINT] = bw[(bi + k)::BIGINT])) AS same, before + after AS aligned
  FROM sized
), pairs AS (
  SELECT doc_id, item_id, di, bi, max(round(same / aligned, 4)) AS share FROM judged
  WHERE 10 * same >= {decontaminate.AGREE} * aligned GROUP BY ALL
)
SELECT doc_id, item_id, count(*) AS n_windows, (min(di) - 1)::BIGINT AS first_word, max(share) AS best_match
FROM pairs GROUP BY doc_id, item_id"""


def _secrets() -> str:
    quote = lambda p: p.replace("'", "''")
    patterns = (secret_scan.ASSIGN + secret_scan.VALUE, secret_scan.ACCESS, secret_scan.HEX, secret_scan.FREE)
    spans = " UNION ALL ".join(
        f"""SELECT r, doc_id, source, {k} AS k, i,
    list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS s,
    hits[i] AS hit
  FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM (
    SELECT r, doc_id, source, regexp_extract_all(t, '{quote(p)}') AS hits, string_split_regex(t, '{quote(p)}') AS gaps FROM d))"""
        for k, p in enumerate(patterns)
    )
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents
), found AS ({spans}), valued AS (
  SELECT r, doc_id, source, k, s::BIGINT AS s, (s + length(hit))::BIGINT AS e,
    CASE WHEN k = 0 THEN regexp_replace(hit, '^{quote(secret_scan.ASSIGN)}', '') ELSE hit END AS v
  FROM found
), fixed AS (
  SELECT * FROM valued WHERE (k = 0 AND length(v) >= 8) OR k IN (1, 2)
), free AS (
  SELECT * FROM valued f WHERE k = 3 AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[0-9]')
    AND NOT EXISTS (SELECT 1 FROM fixed x WHERE x.r = f.r AND x.s < f.e AND f.s < x.e)
), everything AS (SELECT * FROM fixed UNION ALL SELECT * FROM free),
owned AS (
  SELECT v, count(DISTINCT coalesce(source, chr(0))) AS owners FROM everything GROUP BY v
), told AS (
  SELECT e.*, owners <= 2 AS live, CASE k WHEN 0 THEN 'assign' WHEN 1 THEN 'access' WHEN 2 THEN 'hex' ELSE 'free' END || ':' || s || ':' || e.e AS name
  FROM everything e JOIN owned o ON o.v = e.v WHERE k < 3 OR owners <= 2
), per AS (
  SELECT r, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
    string_agg(name, ',' ORDER BY s, k) FILTER (k < 3) AS base, string_agg(name, ',' ORDER BY s, k) AS spans,
    count(*) FILTER (live) AS n_live
  FROM told GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live
FROM d LEFT JOIN per ON per.r = d.r"""


def _near_duplicates(percent: int) -> str:
    return f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id,
    list_filter(string_split_regex({LOWERED.format("coalesce(text, '')")}, '{SPACE}+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT r, array_to_string(ws[i:i + 4], ' ') AS x
  FROM (SELECT r, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM d WHERE len(ws) > 0)
), n AS (
  SELECT r, count(*) AS n FROM s GROUP BY r
), links AS (
  SELECT a, b FROM (SELECT p.r AS a, q.r AS b, count(*) AS i FROM s p JOIN s q ON p.x = q.x AND p.r <> q.r GROUP BY 1, 2)
  JOIN n na ON na.r = a JOIN n nb ON nb.r = b
  WHERE 100 * i >= {percent} * (na.n + nb.n - i)
), reach(r, o) AS (
  SELECT r, r FROM d
  UNION
  SELECT reach.r, links.b FROM reach JOIN links ON links.a = reach.o
), least_id AS (
  SELECT reach.r, min(o.doc_id) AS c FROM reach JOIN d o ON o.r = reach.o GROUP BY 1
)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, c AS component_id, doc_id = c AS kept
FROM d JOIN least_id ON least_id.r = d.r LEFT JOIN n ON n.r = d.r"""


LINES = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents
), k AS (
  SELECT *, {LOWERED.format(f"trim(line, {BLANKS})")} AS key FROM d
), o AS (
  SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (owner <> doc_id) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (owner IS NULL OR owner = doc_id), '')) AS kept_sha256
FROM k LEFT JOIN o USING (key)
GROUP BY r, doc_id"""

URLS = f"""
WITH u AS (
  SELECT page_id, {LOWERED.format("regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)")} AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), j AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR suffix(host, '.www.example.com')) AND prefix(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND prefix(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR suffix(host, '.com')) AND prefix(path, '/') THEN 'com/' END AS rule
  FROM u
)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN regexp_matches(host, 'spam|pills|casino|porn|viagra') THEN 'block' ELSE 'allow' END AS verdict
FROM j"""

COLLOCATIONS = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang, {LOWERED.format("coalesce(text, '')")} AS t FROM documents
), p AS (
  SELECT r, lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) AS piece,
    generate_subscripts(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]'), 1) AS i FROM d
), w AS (
  SELECT r, lang, i, unnest(ws) AS w, generate_subscripts(ws, 1) AS j
  FROM (SELECT r, lang, i, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM p)
), g AS (
  SELECT lang, w AS w1, w || ' ' || lead(w, 1) OVER o AS w2, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o AS w3,
    w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o AS w4
  FROM w WINDOW o AS (PARTITION BY r, i ORDER BY j)
), f AS MATERIALIZED (
  SELECT lang, phrase, len(string_split(phrase, ' ')) AS size, count(*) AS n
  FROM (SELECT lang, unnest([w1, w2, w3, w4]) AS phrase FROM g) WHERE phrase IS NOT NULL
  GROUP BY ALL HAVING count(*) >= 30
), total AS (
  SELECT lang, count(*) AS n FROM w GROUP BY lang
), cuts AS (
  SELECT lang, phrase, n AS a, k, array_to_string(ws[:k], ' ') AS lhs, array_to_string(ws[k + 1:], ' ') AS rhs
  FROM (SELECT *, string_split(phrase, ' ') AS ws, unnest(range(1, size)) AS k FROM f WHERE size > 1)
), scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.n AS l, y.n AS r, (2000000 * c.a::HUGEINT // (x.n + y.n))::BIGINT AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.lhs JOIN f y ON y.lang = c.lang AND y.phrase = c.rhs
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), longer AS (
  SELECT lang, phrase, max(n) AS n FROM (
    SELECT lang, unnest([array_to_string(ws[2:], ' '), array_to_string(ws[:-2], ' ')]) AS phrase, n
    FROM (SELECT lang, string_split(phrase, ' ') AS ws, n FROM f WHERE size > 2)
  ) GROUP BY ALL
), ranked AS (
  SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank
  FROM lowest s LEFT JOIN longer o ON o.lang = s.lang AND o.phrase = s.phrase
  WHERE o.n IS NULL OR 100 * o.n < 80 * a
)
SELECT lang, rank, phrase, a, l, r, total.n AS n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000"""

ORACLES: dict[str, str] = {
    "op1_quality_rules": _quality(),
    "op4_decontamination": _decontamination(),
    "op5_secret_scan": _secrets(),
    "op6_url_filter": URLS,
    "op7_near_dup": _near_duplicates(85),
    "op9_line_dedup": LINES,
    "op12_collocations": COLLOCATIONS,
}
