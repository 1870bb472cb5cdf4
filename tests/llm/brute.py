"""Plain Python versions of the operators, and small tables with odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYLLABLES = "the on re er an ti ha st ou ea in is nd".split()
UPPER = {c: c + 32 for c in range(65, 91)}


def prose(rng: random.Random, n: int) -> str:
    made = []
    for _ in range(n):
        made.append("".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) + rng.choice(["", "", "", ",", ".", ".\n"]))
    return " ".join(made)


def documents(seed: int = 1, n: int = 40) -> list[tuple]:
    """doc_id, text, source, and columns whose names operators use themselves."""
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.choice([3, 12, 40, 120])), f"s{i % 4}") for i in range(n)]
    base = rows[5][1] + prose(rng, 60)
    rows += [(100 + i, base, "s0") for i in range(5)]
    rows += [(200 + i, base.replace(" ", f" x{i} ", 1), "s1") for i in range(5)]
    rows += [(300, None, None), (301, "", "s2"), (302, " \n\t ", "s2"), (303, "a", "s3"), (303, "a", "s3"), (304, prose(rng, 4000), "s1")]
    rows += [(305, "é\u2028 ÀÉ ñ\x1c\n\r\n Été à la plage tous les jours\n Été à la plage tous les jours", "s1"),
             (306, "  ÉTÉ à LA plage tous les jours\t\nété à la plage tous les jours", "s1")]
    rows += [(307, base, "s2"), (307, prose(rng, 20), "s2"), (None, base, "s3"), (None, prose(rng, 15), None)]
    return rows


def frame(spark, rows, name="doc_id"):
    df = spark.createDataFrame(rows, f"{name} bigint, text string, source string")
    return df.selectExpr("*", "1 AS n_words", "'x' AS kept", "2 AS n_lines", "3 AS start", "4 AS `quality`", "5 AS _n")


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def groups(rows, percent):
    """For each row (number of shingles, smallest id in reach)."""
    sets = [shingles(t) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return [(r[0], len(sets[i]), least.get(find(i))) for i, r in enumerate(rows)]


def line_dedup(rows):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(UPPER)
    holders = {}
    for i, t, _ in rows:
        for line in (t or "").split("\n"):
            holders.setdefault(key(line), set()).add(float("inf") if i is None else i)
    out = []
    for i, t, _ in rows:
        own = float("inf") if i is None else i
        all_lines = (t or "").split("\n")
        kept = [x for x in all_lines if len(key(x)) < 10 or own == min(holders[key(x)])]
        out.append((i, len(all_lines), len(all_lines) - len(kept), "\n".join(kept)))
    return out


def counts(text):
    t = text or ""
    w = WORD.findall(t)
    full = [x for x in t.split("\n") if WORD.search(x)]
    wins = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    many = {}
    for x in wins:
        many[x] = many.get(x, 0) + 1
    covered = {i + k for i, x in enumerate(wins) if many[x] > 1 for k in range(5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(full) - len(set(full)), len(covered)


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
