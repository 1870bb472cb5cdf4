"""URL rules by a bit-parallel wildcard automaton.

All glob rules are packed into one multiword Shift-And mask: a bit per character
of each rule. One step reads one byte of each URL of a batch and moves all
states of all rules with a shift, an AND and the self-loops of the wildcards.
`*` stands for any run without `/`, `**` for any run.

Results in odd cases
--------------------
- A null url, or one without `://`, has an empty host and path and fits no rule.
- Rules of equal length that fit: the first one given counts.
- Repeated rows and rows without an id are judged each.
- Extra columns are kept; the operator's own columns replace those of their name.
- An empty table gives an empty result. No rules: every verdict is the default.
- URLs of any length and any bytes are read to the end, or until no state is left.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowgauge.llm import common

ANY, SEGMENT = "**", "*"
Glob = tuple[str, ...]
BATCH = 4096
VERDICT = "rule string, verdict string"


def host(url: Column) -> Column:
    """From the first :// to the next of / ? # or the end, A-Z lower-cased."""
    return common.ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_rule(rule: str) -> list[Glob]:
    """A host and the start of a path: fits the host itself and all its subdomains."""
    return [(rule, ANY), (SEGMENT, "." + rule, ANY)]


def host_word(word: str) -> list[Glob]:
    """A word anywhere in the host."""
    return [(SEGMENT, word, SEGMENT), (SEGMENT, word, SEGMENT, "/", ANY)]


class Automaton:
    """Globs of literals, ANY and SEGMENT as masks over 64-bit words."""

    def __init__(self, globs: Sequence[Glob]):
        start, final, symbols, loops, at = [], [], [], [], 0
        for glob in globs:
            start.append(at)
            symbols.append(None)
            loops.append(None)
            for part in glob:
                if part in (ANY, SEGMENT):
                    loops[-1] = ANY if ANY in (part, loops[-1]) else SEGMENT
                else:
                    for byte in part.encode():
                        symbols.append(byte)
                        loops.append(None)
            at = len(symbols)
            final.append(at - 1)
        self.words = max(1, -(-at // 64))
        self.step = np.zeros((256, self.words), np.uint64)
        self.loop = np.zeros((256, self.words), np.uint64)
        for i, (byte, loop) in enumerate(zip(symbols, loops, strict=True)):
            word, bit = i // 64, np.uint64(1 << (i % 64))
            if byte is not None:
                self.step[byte, word] |= bit
            if loop:
                self.loop[:, word] |= bit
                if loop == SEGMENT:
                    self.loop[ord("/"), word] &= ~bit
        self.start = np.zeros(self.words, np.uint64)
        for i in start:
            self.start[i // 64] |= np.uint64(1 << (i % 64))
        self.final = [(i // 64, np.uint64(i % 64)) for i in final]

    def accepts(self, texts: list[bytes]) -> np.ndarray:
        """texts x globs, whether each glob fits the whole text."""
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        sizes = np.array([len(texts[i]) for i in order], np.int64)
        data = np.frombuffer(b"".join(texts[i] for i in order) + b"\0", np.uint8)
        at = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(order) else np.zeros(0, np.int64)
        state = np.tile(self.start, (len(order), 1))
        for k in range(int(sizes[0]) if len(order) else 0):
            live = int(np.searchsorted(-sizes, -k, side="left"))  # longer than k
            own = state[:live]
            if not own.any():
                break
            byte = data[at[:live] + k]
            moved = own << np.uint64(1)
            moved[:, 1:] |= own[:, :-1] >> np.uint64(63)
            state[:live] = (moved & self.step[byte]) | (own & self.loop[byte])
        hits = np.zeros((len(order), len(self.final)), bool)
        for j, (word, bit) in enumerate(self.final):
            hits[order, j] = (state[:, word] >> bit) & np.uint64(1)
        return hits


def judge_urls(
    df: DataFrame, rules: Sequence[tuple[str, str]], words: Sequence[str] = (),
    url_col: str = "url", default: str = "allow",
) -> DataFrame:
    """df with host, path, rule and verdict.

    rules: (verdict, rule), a rule being a host and the start of a path; the
    longest that fits gives the verdict. Where none fits, a url whose host holds
    one of `words` is blocked, and others get the default.
    """
    texts = [r for _, r in rules]
    globs = [(g, i) for i, rule in enumerate(texts) for g in host_rule(rule)]
    globs += [(g, len(texts)) for word in words for g in host_word(word)]
    owners = np.array([i for _, i in globs], np.int64)
    by_length = sorted(range(len(texts)), key=lambda i: (-len(texts[i]), i))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton([g for g, _ in globs])
        for whole in batches:
            for first in range(0, whole.num_rows, BATCH):
                batch = whole.slice(first, BATCH)
                names = batch.schema.names
                url = batch.column(names.index("_canonical")).cast(pa.binary()).to_pylist()
                hits = automaton.accepts(url) if globs else np.zeros((len(url), 0), bool)
                rule = np.full(len(url), -1)
                for i in reversed(by_length):
                    rule[hits[:, owners == i].any(axis=1)] = i
                blocked = hits[:, owners == len(texts)].any(axis=1)
                verdicts = [
                    rules[i][0] if i >= 0 else "block" if b else default for i, b in zip(rule.tolist(), blocked.tolist(), strict=True)
                ]
                kept = [n for n in names if n != "_canonical"]
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(names.index(n)) for n in kept],
                     pa.array([texts[i] if i >= 0 else None for i in rule.tolist()], pa.string()), pa.array(verdicts, pa.string())],
                    [*kept, "rule", "verdict"],
                )

    common.share_code(df.sparkSession)
    keep = [c for c in df.columns if c not in ("host", "path", "rule", "verdict", "_canonical")]
    cut = df.select(*keep, host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))
    schema = cut.schema.add("rule", "string").add("verdict", "string")
    return cut.withColumn("_canonical", F.concat("host", "path")).mapInArrow(run, schema)
