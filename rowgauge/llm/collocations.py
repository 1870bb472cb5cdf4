"""Phrase collocation mining, counted in HAT-tries.

A task counts phrases in a trie over word ids whose first level holds hash
containers: a container maps the rest of a phrase to its count, and one that grows
too large bursts into a node of smaller containers, one per next word. Containers
of pairs are hybrid, each for a range of first words. When a task
holds too many entries its largest subtrees leave as sorted runs, each under its
prefix. Runs are shuffled by buckets of prefixes, a row for each bucket and language
whatever the number of prefixes, and merged there phrase by phrase, so what a task
holds is bounded, prefixes are stored once a run, and every count is exact.

Phrases are counted by length: words, then two words, then three and four. A
phrase counts at least `least` only if all shorter ones inside it do, so each pass
breaks pieces at what the one before it ruled out. It learns that from a bit map
of 2^26 bits (8 MB at any size) with a bit for every phrase that is frequent
enough: a bit too many costs work, none is ever missing.

Results in odd cases
--------------------
- A null or empty text has no words; a null lang is `und`.
- Repeated rows and rows without an id are counted each; ids are never looked at.
- Extra columns are ignored, whatever their names.
- An empty table gives an empty result.
- Ties: equal cuts by the shorter first part, equal scores by count, then phrase.
- A prefix that holds more than a thousandth of all words is merged in parts, by
  the hash of what follows it.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowgauge.llm import common

LONGEST = 4
#: Ends of pieces, as bytes; the first stands for all.
ENDERS = [bytes([b]) for b in b".,;:!?\n\x0b\x0c\r"]
ENDS = r"[\x20\x09.,;:!?\x0A-\x0D]+"
#: Bits of a word number in an entry's key; Limits.words + 2 * Limits.batch numbers fit.
WIDTH = 21
#: First words of a container of pairs, as a power of 2.
SPAN = 8


@dataclass(frozen=True)
class Limits:
    """What a task holds at once; none of it changes a result."""

    bits: int = 2**26  #: of the map of frequent phrases
    entries: int = 1_200_000  #: of a trie before subtrees leave
    burst: int = 4_096  #: entries of a container before it bursts
    words: int = 500_000  #: that a task has numbers for
    batch: int = 750_000  #: words looked at together
    hot: int = 1000  #: a prefix with more than one in `hot` of all words is merged in parts
    parts: int = 64
    buckets: int = 2048  #: of prefixes, that runs are shuffled by


COUNTED = "lang string, phrase string, size int, n bigint"


#: What a pair's mark is made of: its first word's mark times this, plus its second's.
TIMES = 65_599


def marked(lang: str, word: str) -> int:
    return zlib.crc32(f"{lang}\t{word}".encode("utf-8", "surrogatepass"))


def bit_map(counted: DataFrame, bits: int) -> bytes:
    """The bits of words or of pairs; at most bits / 64 rows reach the driver."""
    mark = lambda w: F.crc32(F.concat_ws("\t", "lang", w).cast("binary"))
    words = F.split("phrase", " ")
    bit = F.when(F.size(words) == 1, mark(words[0])).otherwise(mark(words[0]) * TIMES + mark(F.get(words, 1))) % bits
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))
    rows = counted.select(F.floor(bit / 64).cast("int").alias("slot"), one.alias("bit"))
    got = rows.groupBy("slot").agg(F.bit_or("bit").alias("bits")).toArrow()
    held = np.zeros(bits // 64, "<i8")
    held[got.column("slot").to_numpy()] = got.column("bits").to_numpy()
    return held.tobytes()


def tokens_of(text: str) -> list[bytes]:
    """Words and ends of pieces, with A-Z in lower case. Methods of bytes know ASCII
    alone: lower() A-Z, split() the white space [\\x20\\x09-\\x0D]."""
    data = text.encode("utf-8", "surrogatepass").lower()
    for end in ENDERS:
        if end in data:
            data = data.replace(end, b" . ")
    return data.split()


class HatTrie:
    """Counts of phrases of word numbers: first words, then containers of the rest.

    The rest is one integer, WIDTH bits a word from the high end on, 0 for no word.
    With a span, a container is for 2 ** span first words, whose low bits come first
    in its keys; there must be room for them.
    """

    def __init__(self, depth: int, burst: int, span: int = 0):
        self.depth, self.burst, self.span = depth, burst, span
        self.low = WIDTH * (depth - 1)
        self.root: dict[int, Counter | dict] = {}
        self.sizes: Counter = Counter()

    def __len__(self) -> int:
        return sum(self.sizes.values())

    def add(self, first: np.ndarray, rest: np.ndarray) -> None:
        if not len(first):
            return
        if self.span:
            whole = np.sort(first << self.low | rest)
            top, keys = whole >> (self.low + self.span), whole & (2 ** (self.low + self.span) - 1)
        else:
            order = np.lexsort((rest, first))
            top, keys = first[order], rest[order]
        starts = np.flatnonzero(np.append(True, top[1:] != top[:-1]))
        for start, stop in zip(starts.tolist(), np.append(starts[1:], len(top)).tolist(), strict=True):
            self._add(int(top[start]), keys[start:stop])

    def _add(self, at: int, keys: np.ndarray) -> None:
        held = self.root.get(at)
        if held is None:
            held = self.root[at] = Counter()
        if isinstance(held, Counter):
            before = len(held)
            held.update(keys.tolist())
            self.sizes[at] += len(held) - before
            if len(held) > self.burst and self.depth > 2:
                node: dict[int, Counter] = {}
                shift = WIDTH * (self.depth - 2)
                for key, n in held.items():
                    node.setdefault(key >> shift, Counter())[key] = n
                self.root[at] = node
            return
        nexts = keys >> (WIDTH * (self.depth - 2))
        starts = np.flatnonzero(np.append(True, nexts[1:] != nexts[:-1]))
        for start, stop in zip(starts, np.append(starts[1:], len(keys)), strict=True):
            inner = held.get(int(nexts[start]))
            if inner is None:
                inner = held[int(nexts[start])] = Counter()
            before = len(inner)
            inner.update(keys[start:stop].tolist())
            self.sizes[at] += len(inner) - before

    def take(self, chosen: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Remove whole subtrees: first words, keys of the rest in order, counts."""
        held, owner = [], []
        for at in chosen:
            del self.sizes[at]
            top = self.root.pop(at)
            inner = [top] if isinstance(top, Counter) else list(top.values())
            held += inner
            owner += [at] * len(inner)
        sizes = np.array([len(c) for c in held], np.int64)
        n = int(sizes.sum())
        first = np.repeat(np.array(owner, np.int64), sizes)
        keys = np.fromiter(chain.from_iterable(held), np.int64, n)
        counts = np.fromiter(chain.from_iterable(c.values() for c in held), np.int64, n)
        if self.span:
            whole = first << (self.low + self.span) | keys
            order = np.argsort(whole)
            whole = whole[order]
            return whole >> self.low, whole & (2**self.low - 1), counts[order]
        order = np.lexsort((keys, first))
        return first[order], keys[order], counts[order]

    def largest(self, leave: int) -> list[int]:
        """The subtrees to spill, largest first, so that `leave` entries stay."""
        over, chosen = len(self) - leave, []
        for word, n in self.sizes.most_common():
            if over <= 0:
                break
            chosen.append(word)
            over -= n
        return chosen


class Numbers(dict):
    """word, as bytes -> its number in one language; 0 if it is ruled out or ends a piece."""

    def __init__(self, lang: str, number: int, words: list[bytes], lang_numbers: list[int], marks: list[int], allowed: np.ndarray, room: int):
        super().__init__(dict.fromkeys(ENDERS, 0))
        self.number, self.words, self.lang_numbers, self.marks, self.allowed, self.room = number, words, lang_numbers, marks, allowed, room
        self.ruled_out, self.of_lang = 0, marked(lang, "")

    def __missing__(self, word: bytes) -> int:
        mark = zlib.crc32(word, self.of_lang)
        bit = mark % (8 * len(self.allowed))
        if self.allowed[bit >> 3] >> (bit & 7) & 1:
            number = self[word] = len(self.words)
            self.words.append(word)
            self.lang_numbers.append(self.number)
            self.marks.append(mark)
            return number
        self.ruled_out += 1
        if self.ruled_out > self.room:
            kept = {w: n for w, n in self.items() if n or w in ENDERS}
            self.clear()
            self.update(kept)
            self.ruled_out = 0
        self[word] = 0
        return 0


class Miner:
    """A task's trie over phrases of two words, or of three and four."""

    def __init__(
        self, sizes: tuple[int, ...], words_allowed: bytes, pairs_allowed: bytes | None, hot: set[tuple[str, str]], limits: Limits
    ):
        self.pairs, self.hot, self.limits = max(sizes) == 2, hot, limits
        self.allowed = memoryview(words_allowed)
        self.pairs_allowed = None if pairs_allowed is None else np.frombuffer(pairs_allowed, np.uint8)
        self.trie = HatTrie(max(sizes), limits.burst, SPAN if self.pairs else 0)
        self.forget()

    def forget(self) -> None:
        #: Of each word number: the word, its language's place in `known`, its mark.
        self.words, self.lang_numbers, self.marks = [b""], [-1], [0]
        self.known: dict[str, Numbers] = {}

    def read(self, texts: list[str | None], langs: list[str | None]) -> Iterator[pa.RecordBatch]:
        """Count the phrases of texts; yields the runs that had to leave."""
        ids: list[int] = []
        size = self.limits.batch
        for text, lang in zip(texts, langs, strict=True):
            lang = "und" if lang is None else lang
            tokens = tokens_of(text or "")
            # A long text goes in parts; each begins again with the last words of the one before.
            for start in range(0, len(tokens), size):
                known = self._numbers(lang)
                ids.extend(map(known.__getitem__, tokens[max(0, start - LONGEST + 1) : start + size]))
                if start + size < len(tokens):
                    yield from self._count(ids, LONGEST - 1)
                    ids = []
            ids.append(0)
            if len(ids) >= size:
                yield from self._count(ids)
                ids = []
        yield from self._count(ids)

    def _numbers(self, lang: str) -> Numbers:
        if lang not in self.known:
            self.known[lang] = Numbers(lang, len(self.known), self.words, self.lang_numbers, self.marks, self.allowed, self.limits.words)
        return self.known[lang]

    def _count(self, ids: list[int], overlap: int = 0) -> Iterator[pa.RecordBatch]:
        """Phrases that begin in ids, the last `overlap` of which come again."""
        begins = len(ids) - overlap
        a = np.array(ids + [0] * LONGEST, np.int64)
        w = [a[k : k + begins] for k in range(LONGEST)]
        if self.pairs:
            whole = (w[0] > 0) & (w[1] > 0)
            self.trie.add(w[0][whole], w[1][whole])
        else:
            good = self._pairs(a)
            three = good[:begins] & good[1 : begins + 1]
            fourth = np.where(good[2 : begins + 2], w[3], 0)
            rest = (w[1] << (2 * WIDTH)) | (w[2] << WIDTH) | fourth
            self.trie.add(w[0][three], rest[three])
        if len(self.words) > self.limits.words:
            yield from self.spill(0)
            self.forget()
        elif len(self.trie) > self.limits.entries:
            yield from self.spill(self.limits.entries // 2)

    def _pairs(self, a: np.ndarray) -> np.ndarray:
        """Which neighbours in a may be a frequent pair."""
        marks = np.array(self.marks, np.int64)[a]
        bit = (marks[:-1] * TIMES + marks[1:]) % (8 * len(self.pairs_allowed))
        return (a[:-1] > 0) & (a[1:] > 0) & ((self.pairs_allowed[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1).astype(bool)

    def spill(self, leave: int) -> Iterator[pa.RecordBatch]:
        """Runs of the largest subtrees, so that `leave` entries stay."""
        chosen, some, n = self.trie.largest(leave), [], 0
        for at in chosen:
            some.append(at)
            n += self.trie.sizes[at]
            if n >= 400_000 or at == chosen[-1]:
                yield self._runs(*self.trie.take(some))
                some, n = [], 0

    def _hot(self) -> np.ndarray:
        """The hot prefixes as numbers."""
        got = []
        for lang, prefix in self.hot:
            known = self.known.get(lang, {})
            numbers = [known.get(w, 0) for w in prefix.encode("utf-8", "surrogatepass").split(b" ")]
            if all(numbers):
                got.append(numbers[0] if self.pairs else numbers[0] << WIDTH | numbers[1])
        return np.array(got, np.int64)

    def _runs(self, first: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        """One row per bucket and language, with its prefixes, what follows each in order and how often."""
        words = pa.array(self.words, pa.binary()).cast(pa.string())
        low = 2**WIDTH - 1
        if self.pairs:
            second, group = np.zeros(len(first), np.int64), first
            suffix = words.take(pa.array(keys))
        else:
            # Phrases of three are those of four with any fourth word, or none, added up.
            new = np.append(True, (first[1:] != first[:-1]) | (keys[1:] >> WIDTH != keys[:-1] >> WIDTH))
            three, four = np.flatnonzero(new), np.flatnonzero(keys & low)
            first, keys, counts = (
                np.append(first[three], first[four]), np.append(keys[three] >> WIDTH << WIDTH, keys[four]), np.append(np.add.reduceat(counts, three), counts[four]),
            )
            is_four = np.repeat([False, True], [len(three), len(four)])
            order = np.lexsort((is_four, keys, first))
            first, keys, counts, is_four = first[order], keys[order], counts[order], is_four[order]
            second = keys >> (2 * WIDTH)
            third, fourth = (words.take(pa.array(x)) for x in (keys >> WIDTH & low, keys & low))
            suffix = pc.if_else(pa.array(is_four), pc.binary_join_element_wise(third, fourth, " "), third)
            group = (first << WIDTH) | second
        part = np.zeros(len(group), np.int64)
        at = np.flatnonzero(np.isin(group, self._hot()))
        part[at] = [zlib.crc32(x.encode("utf-8", "surrogatepass")) % self.limits.parts for x in suffix.take(pa.array(at)).to_pylist()]
        marks = np.array(self.marks, np.int64)
        bucket = ((marks[first] if self.pairs else marks[first] * TIMES + marks[second]) + 40_503 * part) % self.limits.buckets
        lang = np.array(self.lang_numbers, np.int64)[first]
        order = np.lexsort((part, group, lang, bucket)) if len(at) else np.lexsort((lang, bucket))
        bucket, lang, group, part, first, second, counts = (x[order] for x in (bucket, lang, group, part, first, second, counts))
        suffix = suffix.take(pa.array(order))
        changes = lambda *x: np.flatnonzero(np.append(True, np.logical_or.reduce([c[1:] != c[:-1] for c in x])))
        starts = changes(bucket, group, part)
        offsets = pa.array(np.append(starts, len(group)), pa.int32())
        joined = lambda x, sep: pc.binary_join(pa.ListArray.from_arrays(offsets, x), sep)
        prefix = words.take(pa.array(first[starts]))
        if not self.pairs:
            prefix = pc.binary_join_element_wise(prefix, words.take(pa.array(second[starts])), " ")
        runs = pa.StructArray.from_arrays(
            [prefix, joined(suffix, "\n"), joined(pc.cast(pa.array(counts), pa.string()), ",")], ["prefix", "suffixes", "counts"]
        )
        firsts = changes(bucket[starts], lang[starts])
        rows = pa.ListArray.from_arrays(pa.array(np.append(firsts, len(starts)), pa.int32()), runs)
        langs = pa.array(list(self.known), pa.string()).take(pa.array(lang[starts][firsts]))
        return pa.RecordBatch.from_arrays([pa.array(bucket[starts][firsts], pa.int32()), langs, rows], ["bucket", "lang", "runs"])


RUNS = "bucket int, lang string, runs array<struct<prefix string, suffixes string, counts string>>"


def merged_runs(df: DataFrame, sizes: tuple[int, ...], words: bytes, pairs: bytes | None, hot: set, least: int, limits: Limits) -> DataFrame:
    """Phrases of the given sizes with at least `least` occurrences, as COUNTED."""
    held = df.sparkSession.sparkContext.broadcast((words, pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        miner = Miner(sizes, *held.value, hot, limits)
        for batch in batches:
            yield from miner.read(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        yield from miner.spill(0)

    runs = df.mapInArrow(run, RUNS).repartition("bucket")
    # A bucket's phrases come out of it at once: prefixes, which each run has anew, make no rows.
    whole = lambda r: F.concat(r.prefix, F.lit(" "), F.replace(r.suffixes, F.lit("\n"), F.concat(F.lit("\n"), r.prefix, F.lit(" "))))
    phrases = F.split(F.array_join(F.transform("runs", whole), "\n"), "\n")
    counts = F.split(F.array_join("runs.counts", ","), ",")
    entries = runs.select("bucket", "lang", F.inline(F.arrays_zip(phrases.alias("phrase"), counts.alias("n"))))
    summed = entries.groupBy("bucket", "lang", "phrase").agg(F.sum(F.col("n").cast("long")).alias("n"))
    return summed.filter(F.col("n") >= least).select("lang", "phrase", F.size(F.split("phrase", " ")).alias("size"), "n")


def count_phrases(
    df: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 30, limits: Limits = Limits()
) -> tuple[DataFrame, DataFrame]:
    """Phrases of one to LONGEST words with at least `least` occurrences (lang, phrase,
    size, n), and the number of words of each language (lang, n)."""
    spark = df.sparkSession
    common.share_code(spark)
    texts = df.select(F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    each = F.explode(F.array_remove(F.split(common.ascii_lower(F.coalesce("text", F.lit(""))), ENDS), ""))
    words = common.written(texts.select("lang", each.alias("phrase")).groupBy("lang", "phrase").agg(F.count(F.lit(1)).alias("n")))
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    total = words.agg(F.sum("n")).first()[0] or 0
    one = words.filter(F.col("n") >= least).select("lang", "phrase", F.lit(1).alias("size"), "n")

    def hot(counted: DataFrame) -> set[tuple[str, str]]:
        """Fewer than limits.hot phrases of one length, at any size."""
        return {(r[0], r[1]) for r in counted.filter(F.col("n") > total // limits.hot).select("lang", "phrase").collect()}

    ones = bit_map(one, limits.bits)
    two = common.written(merged_runs(texts, (2,), ones, None, hot(one), least, limits))
    more = common.written(merged_runs(texts, (3, 4), ones, bit_map(two, limits.bits), hot(two), least, limits))
    return one.unionByName(two).unionByName(more), totals


def _whole(x: Column | str) -> Column:
    """As a number of up to 38 digits: products here may pass 64 bits."""
    return F.col(x).cast("decimal(30,0)") if isinstance(x, str) else x.cast("decimal(30,0)")


def collocations(
    df: DataFrame, top: int = 2000, least: int = 30, text_col: str = "text", lang_col: str = "lang", limits: Limits = Limits()
) -> DataFrame:
    """The best phrases of two to LONGEST words of each language: lang, rank, phrase,
    a (its count), l and r (counts of its two parts), n (words of the language), score."""
    counted, totals = count_phrases(df, text_col, lang_col, least, limits)
    counted = common.written(counted)
    candidates = counted.filter(F.col("size") > 1).select("lang", "phrase", "size", F.col("n").alias("a"))
    parts = F.split("phrase", " ")
    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")).select(
        "*",
        F.array_join(F.slice(parts, F.lit(1), F.col("k")), " ").alias("left"),
        F.array_join(F.slice(parts, F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("right"),
    )
    known = counted.select("lang", "phrase", "n")
    for side, name in (("left", "l"), ("right", "r")):
        uses = cuts.groupBy("lang", side).agg(F.count(F.lit(1)).alias("uses"))
        found = uses.join(known.select("lang", F.col("phrase").alias(side), F.col("n").alias(name)), ["lang", side])
        cuts = common.join_counted(cuts, found, ["lang", side], "uses")
    scored = cuts.withColumn("l2", _whole("l") + _whole("r")).withColumn("a2", _whole("a")).withColumn(
        "score", F.expr("CAST(CAST(a2 * 2000000 AS DECIMAL(38,0)) div l2 AS BIGINT)")
    )
    lowest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("c")).select("lang", "phrase", "c.*")
    # Whatever holds a phrase and is frequent enough holds it in a candidate one word longer.
    inner = [
        candidates.filter(F.col("size") > 2).select("lang", F.array_join(F.slice(parts, x, F.col("size") - 1), " ").alias("phrase"), "a")
        for x in (1, 2)
    ]
    around = inner[0].unionByName(inner[1]).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = lowest.join(around, ["lang", "phrase"], "left").filter(
        F.col("longer").isNull() | (_whole("longer") * 100 < _whole("a") * 80)
    )
    order = (F.desc("score"), F.desc("a"), "phrase")
    # The best of each part of a language first, so that none is ordered in one task.
    part = F.pmod(F.xxhash64("phrase"), F.lit(limits.parts))
    first = kept.withColumn("place", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).filter(F.col("place") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
