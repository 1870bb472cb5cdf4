"""Scoring texts by a three-word language model learned from part of the table.

A token's probability mixes what followed its last two words, what followed its
last word, and how frequent it is: of a context met c times, the share
1 - (1 + c)^-spread goes to what followed it and the rest to the next shorter
context, down to add-one counts. Shares depend on c alone, so probabilities of all
words and of an unknown one add up to 1 after any context.

No task and not the driver holds the model. Documents are read in blocks of up to
a million tokens. A block sends each distinct word, with how often training
documents hold it, to the word's shard, which adds up what all blocks sent and gives
the words numbers. Then a block sends each distinct pair to the pair's shard; the
shard adds up what all blocks sent, packs the pairs and their quantised probabilities
into an Elias-Fano trie in mapped memory, and answers every block by searching it.
Rows of three go the same way, once the block knows the counts of its pairs. A context
that no other block's texts hold is not asked about: its counts are the block's own.
What moves follows the number of distinct rows in each block, and a shard holds about
as many of them at any size of the corpus. Blocks stay where they are: they lie in a
table bucketed by block, and only answers move to meet them.

Results in odd cases
--------------------
- A null or empty text is one token, its end.
- Repeated rows and rows without an id are learned from and scored each.
- Extra columns are kept whatever their names; the operator's own replace those of
  their name. A null in the training column is no training row.
- Very long texts go in parts of a block, each with the two words before it.
- An empty table gives an empty result; without training rows all probabilities are
  those of the unknown word.
- A context that alone would fill a shard is split by the words that follow it.
"""

from __future__ import annotations

import mmap
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowgauge.llm import common
from rowgauge.llm.elias_fano import Trie, pack_trie

#: Numbers of what is no word; words follow.
NONE, BEGIN, END, FIRST = 0, 1, 2, 3
#: Bits of a word's number within a block, tokens of a block, rows of a shard.
WIDTH, BLOCK, SHARD = 21, 1_000_000, 1_000_000
#: Steps of a quantised log10 probability; the code of a row that the trie has not.
STEPS, ABSENT = 1024, 65_535
SPREAD = 0.15
OWN = ("n_tokens", "n_known", "train_tokens", "base_score", "score")


def pack_ints(columns: list[np.ndarray]) -> bytes:
    """Columns of whole numbers, byte by byte of all numbers, compressed. The first byte
    is how many bytes of each number are there; the others are zeros."""
    flat = np.concatenate([np.zeros(0, np.int64), *columns]).astype("<i8")
    if not len(flat):
        return b""
    width = 8 if flat.min() < 0 else max(1, -(-int(flat.max()).bit_length() // 8))
    planes = np.ascontiguousarray(flat.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack_ints(data: bytes, n: int, columns: int) -> list[np.ndarray]:
    if not n:
        return [np.zeros(0, np.int64)] * columns
    width = data[0]
    planes = np.frombuffer(pa.decompress(memoryview(data)[1:], width * n * columns, codec="zstd", asbytes=True), np.uint8)
    flat = np.zeros((n * columns, 8), np.uint8)
    flat[:, :width] = planes.reshape(width, -1).T
    return list(flat.view("<i8").reshape(columns, n))


def lower_share(seen: np.ndarray, spread: float) -> np.ndarray:
    """The share of the shorter context after a context met `seen` times."""
    return (1.0 + seen) ** -spread


def code_of(n: np.ndarray, seen: np.ndarray, spread: float) -> np.ndarray:
    """Quantised log10 of a row's share of what followed its context."""
    share = (1.0 - lower_share(seen, spread)) * n / np.maximum(seen, 1)
    return np.rint(np.clip(-np.log10(np.maximum(share, 1e-300)) * STEPS, 0, ABSENT - 1)).astype(np.int64)


def codes_of(n: np.ndarray, seen: np.ndarray, spread: float) -> np.ndarray:
    """Codes of rows that training texts may not hold."""
    return np.where((n > 0) & (seen > 0), code_of(n, seen, spread), ABSENT)


#: The share of each code.
VALUES = np.append(10.0 ** (np.arange(ABSENT) / -STEPS), 0.0)


def value_of(code: np.ndarray) -> np.ndarray:
    return VALUES[code]


def mixed(*columns: np.ndarray) -> np.ndarray:
    """A hash of rows of whole numbers."""
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h = (h ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h


def words_of(text: str) -> list[bytes]:
    """The words [^\\x20\\x09-\\x0D]+ with A-Z in lower case: methods of bytes know ASCII alone."""
    return text.encode("utf-8", "surrogatepass").lower().split()


class Numbers(dict):
    """word, as bytes -> its number in a block, in the order of their coming."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = FIRST + len(self)
        return number


# -- blocks ------------------------------------------------------------------

PAYLOAD = (
    "words binary, lengths binary, listed int, heads int, learned int, "
    "n int, tokens binary, docs array<bigint>, sizes array<int>, begins array<boolean>, train array<boolean>"
)


def packed_words(numbers: list[bytes], tokens: list[int]) -> tuple[bytes, bytes, int, np.ndarray]:
    """Words in the order of their hashes: their bytes, their lengths and 16 bits of the
    hash of each; how many they are; and tokens with their numbers in that order."""
    marks = np.array([zlib.crc32(w) >> 16 for w in numbers], np.int64)
    order = np.argsort(marks, kind="stable")
    place = np.arange(FIRST + len(order))
    place[FIRST + order] = FIRST + np.arange(len(order))
    words = [numbers[i] for i in order.tolist()]
    lengths = np.array([len(w) for w in words], np.int64)
    data = pa.compress(b"".join(words), codec="zstd", asbytes=True)
    return data, pack_ints([lengths, np.diff(marks[order], prepend=0)]), len(words), place[np.array(tokens, np.int64)]


def laid_out(r: dict) -> tuple[np.ndarray, ...]:
    """A block's tokens, the sizes of its parts, which of them begin a text, where they
    start, and which tokens are scored there: parts of a text but the first begin with
    two words that were scored before."""
    (tokens,) = unpack_ints(r["tokens"], r["n"], 1)
    sizes, begins = np.array(r["sizes"], np.int64), np.array(r["begins"], bool)
    starts = np.cumsum(sizes) - sizes
    own = np.ones(len(tokens), bool)
    for k in (0, 1):
        own[(starts[~begins] + k)[sizes[~begins] > k]] = False
    return tokens, sizes, begins, starts, own


def _read(room: int) -> Callable:
    """Rows with a number each; now and then a row holds a block of tokens as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        doc = block = TaskContext.get().partitionId() << 33
        kinds = [
            pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int32(),
            pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.list_(pa.bool_()),
        ]
        names = [x.split()[0] for x in PAYLOAD.split(", ")]
        for batch in batches:
            numbers = Numbers()
            tokens: list[int] = []
            parts: list[tuple] = []
            blocks: list[tuple] = []

            def close(numbers, tokens, parts):
                *words, ids = packed_words(list(numbers), tokens)
                docs, sizes, begins, train = map(list, zip(*parts, strict=True))
                learned = sum(b and t for b, t in zip(begins, train, strict=True))
                blocks.append((*words, sum(begins), learned, len(ids), pack_ints([ids]), docs, sizes, begins, train))

            for text, train in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = words_of(text or "")
                if tokens and len(tokens) + len(words) >= room:
                    close(numbers, tokens, parts)
                    numbers, tokens, parts = Numbers(), [], []
                for start in range(0, max(1, len(words)), room):
                    if start:
                        close(numbers, tokens, parts)
                        numbers, tokens, parts = Numbers(), [], []
                    before = len(tokens)
                    tokens.extend(map(numbers.__getitem__, words[max(0, start - 2) : start + room]))
                    if start + room >= len(words):
                        tokens.append(END)
                    parts.append((doc, len(tokens) - before, start == 0, train))
                doc += 1
            if parts:
                close(numbers, tokens, parts)
            n = batch.num_rows
            # Block rows stand beside the documents' rows; there may be more of either.
            size = max(n, len(blocks))
            docs = np.arange(doc - n, doc)
            at = pa.array([i if i < n else None for i in range(size)], pa.int64())
            filled = [*zip(*blocks, strict=True)] if blocks else [[] for _ in names]
            columns = [pa.array([*c, *[None] * (size - len(blocks))], k) for c, k in zip(filled, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(at), pa.array(docs).take(at),
                    pa.array([block + i if i < len(blocks) else None for i in range(size)], pa.int64()), *columns,
                ],
                ["row", "doc", "block", *names],
            )
            block += len(blocks)

    return run


class Events:
    """A block's tokens, each with the two before it, as distinct pairs and threes."""

    def __init__(self, r: dict, ends: tuple[int, int], shards: int, hot: int):
        self.shards, self.hot = shards, hot
        tokens, sizes, begins, starts, own = laid_out(r)
        self.docs = np.array(r["docs"], np.int64)
        # Words in the order of their global numbers, so that distinct rows rise by them.
        ids = np.array(r["ids"], np.int64)
        order = np.argsort(ids, kind="stable")
        place = np.arange(FIRST + len(ids))
        place[FIRST + order] = FIRST + np.arange(len(ids))
        tokens = place[tokens]
        #: Global number (-1: not in training) and count of the block's numbers.
        self.ids = np.append([NONE, BEGIN, END], ids[order])
        self.seen = np.append([0, ends[0], ends[0]], np.array(r["seen"], np.int64)[order])
        self.every = np.append([0, ends[1], ends[1]], np.array(r["every"], np.int64)[order])
        one, two = np.append(NONE, tokens[:-1]), np.append([NONE, NONE], tokens[:-2])[: len(tokens)]
        heads = starts[begins]
        one[heads], two[heads] = BEGIN, NONE
        seconds = heads[sizes[begins] > 1] + 1
        two[seconds] = BEGIN
        self.part = np.repeat(np.arange(len(sizes)), sizes)[own]
        self.w, self.v, self.u = tokens[own], one[own], two[own]
        self.train = np.repeat(np.array(r["train"], bool), sizes)[own]
        # The pairs in front of such parts are asked for, not counted again.
        ahead = starts[~begins][sizes[~begins] > 1]
        pairs = np.append((self.v << WIDTH) | self.w, (tokens[ahead] << WIDTH) | tokens[ahead + 1])
        self.pairs, pair_at = np.unique(pairs, return_inverse=True)
        self.pair_at = pair_at[: len(self.w)]
        # The two tokens before a token are the pair that ends right before it.
        ends_at = np.zeros(len(tokens), np.int64)
        ends_at[own] = self.pair_at
        ends_at[ahead + 1] = pair_at[len(self.w) :]
        self.context = np.append(0, ends_at[:-1])[: len(tokens)][own]
        # The last pair of a part that goes on elsewhere is asked for there.
        last = (starts + sizes)[(sizes > 1) & (tokens[starts + sizes - 1] != END)] - 1
        self.passed_on = (tokens[last - 1] << WIDTH) | tokens[last]
        self.longer = self.u != NONE

    @cached_property
    def _threes(self) -> tuple[np.ndarray, np.ndarray]:
        threes = (self.v << (2 * WIDTH)) | (self.u << WIDTH) | self.w
        return np.unique(threes[self.longer], return_inverse=True)

    @property
    def threes(self) -> np.ndarray:
        return self._threes[0]

    @property
    def three_at(self) -> np.ndarray:
        return self._threes[1]

    def pair_rows(self) -> "Rows":
        v, w = self.pairs >> WIDTH, self.pairs & (2**WIDTH - 1)
        n, every = (np.bincount(at, minlength=len(self.pairs)) for at in (self.pair_at[self.train], self.pair_at))
        whole, passed = np.bincount(v, every, len(self.ids))[v] == self.every[v], np.isin(self.pairs, self.passed_on)
        return Rows([self.ids[v], self.ids[w]], n, every, self.seen[v], whole & ~passed, (self.seen[v] > self.hot) | (whole & passed))

    def three_rows(self, pair_counts: np.ndarray, pair_every: np.ndarray) -> "Rows":
        low = 2**WIDTH - 1
        v, u, w = self.threes >> (2 * WIDTH), self.threes >> WIDTH & low, self.threes & low
        n, every = (np.bincount(at, minlength=len(self.threes)) for at in (self.three_at[self.train[self.longer]], self.three_at))
        if not len(self.threes):
            return Rows([v, u, w], n, every, n, n > 0, n > 0)
        place = np.empty(len(self.threes), np.int64)
        place[self.three_at] = self.context[self.longer]
        alone = np.bincount(place, every, len(self.pairs))[place] == pair_every[place]
        met = pair_counts[place]
        return Rows([self.ids[v], self.ids[u], self.ids[w]], n, every, met, alone, met > self.hot)

    def shares(self, rows: "Rows") -> tuple[np.ndarray, np.ndarray]:
        """Rows that others must be asked about, by shard; and the shard of each."""
        known = (rows.met == 0) | rows.alone
        may = np.flatnonzero(np.logical_and.reduce([c >= 0 for c in rows.columns]) & ~known)
        some = [c[may] for c in rows.columns]
        shard = np.where(rows.met[may] > self.hot, mixed(*some), mixed(*some[:-1])) % np.uint64(self.shards)
        shard = shard.astype(np.uint16 if self.shards <= 2**16 else np.int64)  # short numbers are sorted by digits
        order = np.argsort(shard, kind="stable")
        return may[order], shard[order].astype(np.int64)

    def messages(self, rows: "Rows", counts: bool) -> Iterator[tuple[int, int, bytes]]:
        """Per shard: columns of the rows, the first by its steps, and their counts; with
        `counts` those of texts that are not learned from; and `met` where it is told."""
        at, shard = self.shares(rows)
        starts = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(shard) else np.zeros(0, np.int64)
        columns = [c[at] for c in rows.columns]
        columns += [rows.n[at], *([rows.every[at] - rows.n[at]] if counts else []), np.where(rows.told, rows.met, 0)[at]]
        for start, stop in zip(starts.tolist(), np.append(starts[1:], len(shard)).tolist() if len(shard) else [], strict=True):
            mine = [c[start:stop] for c in columns]
            mine[0] = np.diff(mine[0], prepend=0)
            yield int(shard[start]), stop - start, pack_ints(mine)

    def answers(self, got: list[tuple[int, int, bytes]], columns: int) -> list[np.ndarray]:
        """Numbers for each row asked about, in the order of shares()."""
        parts = [unpack_ints(data, n, columns) for _, n, data in sorted(got)]
        return [np.concatenate([np.zeros(0, np.int64), *[p[k] for p in parts]]) for k in range(columns)]

    def pair_answers(self, rows: "Rows", got: list) -> tuple[np.ndarray, np.ndarray]:
        """Counts of the pairs. Shards answer with counts, as pairs are the contexts of
        threes; the code of a count is what their tries hold."""
        counts, every = rows.n.copy(), rows.every.copy()
        asked = self.shares(rows)[0]
        counts[asked], more = self.answers(got, 2)
        every[asked] = counts[asked] + more
        return counts, every

    def three_codes(self, rows: "Rows", got: list, spread: float) -> np.ndarray:
        asked = self.shares(rows)[0]
        own = np.ones(len(rows.n), bool)
        own[asked] = False
        codes = np.empty(len(rows.n), np.int64)
        codes[own] = codes_of(rows.n[own], rows.met[own], spread)
        (codes[asked],) = self.answers(got, 1)
        return codes


@dataclass
class Rows:
    """Distinct rows of a block: columns of global numbers, the block's counts of
    training texts and of all, how often training texts hold the context, whether no
    other block's texts do, and whether the row's shard is told how often it was met:
    elsewhere all rows of a context come to one shard, which adds them up."""

    columns: list[np.ndarray]
    n: np.ndarray
    every: np.ndarray
    met: np.ndarray
    alone: np.ndarray
    told: np.ndarray


def _word_shard(shards: int) -> Callable:
    """Adds up the words of all blocks and answers with their numbers and counts. Frequent
    words get small numbers."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("block")
        sizes = group.column("n").to_numpy()
        sent = [unpack_ints(d.as_py(), int(n), 3) for n, d in zip(sizes, group.column("data"), strict=True)]
        lengths, n, rest = (np.concatenate([m[k] for m in sent]) for k in range(3))
        data = b"".join(
            pa.decompress(w.as_py(), int(m[0].sum()), codec="zstd", asbytes=True) for w, m in zip(group.column("words"), sent, strict=True)
        )
        offsets = np.append(0, np.cumsum(lengths)).astype("<i8")
        coded = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        at, types = coded.indices.to_numpy(), len(coded.dictionary)
        seen, more = (np.bincount(at, x, types).astype(np.int64) for x in (n, rest))
        rank = np.empty(types, np.int64)
        rank[np.argsort(-seen, kind="stable")] = np.arange(types)
        # 0 for a word that training texts do not hold.
        ids = np.where(seen > 0, FIRST + rank * shards + group.column("shard")[0].as_py(), 0)
        stops = np.cumsum(sizes)
        replies = [pack_ints([x[at[b - s : b]] for x in (ids, seen, more)]) for s, b in zip(sizes, stops, strict=True)]
        first = lambda x: pa.array(np.append(x, np.zeros(len(sizes) - 1, np.int64)), pa.int64())
        return pa.table({
            "block": group.column("block"), "shard": group.column("shard"), "n": group.column("n"), "data": pa.array(replies, pa.binary()),
            "types": first(int((seen > 0).sum())), "total": first(int(seen.sum())),
        })

    return run


def in_order(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of numbers from 0 on as one number each, which rise as the rows do, and
    the order of the rows."""
    key, high = rows[0], int(rows[0].max(initial=0))
    for c in rows[1:]:
        bits = int(c.max(initial=0)).bit_length()
        if high.bit_length() + bits > 63:
            held, key = np.unique(key, return_inverse=True)
            high = len(held)
        key, high = key << bits | c, (high + 1 << bits) - 1
    return key, np.argsort(key)


def _shard(columns: int, spread: float, counts: bool) -> Callable:
    """Adds up the rows of all blocks, packs them into a trie and answers the blocks."""

    def run(group: pa.Table) -> pa.Table:
        sizes = group.column("n").to_numpy()
        width = columns + 2 + counts
        sent = [unpack_ints(d.as_py(), int(n), width) for n, d in zip(sizes, group.column("data"), strict=True)]
        asked = [np.concatenate([np.cumsum(m[k]) if k == 0 else m[k] for m in sent]) for k in range(width)]
        del sent
        rows, n, told = asked[:columns], asked[columns], asked[-1]
        key, order = in_order(rows)
        key = key[order]
        new, context = np.ones(len(order), bool), np.zeros(len(order), bool)
        new[1:] = key[1:] != key[:-1]
        context[:1] = True
        ordered = [c[order] for c in rows]
        for c in ordered[:-1]:
            context[1:] |= c[1:] != c[:-1]
        firsts = np.flatnonzero(new)
        distinct = [c[firsts] for c in ordered]
        total = np.add.reduceat(n[order], firsts)
        # How often a context was met: what was told, else all of its rows, which are here.
        starts = np.flatnonzero(context)
        met = np.maximum.reduceat(told[order], starts)
        met = np.where(met > 0, met, np.add.reduceat(n[order], starts))[(np.cumsum(context) - 1)[firsts]]
        held = total > 0
        packed = pack_trie([c[held] for c in distinct], code_of(total[held], met[held], spread))
        levels = mmap.mmap(-1, len(packed))
        levels.write(packed)
        trie = Trie(levels)
        place = trie.find(distinct)
        if counts:
            answer = [np.where(place >= 0, np.append(total[held], 0)[place], 0), np.add.reduceat(asked[columns + 1][order], firsts)]
        else:
            answer = [np.where(place >= 0, np.append(trie.values, 0)[place], ABSENT)]
        at = np.empty(len(order), np.int64)
        at[order] = np.cumsum(new) - 1
        stops = np.cumsum(sizes)
        data = [pack_ints([x[at[b - s : b]] for x in answer]) for s, b in zip(sizes, stops, strict=True)]
        return pa.table({
            "block": group.column("block"), "shard": group.column("shard"), "n": group.column("n"), "data": pa.array(data, pa.binary()),
        })

    return run


# -- the whole ---------------------------------------------------------------

MESSAGE = "block bigint, shard bigint, n int, data binary"
WORDS = "block bigint, shard bigint, n int, words binary, data binary"
NUMBERED = f"{MESSAGE}, types bigint, total bigint"


def _by_block(batches: Iterator[pa.RecordBatch], make: Callable[[dict], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in range(batch.num_rows):
            cells = {name: column[r] for name, column in zip(batch.schema.names, batch.columns, strict=True)}
            yield from make({name: cell.values.to_numpy(zero_copy_only=False) if _is_numbers(cell) else cell.as_py() for name, cell in cells.items()})


def _is_numbers(cell: pa.Scalar) -> bool:
    """A list of numbers, which need not become Python's."""
    return cell.is_valid and pa.types.is_list(cell.type) and pa.types.is_primitive(cell.type.value_type)


def score_texts(
    df: DataFrame, train: Column, text_col: str = "text", spread: float = SPREAD, carry: list[str] | None = None,
    block: int = BLOCK, shard: int = SHARD,
) -> DataFrame:
    """df with n_tokens, n_known (tokens that training texts hold), train_tokens,
    base_score (log10 of add-one word probabilities) and score (log10 probability of
    the text). `train` says which rows to learn from; `carry` which columns to keep.
    """
    spark = df.sparkSession
    common.share_code(spark)
    keep = [c for c in df.columns if c not in OWN and (carry is None or c in carry)]
    row = F.struct(*keep) if keep else F.struct(F.lit(0).alias("none"))
    given = df.select(row.alias("row"), F.col(text_col).cast("string").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))

    ints = T.StructType.fromDDL(f"doc bigint, block bigint, {PAYLOAD}")
    schema = T.StructType([T.StructField("row", given.schema["row"].dataType), *ints.fields])
    read = common.bucketed(given.mapInArrow(_read(block), schema), "block")
    blocks = read.filter(F.col("block").isNotNull())
    listed, *ends = (x or 0 for x in blocks.agg(F.sum("listed"), F.sum("learned"), F.sum("heads")).first())
    word_shards = max(1, listed // shard)

    words_schema = pa.schema([("block", pa.int64()), ("shard", pa.int64()), ("n", pa.int32()), ("words", pa.binary()), ("data", pa.binary())])

    def send_words(r: dict) -> Iterator[pa.RecordBatch]:
        tokens, sizes, _, _, own = laid_out(r)
        lengths, steps = unpack_ints(r["lengths"], r["listed"], 2)
        if not len(lengths):
            return
        train = np.repeat(np.array(r["train"], bool), sizes)
        n, every = (np.bincount(tokens[own & some], minlength=FIRST + len(lengths))[FIRST:] for some in (train, True))
        data = pa.decompress(r["words"], int(lengths.sum()), codec="zstd", asbytes=True)
        ends_at = np.append(0, np.cumsum(lengths))
        # Words lie in the order of their hashes, so those of a shard lie together.
        to = np.cumsum(steps) * word_shards >> 16
        starts = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
        made = [
            (int(to[a]), b - a, pa.compress(data[ends_at[a] : ends_at[b]], codec="zstd", asbytes=True), pack_ints([lengths[a:b], n[a:b], (every - n)[a:b]]))
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(to)], strict=True)
        ]
        for start in range(0, len(made), 1000):
            yield pa.RecordBatch.from_pylist(
                [{"block": r["block"], "shard": s, "n": m, "words": w, "data": d} for s, m, w, d in made[start : start + 1000]],
                words_schema,
            )

    # Written by block as well: each pass reads them, and only answers move to the blocks.
    numbered = blocks.select("block", "words", "lengths", "listed", "n", "tokens", "sizes", "begins", "train").mapInArrow(
        lambda batches: _by_block(batches, send_words), WORDS
    ).groupBy("shard").applyInArrow(_word_shard(word_shards), NUMBERED)
    known = common.bucketed(
        numbered.groupBy("block").agg(F.collect_list(F.struct("shard", "n", "data")).alias("known"), *[F.sum(c).alias(c) for c in ("types", "total")]),
        "block",
    )
    types, total = (x or 0 for x in known.agg(F.sum("types"), F.sum("total")).first())
    # The end of a text is a word as well.
    types, total = types + (ends[0] > 0), total + ends[0]
    shards, hot = max(1, total // shard), shard // 2
    state = blocks.select("block", "n", "tokens", "docs", "sizes", "begins", "train").join(known.select("block", "known"), "block", "left")

    def events(r: dict) -> Events:
        got = [unpack_ints(data, n, 3) for _, n, data in sorted(replies(r, "known"))]
        ids, seen, more = (np.concatenate([np.zeros(0, np.int64), *[g[k] for g in got]]) for k in range(3))
        return Events(r | {"ids": np.where(ids > 0, ids, -1), "seen": seen, "every": seen + more}, ends, shards, hot)

    def replies(r: dict, name: str) -> list[tuple[int, int, bytes]]:
        return [(x["shard"], x["n"], x["data"]) for x in r[name] or []]

    def sent(r: dict, rows: Rows, on: Events, counts: bool) -> Iterator[pa.RecordBatch]:
        made = list(on.messages(rows, counts))
        for start in range(0, len(made), 1000):
            s, n, data = zip(*made[start : start + 1000], strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["block"]] * len(s), pa.int64()), pa.array(s, pa.int64()), pa.array(n, pa.int32()), pa.array(data, pa.binary())],
                ["block", "shard", "n", "data"],
            )

    def send_pairs(r: dict) -> Iterator[pa.RecordBatch]:
        on = events(r)
        yield from sent(r, on.pair_rows(), on, True)

    def send_threes(r: dict) -> Iterator[pa.RecordBatch]:
        on = events(r)
        yield from sent(r, on.three_rows(*on.pair_answers(on.pair_rows(), replies(r, "pairs"))), on, False)

    def finish(r: dict) -> Iterator[pa.RecordBatch]:
        on = events(r)
        two = on.pair_rows()
        counts, every = on.pair_answers(two, replies(r, "pairs"))
        code2 = codes_of(counts, two.met, spread)
        three = on.three_rows(counts, every)
        code3 = on.three_codes(three, replies(r, "threes"), spread)
        p1 = (on.seen + 1.0) / (total + types + 1.0)
        p = value_of(code2)[on.pair_at] + (lower_share(on.seen, spread)[on.v] * p1[on.w])
        long = on.longer
        p[long] = value_of(code3)[on.three_at] + lower_share(three.met, spread)[on.three_at] * p[long]
        m = len(on.docs)
        summed = lambda x: np.bincount(on.part, x, m)
        columns = [np.bincount(on.part, minlength=m), np.bincount(on.part, on.seen[on.w] > 0, m).astype(np.int64), summed(np.log10(p1)[on.w]), summed(np.log10(p))]
        yield pa.RecordBatch.from_arrays([pa.array(on.docs), *map(pa.array, columns)], ["doc", "n_tokens", "n_known", "base_score", "score"])

    def back(made: DataFrame, columns: int, name: str) -> DataFrame:
        made = made.groupBy("shard").applyInArrow(_shard(columns, spread, columns == 2), MESSAGE)
        return made.groupBy("block").agg(F.collect_list(F.struct("shard", "n", "data")).alias(name))

    run = lambda make: lambda batches: _by_block(batches, make)
    pairs = common.bucketed(back(state.mapInArrow(run(send_pairs), MESSAGE), 2, "pairs"), "block")
    state = state.join(pairs, "block", "left")
    threes = back(state.mapInArrow(run(send_threes), MESSAGE), 3, "threes")
    done = state.join(threes, "block", "left").mapInArrow(
        run(finish), "doc bigint, n_tokens bigint, n_known bigint, base_score double, score double"
    )
    sums = done.groupBy("doc").agg(*[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])
    scored = read.filter(F.col("doc").isNotNull()).select("row", "doc").join(sums, "doc")
    return scored.select(
        *[F.col("row")[c].alias(c) for c in keep], "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score"
    )
