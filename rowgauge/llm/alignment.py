"""Alignment of two tokenizers' tokens over the same bytes.

Both tokenizers cut the same bytes, so each one's tokens are a rising row of end
offsets, and aligning them is merging two rows. All documents of a batch are
merged in lockstep: one state vector holds a pointer into A's ends and one into
B's for every document, a step compares all of them at once, advances the side
that lags (both where the ends meet, which is a link and a cut), and documents
that are through leave the vector. A long document takes several places in the
vector, each from where A's and B's offsets are known to have come as far, so
that the number of steps does not follow the longest document.

How often an id pair is linked in the whole corpus is counted per block of
documents first; blocks meet the sums again by pair, never all links by document.

Results in odd cases
--------------------
- A null or empty text has no tokens; neither has one whose tokens' bytes differ
  from those of the text: numbers are 0, lists and `groups` are empty.
- Repeated rows and rows without an id count and stand each on its own.
- Extra columns are kept whatever their names; the operator's own replace those
  of their name.
- Very long texts are cut for the tokenizers at single spaces between two word
  characters, where no token of these tokenizers can reach across.
- An empty table gives an empty result.
- Ties: all pairs that share their B id's highest count are best.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowgauge.llm import common

#: Characters of text merged at once; characters from which a text is cut for the tokenizers.
BATCH_CHARS, LONG = 500_000, 200_000
#: A tokens per place in the state vector; links per block of the corpus counts.
PLACE, BLOCK = 256, 1_000_000
#: A pair of ids as one long: A above, B below.
SHIFT = 32
SAFE = re.compile(r"(?<=\w) (?=\w)")
BYTE_PIECE = re.compile("<0x([0-9A-F]{2})>")
OWN = ("n_a", "n_b", "n_groups", "n_links", "groups", "cuts", "links", "n_best", "count_sum")


def byte_letters() -> dict[str, int]:
    """The letter that byte-level tokenizers write for each byte: printable bytes of
    Latin-1 stand for themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteLevel:
    """Side A: a byte-level BPE of the tokenizers library. The text gets a space in front.

    Where ranks and ids agree, as in files whose ids follow their merges, tiktoken
    gives the same ids in a fifth of the time and memory. That is tried against the
    library when a worker loads the file; if anything differs, the library encodes.
    """

    #: How byte-level tokenizers split a text, a fixed value.
    PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    PROBES = (
        "Hello  world\n\n x\t\ty ", "don't we'll I'VE <|endoftext|>", "ñandú È 日本語 🙂\u0301 ١٢ x\u00a0\u2003y", "a\x1cb\x85c\u2028d\u180ee \x0b\x0c\r\n",
        "12345 1.5e-7 %$#@!! ....", "internationalisation zzqqxj " * 3, "",
    )

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        letters = byte_letters()
        self.pieces = [b""] * self.tokenizer.get_vocab_size()
        for piece, i in self.tokenizer.get_vocab().items():
            self.pieces[i] = bytes(letters[c] for c in piece) if all(c in letters for c in piece) else piece.encode()
        special = set(self.tokenizer.get_added_tokens_decoder())
        ranks = {p: i for i, p in enumerate(self.pieces) if i not in special}
        self.fast = tiktoken.Encoding("ranks", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})
        if [x.tolist() for x in self.encode(list(self.PROBES))] != [x.tolist() for x in self._asked(list(self.PROBES))]:
            self.fast = None
        else:
            self.tokenizer = None

    def _asked(self, texts: list[str]) -> list[np.ndarray]:
        spaced = [" " + t for t in texts]
        return [np.array(e.ids, np.int64) for e in self.tokenizer.encode_batch(spaced, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if self.fast is None:
            return self._asked(texts)
        return [self.fast.encode_to_numpy(" " + t, disallowed_special=()) for t in texts]


class Pieces:
    """Side B: a sentencepiece model, which puts the space in front itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            byte = BYTE_PIECE.fullmatch(piece) if self.model.is_byte(i) else None
            self.pieces.append(bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode())

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.int64) for ids in self.model.encode(texts, num_threads=1)]


class Side:
    """A tokenizer that also takes very long texts, and says what its tokens spell."""

    def __init__(self, path: str):
        self.tokenizer = Pieces(path) if path.endswith(".model") else ByteLevel(path)
        self.pieces = self.tokenizer.pieces
        self.sizes = np.array([len(p) for p in self.pieces], np.int64)
        #: The digits of every id, padded to one width.
        names = np.array([str(i) for i in range(len(self.pieces))], "S")
        self.digits = names.view(np.uint8).reshape(len(names), -1)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        parts = [cut(t) for t in texts]
        flat = self.tokenizer.encode([x for p in parts for x in p])
        out, at = [], 0
        for p in parts:
            out.append(flat[at] if len(p) == 1 else np.concatenate(flat[at : at + len(p)]))
            at += len(p)
        return out

    def spells(self, ids: np.ndarray, data: bytes) -> bool:
        return b"".join(map(self.pieces.__getitem__, ids.tolist())) == data


def cut(text: str) -> list[str]:
    """Parts of at least LONG characters. The space at a cut is left out: both sides
    put one in front of every part."""
    parts, start = [], 0
    while len(text) - start > LONG:
        space = SAFE.search(text, start + LONG)
        if not space:
            break
        parts.append(text[start : space.start()])
        start = space.end()
    return [*parts, text[start:]]


_sides: dict[str, Side] = {}


def side(path: str) -> Side:
    """The worker's tokenizer for a file; it outlives tasks."""
    if path not in _sides:
        _sides[path] = Side(path)
    return _sides[path]


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the tokens of A and of B that end together.

    Ends rise over the whole batch; document d's A tokens begin at starts[d], and
    the last ends of a document's A and B are equal.
    """
    sizes = np.diff(np.append(starts, len(ends_a)))
    n_places = -(-sizes // PLACE)
    first = np.repeat(np.cumsum(n_places) - n_places, n_places)
    a = np.repeat(starts, n_places) + PLACE * (np.arange(n_places.sum()) - first)
    stop = np.minimum(a + PLACE, np.repeat(starts + sizes, n_places))
    # B comes in where A's offset before the place is passed.
    b = np.searchsorted(ends_b, np.where(a > 0, ends_a[a - 1], 0), side="right") if len(a) else a
    links_a, links_b = [], []
    while len(a):
        end_a, end_b = ends_a[a], ends_b[b]
        met = end_a == end_b
        links_a.append(a[met])
        links_b.append(b[met])
        a = a + (end_a <= end_b)
        b = b + (end_b <= end_a)
        going = a < stop
        if not going.all():
            a, b, stop = a[going], b[going], stop[going]
    if not links_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = np.concatenate(links_a)
    order = np.argsort(found)
    return found[order], np.concatenate(links_b)[order]


@dataclass
class Aligned:
    """Of a batch: per document numbers of tokens and links, and all links in a row."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_links: np.ndarray
    groups: pa.Array
    cuts: np.ndarray
    ids_a: np.ndarray
    ids_b: np.ndarray


def align_texts(texts: list[str], a: Side, b: Side) -> Aligned:
    of_a, of_b = a.encode(texts), b.encode(texts)
    none = np.zeros(0, np.int64)
    for d, text in enumerate(texts):
        data = (" " + text).encode("utf-8", "surrogatepass")
        if not text or not (a.spells(of_a[d], data) and b.spells(of_b[d], data)):
            of_a[d] = of_b[d] = none
    n_a, n_b = (np.array([len(x) for x in of], np.int64) for of in (of_a, of_b))
    flat_a, flat_b = (np.concatenate([none, *of]).astype(np.int64) for of in (of_a, of_b))
    ends_a, ends_b = np.cumsum(a.sizes[flat_a]), np.cumsum(b.sizes[flat_b])
    starts_a = np.cumsum(n_a) - n_a
    at_a, at_b = lockstep(ends_a, ends_b, starts_a[n_a > 0])
    n_links = np.diff(np.searchsorted(at_a, np.append(starts_a, len(flat_a))))
    base = np.append(0, ends_a)[starts_a]
    return Aligned(
        n_a, n_b, n_links, spelled(a, b, flat_a, flat_b, at_a, at_b, n_a + n_b),
        ends_a[at_a] - np.repeat(base, n_links), flat_a[at_a], flat_b[at_b],
    )


def spelled(
    a: Side, b: Side, flat_a: np.ndarray, flat_b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, sizes: np.ndarray
) -> pa.Array:
    """Each document's groups, as `a1,a2|b1;a3|b2,b3`.

    A token of A stands behind all of A before it and B's of the groups before its
    own; one of B behind all of B before it and A's up to the end of its group.
    Tokens are rows of digits and a mark; what pads them is dropped at the end.
    """
    group_a = np.searchsorted(at_a, np.arange(len(flat_a)))
    group_b = np.searchsorted(at_b, np.arange(len(flat_b)))
    places = (
        np.arange(len(flat_a)) + np.append(0, at_b + 1)[group_a],
        np.arange(len(flat_b)) + (at_a[group_b] + 1 if len(flat_b) else 0),
    )
    width = max(a.digits.shape[1], b.digits.shape[1])
    rows = np.zeros((len(flat_a) + len(flat_b), width + 1), np.uint8)
    rows[:, width] = ord(",")
    for held, flat, at, place, mark in ((a, flat_a, at_a, places[0], "|"), (b, flat_b, at_b, places[1], ";")):
        rows[place, : held.digits.shape[1]] = held.digits[flat]
        rows[place[at], width] = ord(mark)
    stops = np.cumsum(sizes)
    rows[stops[sizes > 0] - 1, width] = 0
    shown = rows > 0
    offsets = np.append(0, np.append(0, np.cumsum(shown.sum(axis=1)))[stops])
    return pa.StringArray.from_buffers(
        len(sizes), pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(rows[shown].tobytes())
    )


def batches_of(texts: list[str], room: int) -> Iterator[tuple[int, int]]:
    start, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > room:
            yield start, i
            start, held = i, 0
        held += len(text)
    if start < len(texts):
        yield start, len(texts)


def _aligner(tokenizer_a: str, tokenizer_b: str, detail: bool, room: int):
    """Aligns batches. With detail every row has its cuts and links; otherwise every
    row has its place in a block, and rows of their own hold the blocks' pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        a, b = side(tokenizer_a), side(tokenizer_b)
        block, kind = TaskContext.get().partitionId() << 32, None
        codes: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())

        def of_block() -> pa.RecordBatch:
            pairs, refs, counts = np.unique(np.concatenate(codes), return_inverse=True, return_counts=True)
            none = [pa.nulls(1, k) for k in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())]
            return pa.RecordBatch.from_arrays(
                [
                    pa.nulls(1, kind), *none, pa.array([block], pa.int64()), pa.nulls(1, pa.int32()), pa.array([pairs], longs),
                    pa.array([counts], longs), pa.array([refs.astype("<u4").tobytes()], pa.binary()), pa.array([np.concatenate(sizes)], ints),
                ],
                [*NAMES, "block", "at", "pairs", "counts", "refs", "sizes"],
            )

        for batch in batches:
            kind = batch.column(0).type
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for start, stop in batches_of(texts, BATCH_CHARS):
                got, n = align_texts(texts[start:stop], a, b), stop - start
                columns = [batch.column(0).slice(start, n), *[pa.array(x, pa.int64()) for x in (got.n_a, got.n_b, got.n_links, got.n_links)], got.groups]
                if detail:
                    offsets = pa.array(np.append(0, np.cumsum(got.n_links)), pa.int32())
                    parts = (pa.array(got.cuts, pa.int64()), pa.array(got.ids_a, pa.int32()), pa.array(got.ids_b, pa.int32()))
                    columns += [pa.ListArray.from_arrays(offsets, x) for x in parts]
                    yield pa.RecordBatch.from_arrays(columns, [*NAMES, "cuts", "ids_a", "ids_b"])
                    continue
                held = sum(map(len, sizes))
                codes.append((got.ids_a << SHIFT) | got.ids_b)
                sizes.append(got.n_links)
                columns += [pa.array(np.full(n, block), pa.int64()), pa.array(np.arange(held, held + n), pa.int32())]
                columns += [pa.nulls(n, k) for k in (longs, longs, pa.binary(), ints)]
                yield pa.RecordBatch.from_arrays(columns, [*NAMES, "block", "at", "pairs", "counts", "refs", "sizes"])
                if sum(map(len, codes)) >= room:
                    yield of_block()
                    block, codes, sizes = block + 1, [], []
        if codes:
            yield of_block()

    return run


NAMES = ("row", "n_a", "n_b", "n_groups", "n_links", "groups")


def _aligned(df: DataFrame, tokenizers: tuple[str, str], text_col: str, keep: list[str], more: str, room: int) -> DataFrame:
    common.share_code(df.sparkSession)
    row = F.struct(*keep) if keep else F.struct(F.lit(0).alias("none"))
    given = df.select(row.alias("row"), F.col(text_col).cast("string").alias("text"))
    made = T.StructType.fromDDL(f"n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, {more}")
    schema = T.StructType([T.StructField("row", given.schema["row"].dataType), *made.fields])
    return given.mapInArrow(_aligner(*tokenizers, "cuts" in more, room), schema)


def _kept(df: DataFrame, carry: list[str] | None) -> list[str]:
    return [c for c in df.columns if c not in OWN and (carry is None or c in carry)]


def align(df: DataFrame, tokenizer_a: str, tokenizer_b: str, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """df with n_a, n_b, n_groups, n_links, groups (text), cuts (byte offsets in
    space + text where groups end) and links (ids of A and B that end together,
    one of each per cut). `carry` names the columns of df to keep, all by default.
    """
    keep = _kept(df, carry)
    made = _aligned(df, (tokenizer_a, tokenizer_b), text_col, keep, "cuts array<bigint>, ids_a array<int>, ids_b array<int>", 0)
    links = F.struct(F.col("ids_a").alias("a"), F.col("ids_b").alias("b")).alias("links")
    return made.select(*[F.col("row")[c].alias(c) for c in keep], "n_a", "n_b", "n_groups", "n_links", "groups", "cuts", links)


def align_weighed(
    df: DataFrame, tokenizer_a: str, tokenizer_b: str, text_col: str = "text", carry: list[str] | None = None,
    digest: Callable[[Column], Column] = lambda groups: groups, block: int = BLOCK,
) -> DataFrame:
    """df with n_a, n_b, n_groups, n_links, groups, n_best (links whose pair has its B
    id's highest count in the corpus) and count_sum (sum of the pairs' counts over
    the links). `digest` is applied to groups before anything is written.

    One pass gives every document a place in a block and every block its distinct
    pairs with their counts; that is written. The pairs' sums come from the blocks'
    pairs, meet them again by pair, return to the block and are added up there. A
    pair stands at most once in a block, so no pair can fill a task.
    """
    keep = _kept(df, carry)
    more = "block bigint, at int, pairs array<bigint>, counts array<bigint>, refs binary, sizes array<int>"
    made = _aligned(df, (tokenizer_a, tokenizer_b), text_col, keep, more, block)
    read = common.written(made.withColumn("groups", digest(F.col("groups"))))
    held = read.filter(F.col("at").isNull())
    pairs = held.select(
        "block", F.posexplode(F.arrays_zip("pairs", "counts"))
    ).select("block", "pos", F.col("col.pairs").alias("pair"), F.col("col.counts").alias("n"))
    sums = pairs.groupBy("pair").agg(F.sum("n").alias("n"))
    by_b = Window.partitionBy(F.col("pair").bitwiseAND(2**SHIFT - 1))
    known = sums.select("pair", "n", (F.col("n") == F.max("n").over(by_b)).alias("best"))
    back = pairs.drop("n").join(known, "pair").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("pos", "n", "best"))).alias("known"))
    sums_of = held.select("block", "refs", "sizes").join(back, "block").select(
        "block", "refs", "sizes", F.col("known.n").alias("n"), F.col("known.best").alias("best")
    ).mapInArrow(_weighed, "block bigint, at int, n_best bigint, count_sum bigint")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    rows = read.filter(F.col("at").isNotNull()).drop("pairs", "counts", "refs", "sizes")
    joined = rows.join(sums_of, ["block", "at"], "left")
    return joined.select(*[F.col("row")[c].alias(c) for c in keep], *NAMES[1:], zero("n_best"), zero("count_sum"))


def _weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in range(batch.num_rows):
            block, refs = batch.column(0)[r].as_py(), np.frombuffer(batch.column(1)[r].as_buffer(), "<u4")
            sizes, n, best = (batch.column(k)[r].values.to_numpy(zero_copy_only=False) for k in (2, 3, 4))
            stops = np.cumsum(sizes)
            total = lambda x: np.diff(np.append(0, np.append(0, np.cumsum(x[refs]))[stops]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(sizes), block), pa.int64()), pa.array(np.arange(len(sizes)), pa.int32()),
                    pa.array(total(best.astype(np.int64)), pa.int64()), pa.array(total(n.astype(np.int64)), pa.int64()),
                ],
                ["block", "at", "n_best", "count_sum"],
            )
