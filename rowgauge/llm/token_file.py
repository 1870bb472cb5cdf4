"""Token ids as Huffman-coded blocks, and back.

The corpus is written in rising id order. Each row of the file is one block: a
run of whole documents of one file part, coded with one canonical Huffman code
for all, whose lengths are limited so that one table look-up decodes an id. A
block is decoded on its own; checkpoints hold the bit offset of every
`STRIDE`-th id, and all checkpoints of a block are decoded side by side.

The file is a Parquet folder, so that any store and any lost task are Spark's
business: `blocks` with the payloads, `code` with the lengths by id.

Results in odd cases
--------------------
- A null or empty text has the end id only.
- Repeated rows are written each; rows of one id stand next to each other in any order.
- Rows without an id are written last, in any order.
- A document longer than a block is a block of its own.
- Extra columns are dropped, so none can clash.
- An empty table gives a file without blocks, and an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rowgauge.llm import common, tokens

BLOCK_IDS = 1 << 18
STRIDE = 128
LONGEST_CODE = 16
RAW = "part int, block int, start bigint, doc_ids array<bigint>, sizes array<bigint>, ids binary"
CODED = (
    "part int, block int, start bigint, doc_ids array<bigint>, sizes array<bigint>, n_ids bigint,"
    " checkpoints array<bigint>, payload binary"
)
READ = "part int, doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def code_lengths(counts: list[int], longest: int = LONGEST_CODE) -> np.ndarray:
    """Lengths of the best prefix code of at most `longest` bits, by package-merge.

    Symbols that never occur get length 0. Packages carry counts of symbols by
    rank, not lists of them: a package of the final n-1 pairs uses a prefix of
    the sorted symbols at each level.
    """
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    order = used[np.argsort(np.asarray(counts, np.int64)[used], kind="stable")]
    weights = np.asarray(counts, np.int64)[order]
    n = len(order)
    if n > 1 << longest:
        raise ValueError(f"{n} symbols have no code of at most {longest} bits")
    # is_leaf[level][k]: the k-th cheapest entry of the level is a symbol, not a package.
    packages, is_leaf = np.empty(0, np.int64), []
    for _ in range(longest):
        merged = np.concatenate([weights, packages])
        rank = np.argsort(merged, kind="stable")
        is_leaf.append(rank < n)
        merged = merged[rank]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
    take = 2 * n - 2
    for leaves in reversed(is_leaf):
        symbols = int(leaves[:take].sum())
        lengths[order[:symbols]] += 1
        take = 2 * (take - symbols)
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes by length, then id."""
    codes = np.zeros(len(lengths), np.uint64)
    code, last = 0, 0
    for symbol in np.lexsort((np.arange(len(lengths)), lengths)):
        if lengths[symbol]:
            code <<= int(lengths[symbol]) - last
            last = int(lengths[symbol])
            codes[symbol] = code
            code += 1
    return codes


def decoding_table(lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Id and code length for every value of the next LONGEST_CODE bits."""
    symbols, sizes = np.zeros(1 << LONGEST_CODE, np.uint32), np.ones(1 << LONGEST_CODE, np.uint8)
    used = np.flatnonzero(lengths)
    used = used[np.argsort(codes[used] << (LONGEST_CODE - lengths[used].astype(np.uint64)))]
    width = 1 << (LONGEST_CODE - lengths[used].astype(np.int64))
    symbols[: width.sum()] = np.repeat(used, width)
    sizes[: width.sum()] = np.repeat(lengths[used], width)
    return symbols, sizes


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Big-endian bit string of the ids' codes, and the bit offset of every STRIDE-th."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    at = ends - size
    words = np.zeros(int(ends[-1] + 63) // 64 + 1 if len(ids) else 0, np.uint64)
    if len(ids):
        word, room = at >> 6, 64 - (at & 63) - size
        code = codes[ids]
        first = np.where(room >= 0, code << np.maximum(room, 0).astype(np.uint64), code >> np.maximum(-room, 0).astype(np.uint64))
        heads = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        words[word[heads]] = np.bitwise_or.reduceat(first, heads)
        over = np.flatnonzero(room < 0)
        words[word[over] + 1] |= code[over] << (64 + room[over]).astype(np.uint64)
    return words.astype(">u8").tobytes(), at[::STRIDE]


def unpack(payload: bytes, checkpoints: np.ndarray, n: int, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The n ids of a block; step k decodes the k-th id after every checkpoint."""
    data = np.frombuffer(payload + b"\0\0\0\0", np.uint8).astype(np.uint32)
    at = np.asarray(checkpoints, np.int64).copy()
    out = np.zeros((STRIDE, len(at)), np.uint32)
    for k in range(min(STRIDE, n)):
        if len(at) * STRIDE > n and k >= n - (len(at) - 1) * STRIDE:
            lanes = slice(0, len(at) - 1)
        else:
            lanes = slice(0, len(at))
        byte = at[lanes] >> 3
        ahead = (data[byte] << np.uint32(16)) | (data[byte + 1] << np.uint32(8)) | data[byte + 2]
        value = (ahead >> (8 - (at[lanes] & 7)).astype(np.uint32)) & np.uint32(0xFFFF)
        out[k, lanes] = symbols[value]
        at[lanes] += sizes[value]
    return out.T.reshape(-1)[:n]


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = tokens.encoder(path), np.array([end_id], "<u4").tobytes()
        part = TaskContext.get().partitionId()
        block = start = held = 0
        docs, sizes, parts = [], [], []

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(
                {"part": [part], "block": [block], "start": [start], "doc_ids": [docs], "sizes": [sizes], "ids": [b"".join(parts)]},
                pa.schema([("part", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("ids", pa.binary())]),
            )

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = encoder.encode(text.as_py() or "") + end
                docs.append(doc.as_py())
                sizes.append(len(ids) // 4)
                parts.append(ids)
                held += sizes[-1]
                if held >= BLOCK_IDS:
                    yield flush()
                    block, start, held = block + 1, start + held, 0
                    docs, sizes, parts = [], [], []
        if docs:
            yield flush()

    return run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        for ids in batch.column(0):
            own = np.bincount(np.frombuffer(ids.as_py(), "<u4"))
            if len(own) > len(total):
                own, total = total, own
            total[: len(own)] += own
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "n"])


def _code(lengths: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = canonical(lengths)
        for batch in batches:
            n, checkpoints, payloads = [], [], []
            for ids in batch.column("ids"):
                own = np.frombuffer(ids.as_py(), "<u4")
                payload, marks = pack(own, lengths, codes)
                n.append(len(own))
                checkpoints.append(marks.tolist())
                payloads.append(payload)
            kept = [batch.column(c) for c in ("part", "block", "start", "doc_ids", "sizes")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(n, pa.int64()), pa.array(checkpoints, pa.list_(pa.int64())), pa.array(payloads, pa.binary())],
                ["part", "block", "start", "doc_ids", "sizes", "n_ids", "checkpoints", "payload"],
            )

    return run


def _decode(lengths: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols, sizes = decoding_table(lengths, canonical(lengths))
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack(row["payload"], np.array(row["checkpoints"], np.int64), row["n_ids"], symbols, sizes)
                ends = np.cumsum([0, *row["sizes"]])
                crcs = [tokens.crc(ids[a:b].astype("<u4").tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["part"]] * len(crcs), pa.int32()), pa.array(row["doc_ids"], pa.int64()),
                        pa.array(ends[:-1] + row["start"], pa.int64()), pa.array(row["sizes"], pa.int64()), pa.array(crcs, pa.int64()),
                    ],
                    ["part", "doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return run


def write_tokens(
    df: DataFrame, path: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Encode every text and write the file to `path`.

    Texts are range-partitioned by id before they are encoded, so that they are
    encoded once. The counts come back to the driver: one number an id of the
    vocabulary at most, whatever the corpus.
    """
    spark = df.sparkSession
    common.share_code(spark)
    whole = common.whole_id(id_col)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    raw = common.written(
        df.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"), whole.alias("_order"))
        .repartitionByRange(partitions, "_order").sortWithinPartitions("_order")
        .select("_id", "_text").mapInArrow(_encode(tokenizer, end_id), RAW)
    )
    counted = raw.select("ids").mapInArrow(_count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = [0] * (max((r["id"] for r in counted), default=0) + 1)
    for r in counted:
        counts[r["id"]] = r["n"]
    lengths = code_lengths(counts)
    raw.mapInArrow(_code(lengths), CODED).write.mode("overwrite").parquet(f"{path}/blocks")
    spark.createDataFrame([(bytes(lengths),)], "lengths binary").coalesce(1).write.mode("overwrite").parquet(f"{path}/code")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the file, decoded.

    Starts within a part stand in its blocks; the parts' own starts are running
    sums over one row a part.
    """
    common.share_code(spark)
    lengths = np.frombuffer(spark.read.parquet(f"{path}/code").first()["lengths"], np.uint8)
    blocks = spark.read.parquet(f"{path}/blocks")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("_n")).select(
        "part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    return blocks.mapInArrow(_decode(lengths), READ).join(parts, "part").select(
        "doc_id", (F.col("start") + F.col("_before")).alias("start"), "n_tokens", "ids_crc32"
    )
