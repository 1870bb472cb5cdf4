"""Packing documents into sequences by the sum of squares.

Of the places a piece fits in, it takes the one after which the squared counts
of open sequences per gap sum to least: gaps that many sequences have are used
up, gaps that few have are left. The state is one count per gap, and a piece
costs one pass over the gaps. Pieces are dealt to groups of some ten thousand,
packed side by side; each leaves a few sequences open, a small share of
what it fills. Within a group the longer pieces come in hashed order and the
shortest last, long to short: they fill what gaps are left.

Results in odd cases
--------------------
- A null or empty text has the end id only.
- Documents longer than a sequence are cut into full sequences and a last piece.
- Repeated rows, rows of one id and rows without an id are packed each.
- Extra columns are dropped, so none can clash.
- An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowgauge.llm import common, tokens

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
#: Pieces a group, on average.
GROUP = 20_000
#: Share of a group's pieces, the shortest, that come last.
FILLERS = 0.15
COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
NEVER = np.iinfo(np.int64).max


def _cut(path: str, end_id: int, room: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = tokens.encoder(path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = encoder.encode(text.as_py() or "") + end
                for piece, at in enumerate(range(0, len(ids), 4 * room)):
                    part = ids[at : at + 4 * room]
                    rows.append((doc.as_py(), piece, at // 4, len(part) // 4, tokens.crc(part)))
            doc, piece, start, length, crc = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc)]],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


def place(lengths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each length, in the order given.

    Moving a sequence from gap g to gap g - s changes the sum of squares by
    2 * (n[g - s] - n[g] + 1), closing one by 1 - 2 * n[g], opening one by
    2 * n[room - s] + 1. Ties go to the smallest gap left.
    """
    counts = np.zeros(room + 1, np.int64)
    open_at: list[list[int]] = [[] for _ in range(room + 1)]
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    made = 0
    for i, s in enumerate(lengths.tolist()):
        there = counts[s:]
        cost = np.where(there > 0, 2 * (counts[: room + 1 - s] - there + 1), NEVER)
        if there[0]:
            cost[0] = 1 - 2 * there[0]
        cost[-1] = 2 * counts[room - s] + 1
        g = int(np.argmin(cost)) + s
        if g == room:
            seq, made = made, made + 1
        else:
            seq = open_at[g].pop()
            counts[g] -= 1
        bins[i], offsets[i] = seq, room - g
        if g > s:
            open_at[g - s].append(seq)
            counts[g - s] += 1
    return bins, offsets


def _pack(room: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        short = group["length"].rank(method="first") <= FILLERS * len(group)
        group = group.assign(_short=short, _by=np.where(short, -group["length"], group["_order"])).sort_values(
            ["_short", "_by", "_order", "doc_id", "piece"], kind="stable"
        )
        bins, offsets = place(group["length"].to_numpy(), room)
        return group.assign(sequence_id=group["_group"] * 2**32 + bins, offset=offsets)[COLUMNS]

    return run


def pieces(df: DataFrame, tokenizer: str, room: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(_cut(tokenizer, end_id, room), PIECES)


def pack_documents(
    df: DataFrame, tokenizer: str, room: int = 4096, end_id: int = 1,
    id_col: str = "doc_id", text_col: str = "text", group: int = GROUP,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    common.share_code(df.sparkSession)
    cut = common.written(pieces(df, tokenizer, room, end_id, id_col, text_col))
    groups = max(1, cut.filter(F.col("length") < room).count() // group)
    full = cut.filter(F.col("length") >= room).select(
        "*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    # Lengths are dealt evenly: the hash does not depend on them.
    order = F.xxhash64("doc_id", "piece", "ids_crc32", "start")
    dealt = cut.filter(F.col("length") < room).select(
        "*", order.alias("_order"), F.pmod(F.xxhash64(F.lit(1), order), F.lit(groups)).alias("_group")
    )
    packed = dealt.groupBy("_group").applyInPandas(_pack(room), f"{PIECES}, sequence_id bigint, offset bigint")
    return packed.unionByName(full)
