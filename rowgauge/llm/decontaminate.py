"""Benchmark decontamination by spaced seeds.

A mask of a fixed span looks at some positions of a window of words and ignores
the others, so that a window with other words at the ignored positions still has
the hash of the benchmark's. Test and training windows meet by hash; around each
hit both texts are compared word by word, and an overlap counts when enough words
agree in some stretch of both: the window alone, or with words next to it. A
passage need not go on beyond its window, so every exact run of a span is found.

Results in odd cases
--------------------
- A null or empty text, and a document of fewer words than a window, has no hits.
- Items shorter than the span are looked for by windows of `short` words, items
  shorter than that not at all: so few words also occur in clean documents. Of a
  short item all that is aligned must agree as far, not only the window.
- Repeated rows and rows without an id are searched alike; rows of one id count as one document.
- Repeated items, and items without an id, are searched for under the id they have.
- Extra columns are dropped by find_leaks and kept by drop_leaks.
- Empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowgauge.llm import common

#: Fixed masks of span 12; 1 is a position that is looked at.
MASKS = ("110110101101", "101011011011")
SHORT = 5
FLANK = 6
#: Of ten aligned words, so many must agree.
AGREE = 8
#: Rows of seeds up to which they are broadcast: some 250 bytes each, so 100 MB at most.
BROADCAST_SEEDS = 400_000


def word_hashes(text: Column) -> Column:
    """Hashes of the runs of letters and digits, lower-cased."""
    runs = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.transform(runs, lambda w: F.xxhash64(w))


def windows(df: DataFrame, span: int) -> DataFrame:
    """df (with _h) and one row per window: _at, its first word."""
    last = F.size("_h") - span
    return df.withColumn("_at", F.explode(F.when(last >= 0, F.sequence(F.lit(0), last))))


def seeds(df: DataFrame, masks: tuple[str, ...]) -> DataFrame:
    """df with one row per window and mask: _at and _seed."""
    span = len(masks[0])
    hashes = [
        F.xxhash64(F.lit(m), *[F.get("_h", F.col("_at") + k) for k in range(span) if mask[k] == "1"])
        for m, mask in enumerate(masks)
    ]
    return windows(df, span).withColumn("_seed", F.explode(F.array(*hashes)))


def around(h: str, at: str, span: int) -> list[Column]:
    """Up to FLANK words before a window, and the window with up to FLANK after it."""
    before = F.least(F.col(at), F.lit(FLANK))
    return [F.slice(h, F.col(at) - before + 1, before), F.slice(h, F.col(at) + 1, span + FLANK)]


def verified(left: str, right: str, other_left: str, other_right: str, span: int, whole: bool) -> Column:
    """(aligned, same) of the longest stretch that holds the window and in which
    enough words agree, null if there is none: the window with 0 to FLANK words on
    each side. whole: of all aligned words only.

    The counts of a hit are put in a row of one struct, so that each is made once
    and not once a stretch.
    """
    agree = lambda a, b: F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    count = lambda flags: F.size(F.filter(flags, lambda e: e))
    # How many agree in the first 0, 1, 2, ... words next to the window.
    sums = lambda flags, n: F.transform(F.sequence(F.lit(0), n), lambda k: count(F.slice(flags, F.lit(1), k)))
    before = F.least(F.size(left), F.size(other_left))
    after = F.least(F.size(right), F.size(other_right)) - span
    counts = F.struct(
        count(agree(F.slice(right, 1, span), F.slice(other_right, 1, span))).alias("window"),
        sums(agree(F.reverse(left), F.reverse(other_left)), before).alias("before"),
        sums(agree(F.slice(right, span + 1, FLANK), F.slice(other_right, span + 1, FLANK)), after).alias("after"),
    )

    def best(c: Column) -> Column:
        def stretch(x: Column, i: Column, y: Column, j: Column) -> Column:
            aligned, same = i + j + span, c["window"] + x + y
            enough = 10 * same >= AGREE * aligned
            if whole:
                enough = enough & (i == F.size(c["before"]) - 1) & (j == F.size(c["after"]) - 1)
            return F.when(enough, F.struct(aligned.alias("aligned"), same.alias("same")))

        return F.array_max(F.flatten(F.transform(c["before"], lambda x, i: F.transform(c["after"], lambda y, j: stretch(x, i, y, j)))))

    return F.get(F.transform(F.array(counts), best), F.lit(0))


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", masks: tuple[str, ...] = MASKS,
) -> DataFrame:
    """One row per document and item that overlap: the two ids, n_windows (distinct
    verified pairs of windows), first_word (of the first such window in the
    document), best_match (the largest share of words that agree around a hit, in the
    longest stretch that reaches AGREE of ten).

    Seeds of a benchmark of up to BROADCAST_SEEDS windows and masks are broadcast
    to the documents, so that only hits move. Those of a larger one are joined by
    shuffle.
    """
    doc = docs.select(F.col(id_col).alias("_id"), word_hashes(F.col(text_col)).alias("_h"))
    item = common.written(
        benchmark.select(F.col(item_col).alias("_item"), word_hashes(F.col(item_text_col)).alias("_h"))
    )
    span = len(masks[0])
    n_short, n_seeds = item.agg(
        F.count_if((F.size("_h") >= SHORT) & (F.size("_h") < span)),
        F.sum(F.when(F.size("_h") >= SHORT, F.size("_h") * len(masks))),
    ).first()
    small = (n_seeds or 0) <= BROADCAST_SEEDS
    hits = _hits(doc, item.filter(F.size("_h") >= span), masks, small, whole=False)
    if n_short:
        brief = item.filter((F.size("_h") >= SHORT) & (F.size("_h") < span))
        hits = hits.unionByName(_hits(doc, brief, ("1" * SHORT,), small, whole=True))
    return (
        hits.groupBy("_id", "_item", "_at", "_item_at").agg(F.max("_share").alias("_share"))
        .groupBy("_id", "_item").agg(
            F.count(F.lit(1)).alias("n_windows"), F.min("_at").cast("long").alias("first_word"),
            F.max("_share").alias("best_match"),
        )
        .select(F.col("_id").alias(id_col), F.col("_item").alias(item_col), "n_windows", "first_word", "best_match")
    )


def _hits(doc: DataFrame, item: DataFrame, masks: tuple[str, ...], small: bool, whole: bool) -> DataFrame:
    """Verified pairs of windows.

    The comparison must not become a condition of the join: with its lambdas the
    join could not be compiled together with the generators below it, and each
    window of a document would be kept with a copy of all its words. A filter is
    not moved below a column that depends on the task, hence _task.
    """
    span = len(masks[0])
    named = lambda *names: [c.alias(n) for c, n in zip(around("_h", "_at", span), names, strict=True)]
    test = seeds(item, masks).select("_seed", "_item", F.col("_at").alias("_item_at"), *named("_item_left", "_item_right"))
    train = seeds(doc, masks)
    if small:
        met = train.join(F.broadcast(test), "_seed").select(
            "_id", "_item", "_at", "_item_at", "_item_left", "_item_right", *named("_left", "_right"), F.spark_partition_id().alias("_task")
        )
    else:
        met = train.select("_seed", "_id", "_at", *named("_left", "_right")).join(test.hint("merge"), "_seed").withColumn(
            "_task", F.spark_partition_id()
        )
    return (
        met.filter("_task >= 0")
        .select("_id", "_item", "_at", "_item_at", verified("_left", "_right", "_item_left", "_item_right", span, whole).alias("_best"))
        .filter(F.col("_best").isNotNull())
        .select("_id", "_item", "_at", "_item_at", F.round(F.col("_best.same") / F.col("_best.aligned"), 4).alias("_share"))
    )


def drop_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more: str
) -> DataFrame:
    """docs without those that overlap an item. Rows without an id cannot be told
    apart and go together."""
    leaked = find_leaks(docs, benchmark, id_col, text_col, **more).select(
        common.whole_id(id_col).alias("_leaked")
    ).distinct()
    return docs.join(leaked, common.whole_id(id_col) == F.col("_leaked"), "left_anti")
