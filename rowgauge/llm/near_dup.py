"""Near-duplicate groups: MinHash bands propose, odd sketches sift, full sets decide.

A document's set is its distinct five-word shingles. Documents with one and the
same set form a class, and only one row a class goes on. The class's MinHash
samples are cut into bands, and folded into an odd sketch: a bitmap in which
every sample flips one bit. The XOR of two sketches counts the samples in which
two classes differ, most precisely where they differ in few.

No group is paired with itself. In each band bucket the members are compared
with a hub, the one that shares most buckets with others; verified links make
components. Then the members outside their hub's component meet all members of
other components, in salted blocks, and only pairs that pass the sketch test
leave the join. A pair within one component can add nothing and is not looked at.
Copies of one text that differ too much to be linked make crowds in which sketches
cannot tell enough; there, shingles that few hold decide: pairs that share one are
found by it, and others must reach the similarity with the rest of their sets.

Results in odd cases
--------------------
- Fewer words than a shingle: the whole sequence is the one element. No words or
  null text: empty set, linked with nothing, its own component.
- Repeated rows and rows of one id are judged each on its own text.
- Rows without an id sort last; a component of such rows only has a null id.
- Extra columns are dropped by near_duplicates and kept by drop_near_duplicates.
- An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowgauge.llm import common

SHINGLE = 5
BANDS, ROWS = 24, 4
SKETCH_BITS = 512
#: Standard deviations of slack in the sketch test.
SLACK = 4.5
#: Most members of a bucket that meet the bucket's leftovers in one task.
BLOCK = 2000
#: Buckets with more members are crowded, and shingles that so many classes hold at most are rare.
CROWD, RARE = 100, 16

SIGNATURE = "_id bigint, _n bigint, _set binary, _bands array<bigint>, _sketch array<bigint>"
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SAMPLES = BANDS * ROWS


def _multipliers() -> np.ndarray:
    rng = np.random.default_rng(20240501)
    return rng.integers(0, 2**63, _SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _chain(parts: list[np.ndarray]) -> np.ndarray:
    h = parts[0] * _MIX
    for part in parts[1:]:
        h = (h ^ (h >> np.uint64(29))) * _MIX + part
    return h ^ (h >> np.uint64(32))


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of one text.

    bytes.lower() touches A-Z only, bytes.split() cuts at [\\x20\\x09-\\x0D].
    """
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(words) < SHINGLE:
        return _chain([h[i : i + 1] for i in range(len(words))])
    return np.unique(_chain([h[i : len(h) - SHINGLE + 1 + i] for i in range(SHINGLE)]))


def samples(items: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    least = np.full(_SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(items), 4096):  # bounds the memory for long texts
        np.minimum(least, (items[None, i : i + 4096] * multipliers[:, None]).min(axis=1), out=least)
    return least


def bands(least: np.ndarray) -> np.ndarray:
    parts = least.reshape(BANDS, ROWS)
    return _chain([np.arange(BANDS, dtype=np.uint64), *[parts[:, j] for j in range(ROWS)]]).view(np.int64)


def odd_sketch(least: np.ndarray) -> np.ndarray:
    at = (_chain([np.arange(_SAMPLES, dtype=np.uint64), least]) % np.uint64(SKETCH_BITS)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=SKETCH_BITS) & 1).astype(np.uint8)).view(np.int64)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(rows) if rows else [], pa.int64()))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    multipliers, none = _multipliers(), np.empty(0, np.int64)
    for batch in batches:
        sizes, sets, buckets, sketches = [], [], [], []
        for text in batch.column(1).cast(pa.binary()):
            items = shingles(text.as_py())
            sizes.append(len(items))
            sets.append(xxhash.xxh3_128_digest(items.tobytes()))
            least = samples(items, multipliers) if len(items) else None
            buckets.append(none if least is None else bands(least))
            sketches.append(none if least is None else odd_sketch(least))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(sets, pa.binary()), _lists(buckets), _lists(sketches)],
            ["_id", "_n", "_set", "_bands", "_sketch"],
        )


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [shingles(t.as_py()) for t in batch.column(1).cast(pa.binary())]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), batch.column(2), batch.column(3),
                pa.array([xxhash.xxh3_128_digest(r.tobytes()) for r in rows], pa.binary()),
                _lists([r.view(np.int64) for r in rows]),
            ],
            ["_class", "_want", "_many", "_set", "_items"],
        )


def most_bits(threshold: float) -> int:
    """Set bits in the XOR of two sketches up to which a pair may reach the threshold."""
    flips = 2 * _SAMPLES * (1 - threshold)
    mean = SKETCH_BITS / 2 * (1 - math.exp(-2 * flips / SKETCH_BITS))
    by_samples = math.exp(-2 * flips / SKETCH_BITS) * 2 * math.sqrt(_SAMPLES * threshold * (1 - threshold))
    by_bits = SKETCH_BITS / 4 * (1 - math.exp(-4 * flips / SKETCH_BITS))
    return math.ceil(mean + SLACK * math.sqrt(by_samples**2 + by_bits))


def may_link(a: Column, b: Column, n: Column, m: Column, percent: int) -> Column:
    """The sets' sizes and the sketches allow a similarity of percent / 100."""
    differ = sum(
        (F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(SKETCH_BITS // 64)), F.lit(0)
    )
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (differ <= most_bits(percent / 100))


def full_sets(docs: DataFrame, classes: DataFrame, members: DataFrame) -> DataFrame:
    """_class and _items, one row for each class that shares a bucket with another.

    Texts move here once, and only those; what follows works on these sets. Rows
    repeated under one id give their class's set several times, which only classes
    of several rows can, so only those are merged. Rows without an id are all
    candidates for each class of such rows; they meet it by set, merged in each
    task before they move.
    """
    wanted = members.select("_class").distinct().join(classes, "_class").select(
        "_class", F.col("_rep").alias("_id"), F.col("_set").alias("_want"), (F.col("_copies") > 1).alias("_many")
    )
    elements = lambda df: df.mapInArrow(_elements, "_class bigint, _want binary, _many boolean, _set binary, _items array<bigint>")
    named = docs.filter(F.col("_id") != common.NO_ID).join(wanted, "_id").select("_class", "_text", "_want", "_many")
    found = common.written(elements(named).filter(F.col("_set") == F.col("_want")).select("_class", "_many", "_items"))
    nameless = elements(
        docs.filter(F.col("_id") == common.NO_ID).select(
            F.lit(None).cast("long").alias("_class"), "_text", F.lit(None).cast("binary").alias("_want"), F.lit(True).alias("_many")
        )
    ).select("_set", "_items").dropDuplicates(["_set"])
    without_id = wanted.filter(F.col("_id") == common.NO_ID).select("_class", F.col("_want").alias("_set"))
    merged = common.written(
        found.filter("_many").select("_class", "_items").dropDuplicates(["_class"])
        .unionByName(nameless.join(without_id, "_set").select("_class", "_items"))
    )
    return found.filter("NOT _many").select("_class", "_items").unionByName(merged)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those (_a, _b) whose full sets reach the similarity.

    A hub is in many pairs; both joins are plain ones between two shuffles, which
    Spark splits where a class is too much for one task.
    """
    pairs = common.written(pairs, slim=True)
    wanted = common.written(pairs.select(F.col("_a").alias("_class")).unionAll(pairs.select("_b")).distinct(), slim=True)
    own = sets.join(wanted, "_class", "left_semi")
    side = lambda c: own.select(F.col("_class").alias(f"_{c}"), F.col("_items").alias(f"_items_{c}"))
    both = F.size(F.array_intersect("_items_a", "_items_b"))
    return common.written(
        pairs.join(side("a"), "_a").join(side("b"), "_b")
        .filter(100 * both >= percent * (F.size("_items_a") + F.size("_items_b") - both)).select("_a", "_b")
    )


def components(links: DataFrame) -> DataFrame:
    """_class and _root, the smallest class connected with it, for every class but the roots.

    Alternates two steps until only stars are left: neighbours above a node are hung
    on its smallest neighbour, then a node and its smaller neighbours are.
    """
    ends = lambda df: df.select(F.greatest("_a", "_b").alias("_u"), F.least("_a", "_b").alias("_v")).filter("_u != _v").distinct()
    edges = common.written(ends(links), slim=True)
    while True:
        for up in (True, False):
            around = edges.unionAll(edges.select(F.col("_v").alias("_u"), F.col("_u").alias("_v"))) if up else edges
            least = common.written(around.groupBy("_u").agg(F.min("_v").alias("_m"), F.count(F.lit(1)).alias("_n")), slim=True)
            least = least.withColumn("_m", F.least("_m", "_u"))
            hung = common.join_counted(around, least, ["_u"], "_n")
            if up:
                moved = hung.filter("_v > _u").select(F.col("_v").alias("_a"), F.col("_m").alias("_b"))
            else:
                moved = hung.select(F.col("_v").alias("_a"), F.col("_m").alias("_b")).unionAll(
                    least.select(F.col("_u").alias("_a"), F.col("_m").alias("_b"))
                )
            edges = common.written(ends(moved), slim=True)
        # Done once all edges are those of stars: one each for the outer nodes, whose centres are none of them.
        twice = edges.groupBy("_u").count().filter("count > 1").limit(1).count()
        if not twice and edges.join(edges.select(F.col("_u").alias("_v")).distinct(), "_v", "left_semi").isEmpty():
            return edges.select(F.col("_u").alias("_class"), F.col("_v").alias("_root"))


def _proposals(classes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Members of shared buckets, and the pairs of each with its bucket's hub."""
    dealt = classes.select("_class", F.explode("_bands").alias("_bucket"))
    shared = common.written(
        dealt.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1"),
        slim=True,
    )
    # One column keeps the count, the other one is the helper's.
    held = common.written(
        common.join_counted(dealt, shared.withColumn("_in_bucket", F.col("_n")), ["_bucket"], "_n")
    )
    known = held.groupBy("_class").agg(F.sum("_in_bucket").alias("_known"))
    facts = known.join(classes.select("_class", F.col("_n").alias("_size"), "_sketch", "_bands"), "_class")
    members = common.written(held.join(facts, "_class"))
    hubs = common.written(
        members.groupBy("_bucket").agg(
            F.max(F.struct("_known", (-F.col("_class")).alias("_minus"), "_size", "_sketch")).alias("_hub"),
            F.count(F.lit(1)).alias("_n"),
        )
    )
    pairs = (
        common.join_counted(members, hubs, ["_bucket"], "_n")
        .withColumn("_b", -F.col("_hub._minus"))
        .filter(F.col("_class") != F.col("_b"))
        .filter(may_link(F.col("_sketch"), F.col("_hub._sketch"), F.col("_size"), F.col("_hub._size"), percent))
        .select(F.col("_class").alias("_a"), "_b").distinct()
    )
    return members, pairs


def _crowds(inside: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """For the classes of crowded buckets: how many rare shingles each has, and the
    pairs across components that share one.

    A shingle is rare if RARE of these classes hold it at most, so the pairs that
    share one are few however large the crowd. Two classes that share none have
    at most what is left of the smaller one in common.
    """
    crowd = inside.filter(F.col("_in_bucket") > CROWD).select("_class", "_root", "_size").distinct()
    held = common.written(
        sets.join(crowd, "_class").select("_class", "_root", "_size", F.explode("_items").alias("_item"))
    )
    counts = common.written(held.groupBy("_item").agg(F.count(F.lit(1)).alias("_n")))
    rare = common.written(
        common.join_counted(held, counts.withColumn("_holders", F.col("_n")), ["_item"], "_n").filter(F.col("_holders") <= RARE)
    )
    numbers = rare.groupBy("_class").agg(F.count(F.lit(1)).alias("_rare"))
    shared = rare.filter("_holders > 1")
    side = lambda c: shared.select("_item", *[F.col(x).alias(x + c) for x in ("_class", "_root", "_size")])
    n, m = F.col("_size_a"), F.col("_size_b")
    pairs = side("_a").join(side("_b"), "_item").filter(
        (F.col("_class_a") < F.col("_class_b")) & (F.col("_root_a") != F.col("_root_b"))
        & (100 * F.least(n, m) >= percent * F.greatest(n, m))
    )
    everyone = crowd.select("_class").distinct().join(numbers, "_class", "left")
    return everyone.select("_class", F.coalesce("_rare", F.lit(0)).alias("_rare")), pairs.select(
        F.col("_class_a").alias("_a"), F.col("_class_b").alias("_b")
    )


def _leftovers(members: DataFrame, roots: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs across components in one bucket: members outside the bucket's largest
    component against all members of other components.

    A pair leaves the join in the first bucket that both are in, if its sizes and
    sketches allow a link, and in a crowd also only if its rare shingles do.
    """
    tagged = common.written(
        members.join(roots, "_class", "left").withColumn("_root", F.coalesce("_root", "_class"))
    )
    groups = tagged.groupBy("_bucket", "_root").agg(F.count(F.lit(1)).alias("_n"))
    mixed = common.written(
        groups.groupBy("_bucket").agg(
            F.max(F.struct("_n", "_root"))["_root"].alias("_main"), F.sum("_n").alias("_n"), F.count(F.lit(1)).alias("_groups")
        ).filter("_groups > 1").drop("_groups"),
        slim=True,
    )
    inside = common.written(common.join_counted(tagged, mixed, ["_bucket"], "_n"))
    numbers, met_by_item = _crowds(inside, sets, percent)
    known = common.written(inside.join(numbers, "_class", "left"))
    salts = F.ceil(F.col("_in_bucket") / BLOCK).cast("int")
    right = known.select(
        "_bucket", F.pmod(F.xxhash64("_class"), salts).cast("int").alias("_salt"), (F.col("_root") != F.col("_main")).alias("_out_b"),
        *[F.col(c).alias(c + "_b") for c in ("_class", "_root", "_size", "_sketch", "_bands", "_rare")],
    )
    left = known.filter("_root != _main").select(
        "_bucket", F.explode(F.sequence(F.lit(0), salts - 1)).alias("_salt"),
        *[F.col(c).alias(c + "_a") for c in ("_class", "_root", "_size", "_sketch", "_bands", "_rare")],
    )
    n, m = F.col("_size_a"), F.col("_size_b")
    common_at_most = F.least(n - F.col("_rare_a"), m - F.col("_rare_b"))
    rare_allow = F.coalesce(100 * common_at_most >= percent * (n + m - common_at_most), F.lit(True))
    shared = F.filter(F.zip_with("_bands_a", "_bands_b", lambda x, y: F.when(x == y, x)), lambda x: x.isNotNull())
    met = (
        left.join(right, ["_bucket", "_salt"])
        .filter((F.col("_root_a") != F.col("_root_b")) & (~F.col("_out_b") | (F.col("_class_a") < F.col("_class_b"))) & rare_allow)
        .filter(may_link(F.col("_sketch_a"), F.col("_sketch_b"), n, m, percent))
        .filter(F.get(shared, F.lit(0)) == F.col("_bucket"))
        .select(F.col("_class_a").alias("_a"), F.col("_class_b").alias("_b"))
    )
    return met.unionAll(met_by_item).distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """One row per row of df: the id, n_shingles, component_id and kept.

    Rows are linked at 100 * intersection >= percent * union of their sets;
    component_id is the smallest id in reach, kept says that it is the row's own.
    """
    common.share_code(df.sparkSession)
    docs = df.select(common.whole_id(id_col).alias("_id"), F.col(text_col).alias("_text"))
    signed = common.written(docs.mapInArrow(_sign, SIGNATURE))
    classes = common.written(
        signed.filter("_n > 0").groupBy("_set").agg(
            F.min("_id").alias("_rep"), F.count(F.lit(1)).alias("_copies"), F.max("_n").alias("_n"),
            F.first("_bands").alias("_bands"), F.first("_sketch").alias("_sketch"),
        ).withColumn("_class", F.monotonically_increasing_id())
    )
    members, pairs = _proposals(classes, percent)
    sets = full_sets(docs, classes, members)
    links = verified(pairs, sets, percent)
    more = verified(_leftovers(members, components(links), sets, percent), sets, percent)
    roots = components(links.unionAll(more))
    rooted = common.written(
        classes.select("_class", "_set", "_rep", "_copies").join(roots, "_class", "left")
        .withColumn("_root", F.coalesce("_root", "_class")),
        slim=True,
    )
    first = common.written(rooted.groupBy("_root").agg(F.min("_rep").alias("_first"), F.count(F.lit(1)).alias("_n")), slim=True)
    named = common.written(common.join_counted(rooted, first, ["_root"], "_n").select("_set", "_first", "_copies"), slim=True)
    grouped = common.join_counted(signed.filter("_n > 0").select("_id", "_n", "_set"), named, ["_set"], "_copies")
    rows = grouped.select("_id", "_n", "_first").unionAll(
        signed.filter("_n = 0").select("_id", "_n", F.col("_id").alias("_first"))
    )
    real = lambda c: F.when(F.col(c) != common.NO_ID, F.col(c))
    return rows.select(
        real("_id").alias(id_col), F.col("_n").alias("n_shingles"), real("_first").alias("component_id"),
        (F.col("_id") == F.col("_first")).alias("kept"),
    )


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """df with the smallest id of each component; rows of one id stay or go together."""
    copies = near_duplicates(df, id_col, text_col, percent).filter("NOT kept").select(
        common.whole_id(id_col).alias("_copy")
    ).distinct()
    return df.join(common.written(copies), common.whole_id(id_col) == F.col("_copy"), "left_anti")
