"""A Bloom filter as a small table, tested where the large side is scanned.

Every key sets three bits in one of ``WORDS`` 64-bit words, so a filter has at most
``WORDS`` rows (16 MB) whatever it was made of, and can always be broadcast. Testing
is a hash join on the word's number with a bit test as its condition: it stays in
generated code, and rows that cannot match never reach a shuffle. With n keys about
(1 - exp(-3n / 64 WORDS))^3 of the other rows pass: 0.3 % for four million keys, half
for a hundred times the words; a fuller filter only stops less, so results never
depend on it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 2**20


def _word(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(WORDS)).cast("int")


def _bits(key: Column) -> Column:
    """Three of 64 bits, from a hash that does not follow the word's."""
    h = F.xxhash64(key, F.lit(1))
    one = F.lit(1).cast("long")
    bits = [F.call_function("shiftleft", one, F.shiftrightunsigned(h, at).bitwiseAND(63).cast("int")) for at in (0, 20, 40)]
    return bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2])


def bloom(keys: DataFrame, key: str | Column) -> DataFrame:
    """(word, bits) of all keys; null keys set nothing."""
    key = F.col(key) if isinstance(key, str) else key
    return (
        keys.filter(key.isNotNull()).select(_word(key).alias("word"), _bits(key).alias("bits"))
        .groupBy("word").agg(F.bit_or("bits").alias("bits"))
    )


def may_match(df: DataFrame, key: Column, held: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows of df whose key may be in the filter; with ``left_anti``, rows whose key
    is certainly not. A null key is not."""
    word, bits = (f"{n}_{uuid.uuid4().hex}" for n in ("word", "bits"))
    small = F.broadcast(held.select(F.col("word").alias(word), F.col("bits").alias(bits)))
    own = _bits(key)
    return df.join(small, (_word(key) == F.col(word)) & (F.col(bits).bitwiseAND(own) == own) & key.isNotNull(), how)
