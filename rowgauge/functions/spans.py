"""Matches of patterns as byte ranges of a text, and texts rebuilt around them.

Everything is linear in the text and its matches: places are bytes, so that pieces
are cut without counting characters from the start, and running sums are made block
by block, so that no array grows element by element beyond a block.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bind

BLOCK = 256
#: Characters that are no text in any language; one that a text lacks marks its matches.
NO_CHARACTERS = [chr(c) for c in range(0xFDD0, 0xFDF0)]


def _sums_of_block(values: Column) -> Column:
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(
        values, start,
        lambda s, v: F.struct((s["at"] + v).alias("at"), F.array_append(s["out"], s["at"]).alias("out")),
        lambda s: s["out"],
    )


def running_sums(values: Column) -> Column:
    """The sum of all ints before each one; an empty array for an empty one."""

    def summed(values: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1)), F.lit(BLOCK)), lambda i: i <= F.size(values))
        return bind(F.transform(starts, lambda i: F.slice(values, i, F.lit(BLOCK))), over)

    def over(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda s, v: s + v))
        return F.flatten(F.zip_with(blocks, _sums_of_block(totals), lambda b, start: F.transform(_sums_of_block(b), lambda v: v + start)))

    return bind(values, summed)


def marked_parts(text: Column, pattern: str) -> Column:
    """The text cut at its matches: every other part is one, the first is none. Null
    where nothing matches."""
    mark = F.lit(NO_CHARACTERS[-1])
    for c in reversed(NO_CHARACTERS[:-1]):
        mark = F.when(~text.contains(c), F.lit(c)).otherwise(mark)
    return F.when(text.rlike(pattern), F.split(F.regexp_replace(text, F.lit(pattern), F.concat(mark, F.lit("$0"), mark)), mark))


def spans(parts: Column) -> Column:
    """(start, end) bytes of every match and the match itself, in order, from marked parts."""
    placed = F.zip_with(
        parts, running_sums(F.transform(parts, F.octet_length)),
        lambda part, start: F.struct(start.alias("start"), (start + F.octet_length(part)).alias("end"), part.alias("match")),
    )
    return F.filter(placed, lambda x, i: i % 2 == 1)


def rebuilt(text: Column, found: Column, put) -> Column:
    """The text with ``put(span)`` in place of every span; spans are in order and apart."""

    def build(found: Column, data: Column) -> Column:
        def piece(span: Column, i: Column) -> Column:
            before = F.coalesce(F.get(found, i - 1)["end"], F.lit(0))
            return F.concat(F.substring(data, before + 1, span["start"] - before).cast("string"), put(span))

        tail = F.substring(data, F.element_at(found, -1)["end"] + 1, F.octet_length(data)).cast("string")
        return F.array_join(F.array_append(F.transform(found, piece), tail), "")

    changed = bind(text.cast("binary"), lambda data: bind(found, lambda f: build(f, data)))
    return F.when(F.coalesce(F.size(found), F.lit(0)) > 0, changed).otherwise(text)
