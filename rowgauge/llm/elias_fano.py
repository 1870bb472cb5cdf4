"""Tries of integer rows in Elias-Fano levels, searched for many rows at once.

Every level is two rising sequences: the ids, made rising over the whole level by
adding up the last ids of the nodes before, and the pointers to where each node's
children begin. A rising sequence of n numbers below u is kept in the lower
log2(u / n) bits of each and a bit vector of about 2n bits for the upper ones. All
levels and the leaves' values lie in one buffer, which may be a mapped file.
"""

from __future__ import annotations

import numpy as np

ONE = np.uint64(1)
FULL = np.uint64(2**64 - 1)
#: Of each byte and k: the place of its k-th one.
IN_BYTE = np.array([([i for i in range(8) if b >> i & 1] + [0] * 8)[:8] for b in range(256)], np.int64).reshape(-1)


class BitVector:
    """Bits with select: the place of the k-th one or zero, for arrays of k."""

    def __init__(self, words: np.ndarray):
        self.words = words
        ones = np.bitwise_count(words).astype(np.int64)
        self.ones = np.append(0, np.cumsum(ones))
        self.zeros = 64 * np.arange(len(words) + 1) - self.ones

    def select(self, k: np.ndarray, one: bool) -> np.ndarray:
        before = self.ones if one else self.zeros
        at = np.searchsorted(before, k, side="right") - 1
        word = self.words[at] if one else self.words[at] ^ FULL
        left, place = (k - before[at]).astype(np.int64), np.zeros(len(k), np.int64)
        for width in (32, 16, 8):
            low = np.bitwise_count(word & np.uint64((1 << width) - 1)).astype(np.int64)
            over = left >= low
            left -= np.where(over, low, 0)
            step = np.where(over, width, 0)
            place += step
            word = word >> step.astype(np.uint64)
        return 64 * at + place + IN_BYTE[(word & np.uint64(255)).astype(np.int64) << 3 | left]

    def following(self, place: np.ndarray, k: np.ndarray, one: bool) -> np.ndarray:
        """The place of the k-th one or zero, given that of the one before it: mostly in the same word."""
        after = place + 1
        word = self.words[np.minimum(after >> 6, len(self.words) - 1)]
        word = (word if one else word ^ FULL) >> (after & 63).astype(np.uint64)
        got = after + np.bitwise_count((word & (~word + ONE)) - ONE)
        far = np.flatnonzero((word == 0) | (after >> 6 >= len(self.words)))
        got[far] = self.select(k[far], one)
        return got


class Rising:
    """A rising sequence of numbers from 0 on."""

    def __init__(self, buffer, at: int = 0):
        self.n, self.low_bits, n_low, n_high = (int(x) for x in np.frombuffer(buffer, "<i8", 4, at))
        at += 32
        # Numbers of low_bits bits begin at any bit: eight bytes from any byte on hold one.
        self.low = np.ndarray((max(0, n_low - 7),), "<u8", buffer, at, (1,))
        self.upper = BitVector(np.frombuffer(buffer, "<u8", n_high, at + n_low))
        self.end = at + n_low + 8 * n_high

    @staticmethod
    def pack(values: np.ndarray) -> bytes:
        values = values.astype(np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        bits = min(56, max(0, ((top + 1) // max(1, n)).bit_length() - 1))
        low = np.zeros((n, bits), np.uint8)
        for k in range(bits):
            low[:, k] = (values >> np.uint64(k)) & ONE
        packed = np.packbits(low.reshape(-1), bitorder="little").tobytes() + bytes(8)
        packed += bytes(-len(packed) % 8)
        high = np.zeros(-(-(n + (top >> bits) + 2) // 64) * 64, np.uint8)
        high[(values >> np.uint64(bits)).astype(np.int64) + np.arange(n)] = 1
        words = np.packbits(high, bitorder="little").tobytes()
        return np.array([n, bits, len(packed), len(words) // 8], "<i8").tobytes() + packed + words

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        bit = i * self.low_bits
        return (self.low[bit >> 3] >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.low_bits) - 1)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        high = (self.upper.select(i, True) - i).astype(np.uint64)
        return ((high << np.uint64(self.low_bits)) | self.lows(i)).astype(np.int64)

    def with_next(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The i-th numbers and those after them."""
        place = self.upper.select(i, True)
        after = self.upper.following(place, i + 1, True)
        whole = lambda x, at: ((x - at).astype(np.uint64) << np.uint64(self.low_bits) | self.lows(at)).astype(np.int64)
        return whole(place, i), whole(after, i + 1)

    def find(self, x: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """A place in start..stop whose number is x, or -1."""
        x = x.astype(np.uint64)
        high = (x >> np.uint64(self.low_bits)).astype(np.int64)
        wanted = x & np.uint64((1 << self.low_bits) - 1)
        # Numbers with these upper bits lie between two zeros.
        last = int(self.upper.zeros[-1]) - 1
        before = np.clip(high - 1, 0, last)
        zero = self.upper.select(before, False)
        ends = self.upper.following(zero, np.minimum(before + 1, last), False) - (before + 1)
        left = np.clip(np.where(high <= 0, 0, zero - before), start, stop)
        right = np.clip(np.where((high <= 0) | (before >= last), zero - before, ends), start, stop)
        limit = right
        while True:
            open_ = left < right
            if not open_.any():
                break
            middle = (left + right) >> 1
            less = np.zeros(len(x), bool)
            less[open_] = self.lows(middle[open_]) < wanted[open_]
            left = np.where(open_ & less, middle + 1, left)
            right = np.where(open_ & ~less, middle, right)
        hit = np.flatnonzero(left < limit)
        hit = hit[self.lows(left[hit]) == wanted[hit]]
        place = np.full(len(x), -1)
        place[hit] = left[hit]
        return place

    def successor(self, x: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """First place in start..stop whose number is at least x, or stop."""
        x = x.astype(np.uint64)
        high = (x >> np.uint64(self.low_bits)).astype(np.int64)
        wanted = x & np.uint64((1 << self.low_bits) - 1)
        last = int(self.upper.zeros[-1]) - 1
        until = lambda h: np.where(h < 0, 0, self.upper.select(np.clip(h, 0, last), False) - np.clip(h, 0, last))
        left = np.clip(until(high - 1), start, stop)
        right = np.clip(until(high), start, stop)
        while True:
            open_ = left < right
            if not open_.any():
                return left
            middle = (left + right) >> 1
            less = np.zeros(len(x), bool)
            less[open_] = self.lows(middle[open_]) < wanted[open_]
            left = np.where(open_ & less, middle + 1, left)
            right = np.where(open_ & ~less, middle, right)


def pack_trie(columns: list[np.ndarray], values: np.ndarray) -> bytes:
    """A trie of rows in ascending order, all different, with 16-bit values."""
    n = len(values)
    starts = np.zeros(min(n, 1), np.int64)
    parts = []
    for depth, column in enumerate(columns):
        # Nodes of this level: where the row's first columns change.
        new = np.zeros(n, bool)
        new[:1] = True
        for c in columns[: depth + 1]:
            new[1:] |= c[1:] != c[:-1]
        nodes = np.flatnonzero(new)
        ids = column[nodes]
        first = np.searchsorted(nodes, starts)
        # Ids rise within a node; the last id of every node is added to those after it.
        ends = np.append(first[1:], len(nodes)) - 1
        sums = np.append(0, np.cumsum(ids[ends] + 1))[:-1] if len(nodes) else first
        parts += [Rising.pack(ids + np.repeat(sums, ends - first + 1)), Rising.pack(np.append(first, len(nodes))), Rising.pack(sums)]
        starts = nodes
    head = np.array([len(columns), n, sum(map(len, parts))], "<i8").tobytes()
    return head + b"".join(parts) + values.astype("<u2").tobytes()


class Trie:
    """A packed trie over a buffer, which is not copied."""

    def __init__(self, buffer):
        depth, n, size = (int(x) for x in np.frombuffer(buffer, "<i8", 3))
        at, self.levels = 24, []
        for _ in range(depth):
            level = []
            for _ in range(3):
                level.append(Rising(buffer, at))
                at = level[-1].end
            self.levels.append(level)
        self.values = np.frombuffer(buffer, "<u2", n, 24 + size)

    def find(self, columns: list[np.ndarray]) -> np.ndarray:
        """The place of each row among the trie's rows, or -1.

        From level to level: the node's range by its pointers, its offset, and a
        successor search for the id within that range. Rows in order that begin alike
        share the search for what they have in common.
        """
        n = len(columns[0])
        node, here = np.zeros(n, np.int64), np.full(n, len(self.values) > 0)
        new = np.zeros(n, bool)
        new[:1] = True
        for (ids, pointers, sums), column in zip(self.levels, columns, strict=True):
            new[1:] |= column[1:] != column[:-1]
            some = np.flatnonzero(new & here)
            if not len(some):
                return np.full(n, -1)
            at, x = node[some], column[some]
            # Rows in order that share a node ask once for its range and offset.
            fresh = np.append(True, at[1:] != at[:-1])
            own, each = at[fresh], np.cumsum(fresh) - 1
            start, stop = (y[each] for y in pointers.with_next(own))
            place = ids.find(x + sums[own][each], start, stop)
            group = np.cumsum(new) - 1
            found = np.full(int(group[-1]) + 1, -1)
            found[group[some]] = place
            node = found[group]
            here = node >= 0
        return node
