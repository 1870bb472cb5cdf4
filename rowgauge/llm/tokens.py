"""Token ids by the tokenizers library, remembering what it said of words.

A text's ids are the ids of its white-space chunks in a row: nothing in the
tokenizers used here joins chunks. Chunks repeat a lot, so each worker keeps the
ids of chunks and of plain words it met, up to a bound, and asks the library for
the rest. Whether a tokenizer allows the short way for plain words is tested
against the library when a worker loads it.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array

#: Chunks and words that a worker remembers, and the longest of them.
REMEMBERED, LONGEST = 400_000, 64
#: Letters with marks at the end, and any chunk of letters, digits and marks but the apostrophe.
PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]*)")
MIXED = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ0-9!-&(-/:-@\[-`{-~]+")
PARTS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[!-&(-/:-@\[-`{-~]+")


class Encoder(dict):
    """chunk -> its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.words: dict[str, bytes] = {}
        self.byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.short_way = True
        probes = ["Hello", "ñandú,", "der.", "Zug,.", "ÉTÉ", "a", "a1b22-C_d;", "x@y.de", "***"]
        self.short_way = all(self._ask(x) == self._short(x) for x in probes)
        self.whole = self._ask("Ab c, d") != self._ask("Ab") + self._ask("c,") + self._ask("d")

    def _ask(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            mapped = word if word.isascii() else self.byte_level.pre_tokenize_str(word)[0][0]
            ids = array("I", [t.id for t in self.tokenizer.model.tokenize(mapped)]).tobytes()
            if len(self.words) < REMEMBERED and len(word) <= LONGEST:
                self.words[word] = ids
        return ids

    def _short(self, chunk: str) -> bytes:
        """By words; the library only where a chunk has other characters or may hold a special token."""
        match = PLAIN.fullmatch(chunk)
        if match:
            ids = self._word(match[1].lower())
            return ids + self._word(match[2]) if match[2] else ids
        if "<|" not in chunk and MIXED.fullmatch(chunk):
            return b"".join(map(self._word, PARTS.findall(chunk.lower())))
        return self._ask(chunk)

    def __missing__(self, chunk: str) -> bytes:
        ids = self._short(chunk) if self.short_way else self._ask(chunk)
        if len(self) < REMEMBERED and len(chunk) <= LONGEST:
            self[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if self.whole:
            return self._ask(text)
        text = text.replace("\n", " ").replace("\t", " ").replace("\r", " ")
        return b"".join(map(self.__getitem__, text.split(" ")))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a file; it outlives tasks."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]


def crc(ids: bytes) -> int:
    return zlib.crc32(ids) & 0xFFFFFFFF
