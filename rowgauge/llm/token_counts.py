"""Token counts of a unigram tokenizer, once per shared prefix.

A word's tokens are the best segmentation into vocabulary pieces. The best score
of a prefix does not depend on what follows, so all distinct words of a worker
live in one trie: a node holds the best score and the token count of its prefix,
and a word that shares a prefix with an earlier one starts where they part. What
a whole word costs is remembered at its end.

The pieces come from a tokenizer file that ranks them; the score of rank r is
that of Zipf's law, -log(r + 1) - log(log(size)). A character without a piece
counts as its UTF-8 bytes, each scored below any piece.

Results in odd cases
--------------------
- A null or empty text has no words and no tokens.
- Repeated rows and rows without an id are counted each.
- Extra columns are kept but for the text; the operator's own replace those of their name.
- An empty table gives an empty result.
- Equal scores: the segmentation with fewer tokens counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowgauge.llm import common

#: Trie nodes and whole words that a worker keeps; later words are scored from their deepest node.
NODES, WORDS = 500_000, 200_000
SPACE = "▁"


def piece_scores(path: str) -> dict[str, float]:
    """Text pieces of a sentencepiece file with their scores."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ranked = [
        model.id_to_piece(i) for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i) or model.is_unused(i))
    ]
    base = math.log(math.log(len(ranked)))
    return {piece: -math.log(r + 1) - base for r, piece in enumerate(ranked)}


class Counter(dict):
    """word -> its number of tokens."""

    def __init__(self, scores: dict[str, float]):
        super().__init__()
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.byte = min(scores.values(), default=0.0) - 10.0
        self.child: dict[tuple[int, str], int] = {}
        self.score, self.count = [0.0], [0]

    def __missing__(self, word: str) -> int:
        text = SPACE + word
        node, best, counts = 0, [0.0], [0]
        for end in range(1, len(text) + 1):
            key = (node, text[end - 1])
            node = self.child.get(key, -1) if node >= 0 else -1
            if node >= 0:
                best.append(self.score[node])
                counts.append(self.count[node])
                continue
            size = len(text[end - 1].encode("utf-8", "surrogatepass"))
            top, least = best[end - 1] + size * self.byte, counts[end - 1] + size
            for start in range(max(0, end - self.longest), end):
                own = self.scores.get(text[start:end])
                if own is not None:
                    score, n = best[start] + own, counts[start] + 1
                    if score > top or (score == top and n < least):
                        top, least = score, n
            best.append(top)
            counts.append(least)
            if key[0] >= 0 and len(self.score) < NODES:
                node = self.child[key] = len(self.score)
                self.score.append(top)
                self.count.append(least)
        if len(self) < WORDS:
            self[word] = counts[-1]
        return counts[-1]


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters.clear()
        _counters[path] = Counter(piece_scores(path))
    return _counters[path]


def count_tokens(df: DataFrame, model: str, text_col: str = "text") -> DataFrame:
    """df with n_words and n_tokens; texts do not come back from Python."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = counter(model)
        for batch in batches:
            n_words, n_tokens = [], []
            for text in batch.column(batch.schema.get_field_index("_text")):
                words = (text.as_py() or "").split()
                n_words.append(len(words))
                n_tokens.append(sum(map(held.__getitem__, words)))
            kept = [i for i, name in enumerate(batch.schema.names) if name != "_text"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in kept], pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())],
                [*[batch.schema.names[i] for i in kept], "n_words", "n_tokens"],
            )

    common.share_code(df.sparkSession)
    keep = [c for c in df.columns if c not in ("n_words", "n_tokens", text_col)]
    schema = df.select(*keep).schema.add("n_words", "long").add("n_tokens", "long")
    return df.select(*keep, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema)
