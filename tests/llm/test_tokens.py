"""Token file, packing and token counts: round trips, exact ids, brute force."""

import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rowgauge.llm import common, packing, token_counts, token_file, tokens
from tests.llm import brute

PATH = public_tokenizers.path("word_bpe_49k.json")
ROWS = brute.documents()
TEXTS = [
    "don't stop", "<|endoftext|> a", "x́ é café", "İstanbul ΑΣ ΟΔΟΣ.", "a b", "a\x1cb\x85c", "日本語 テスト", "Ab.,c ..",
    "×÷ a×b", "a1b22-C_d; x@y.de (ok)*** 0x1F", "١٢ a", "", "  ", " \n\t", "ß ſ K", "ﬁ", "word" * 2000, "ñandú, Der. Zug!", "a<|startoftext|>b", "é.",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 1]


def test_encoder_agrees_with_the_library(library):
    encoder = tokens.Encoder(PATH)
    for text in TEXTS + [t or "" for _, t, _ in ROWS]:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == ids_of(library, text)[:-1], text[:40]


def test_token_file(spark, library):
    path = common.shared_folder(spark)
    token_file.write_tokens(brute.frame(spark, ROWS), path, PATH)
    got = token_file.read_tokens(spark, path).collect()
    want = Counter((i, len(x), brute.crc(x)) for i, t, _ in ROWS for x in [ids_of(library, t)])
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [float("inf") if r["doc_id"] is None else r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted(order)


@pytest.mark.parametrize("kind", ["skewed", "flat", "one", "two"])
def test_huffman_round_trip(kind):
    rng = np.random.default_rng(7)
    counts = {"skewed": [2**min(k, 60) for k in range(40)], "flat": [1] * 1000, "one": [0, 5], "two": [3, 0, 1]}[kind]
    lengths = token_file.code_lengths(counts)
    used = [n for n, c in zip(lengths, counts, strict=True) if c]
    assert max(used) <= token_file.LONGEST_CODE and min(used) > 0
    assert sum(2.0**-int(n) for n in used) <= 1
    codes = token_file.canonical(lengths)
    table = token_file.decoding_table(lengths, codes)
    for n in (0, 1, 127, 128, 129, 5000):
        ids = rng.choice(np.flatnonzero(counts), n).astype(np.uint32)
        payload, marks = token_file.pack(ids, lengths, codes)
        assert (token_file.unpack(payload, marks, n, *table) == ids).all()


def test_code_lengths_are_best():
    """Against a plain Huffman tree where the limit does not bind."""
    import heapq

    rng = random.Random(2)
    for _ in range(20):
        counts = [rng.randint(1, 50) for _ in range(rng.randint(2, 40))]
        heap = list(counts)
        heapq.heapify(heap)
        cost = 0
        while len(heap) > 1:
            pair = heapq.heappop(heap) + heapq.heappop(heap)
            cost += pair
            heapq.heappush(heap, pair)
        assert sum(c * int(n) for c, n in zip(counts, token_file.code_lengths(counts), strict=True)) == cost
    assert max(token_file.code_lengths([2**k for k in range(10)], 5)) == 5


@pytest.mark.parametrize("room", [64, 4096])
def test_packing(spark, library, room):
    got = packing.pack_documents(brute.frame(spark, ROWS), PATH, room=room, group=30).collect()
    want = Counter()
    for i, t, _ in ROWS:
        ids = ids_of(library, t)
        for p, a in enumerate(range(0, len(ids), room)):
            part = ids[a : a + room]
            want[i, p, a, len(part), brute.crc(part)] += 1
    assert Counter(tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in got) == want
    held = {}
    for r in got:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for rows in held.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= room


def test_sum_of_squares_choice():
    """Each piece goes where the sum of squares of open gaps becomes smallest."""
    rng = np.random.default_rng(4)
    room, lengths = 20, rng.integers(1, 20, 300)
    bins, offsets = packing.place(lengths, room)
    fill = {}
    for s, b, o in zip(lengths.tolist(), bins.tolist(), offsets.tolist(), strict=True):
        def squares(choice, s=s):
            after = dict(fill)
            after[choice] = after.get(choice, 0) + s
            gaps = Counter(room - x for x in after.values() if x < room)
            return sum(n * n for n in gaps.values())

        options = [squares(c) for c, x in fill.items() if x + s <= room] + [squares("new")]
        assert fill.get(b, 0) == o and o + s <= room
        assert squares(b if b in fill else "new") == min(options)
        fill[b] = o + s


def test_packing_is_close_to_the_bound():
    rng = np.random.default_rng(6)
    lengths = np.minimum(4095, rng.lognormal(6.4, 1.0, 20_000).astype(np.int64) + 1)
    short = lengths.argsort().argsort() < packing.FILLERS * len(lengths)
    order = np.concatenate([lengths[~short], np.sort(lengths[short])[::-1]])
    bins, _ = packing.place(order, 4096)
    assert bins.max() + 1 <= 1.002 * -(-lengths.sum() // 4096)


def segmentations(text, counter):
    """Best (score, -tokens) over every segmentation of a short text."""
    if not text:
        return 0.0, 0
    best = None
    for cut in range(1, len(text) + 1):
        own = counter.scores.get(text[:cut])
        n = 1
        if own is None:
            if cut > 1:
                continue
            n = len(text[0].encode())
            own = n * counter.byte
        score, tokens_ = segmentations(text[cut:], counter)
        best = max(best or (-1e18, 0), (score + own, tokens_ - n))
    return best


def test_trie_against_every_segmentation():
    counter = token_counts.Counter(token_counts.piece_scores(public_tokenizers.path("piece_bpe_32k.model")))
    rng = random.Random(8)
    some = ["the", "then", "thence", "hello", "été", "naïve", "日本", "zzq", "☃", "internat", "a"]
    some += ["".join(rng.choices("theornaigs", k=rng.randint(1, 9))) for _ in range(60)]
    for word in some:
        assert counter[word] == -segmentations("▁" + word, counter)[1], word


def test_trie_agrees_with_the_library_and_when_full(monkeypatch):
    from tokenizers import Tokenizer as T
    from tokenizers.models import Unigram

    scores = token_counts.piece_scores(public_tokenizers.path("piece_bpe_32k.model"))
    model = T(Unigram([("<unk>", -100.0), *scores.items()], 0, False))
    rng = random.Random(9)
    sample = {w for w in brute.prose(rng, 3000).split() if w.isascii()}
    counter = token_counts.Counter(scores)
    want = {w: len(model.encode("▁" + w).ids) for w in sample}
    assert {w: counter[w] for w in sample} == want
    monkeypatch.setattr(token_counts, "NODES", 50)
    monkeypatch.setattr(token_counts, "WORDS", 10)
    small = token_counts.Counter(scores)
    assert {w: small[w] for w in sample} == want
    assert len(small) == 10 and len(small.score) == 50


def test_token_counts(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    counter = token_counts.Counter(token_counts.piece_scores(path))
    got = token_counts.count_tokens(brute.frame(spark, ROWS), path).collect()
    want = Counter((i, len((t or "").split()), sum(counter[w] for w in (t or "").split())) for i, t, _ in ROWS)
    assert Counter((r["doc_id"], r["n_words"], r["n_tokens"]) for r in got) == want


def test_empty_tables(spark):
    df = brute.frame(spark, [])
    path = common.shared_folder(spark)
    token_file.write_tokens(df, path, PATH)
    assert token_file.read_tokens(spark, path).count() == packing.pack_documents(df, PATH).count() == 0
    assert token_counts.count_tokens(df, public_tokenizers.path("piece_bpe_32k.model")).count() == 0
