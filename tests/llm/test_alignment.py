"""Alignment against a plain merge of sets of byte offsets."""

import random
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rowgauge.llm import alignment
from tests.llm import brute

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "  two  spaces ", "\n\n a\tb\r\n", "don't <|endoftext|> stop <s> x </s>", "日本語 テスト 🙂 ☃", "▁ mark", "a▁b",
    "<0x41> literal byte", "é́ ÀÉ ñ\x1c\x85c\x00d", "word" * 3000, "1234567 8,9.0", "﻿bom", "ﬁ ſ K ١٢",
]


def brute_rows(rows):
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of each row."""
    tok, sp = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    tok.encode_special_tokens = True
    letters = {}
    for byte in range(256):
        letters[byte] = chr(byte)
    shown = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
    letters |= {b: chr(256 + k) for k, b in enumerate(shown)}
    back = {c: b for b, c in letters.items()}
    held, pairs = [], Counter()
    for i, text in rows:
        data, groups, links = (" " + (text or "")).encode(), [], []
        ta = [(x, bytes(back[c] for c in tok.id_to_token(x))) for x in tok.encode(" " + (text or ""), add_special_tokens=False).ids]
        tb = [
            (x, bytes([int(sp.id_to_piece(x)[3:5], 16)]) if sp.is_byte(x) else sp.id_to_piece(x).replace("▁", " ").encode())
            for x in sp.encode(text or "")
        ]
        if not text or b"".join(p for _, p in ta) != data or b"".join(p for _, p in tb) != data:
            ta, tb = [], []
        ends = []
        for row in (ta, tb):
            at, made = 0, []
            for x, p in row:
                at += len(p)
                made.append((at, x))
            ends.append(made)
        both = sorted({e for e, _ in ends[0]} & {e for e, _ in ends[1]})
        at = 0
        for e in both:
            groups.append("|".join(",".join(str(x) for end, x in row if at < end <= e) for row in ends))
            links += [(x, y) for end, x in ends[0] if end == e for end2, y in ends[1] if end2 == e]
            at = e
        pairs.update(links)
        held.append((i, len(ta), len(tb), len(groups), links, ";".join(groups)))
    top = {}
    for (_, y), n in pairs.items():
        top[y] = max(top.get(y, 0), n)
    return Counter(
        (i, na, nb, ng, len(ls), sum(pairs[p] == top[p[1]] for p in ls), sum(pairs[p] for p in ls), g)
        for i, na, nb, ng, ls, g in held
    )


def run(df, **args):
    out = alignment.align_weighed(df, A, B, **args)
    return Counter(
        tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")) for r in out.collect()
    )


def test_alignment(spark):
    rows = [(i, t) for i, t, _ in brute.documents()] + [(400 + i, t) for i, t in enumerate(ODD)] + [(401, "a"), (None, None)]
    df = brute.frame(spark, [(i, t, "s") for i, t in rows])
    want = brute_rows(rows)
    assert run(df) == want
    out = alignment.align(df, A, B).collect()
    assert Counter((r["doc_id"], r["groups"]) for r in out) == Counter((x[0], x[7]) for x in want.elements())
    assert all(len(r["cuts"]) == len(r["links"]["a"]) == len(r["links"]["b"]) == r["n_links"] for r in out)
    # Small blocks change nothing.
    assert run(df.repartition(3), block=50, carry=["doc_id"]) == want


def test_places_and_long_texts(monkeypatch):
    rng = random.Random(3)
    text = brute.prose(rng, 4000) + "  x\n y" + brute.prose(rng, 300)
    a, b = alignment.side(A), alignment.side(B)
    whole = [side.encode([text])[0].tolist() for side in (a, b)]
    got = alignment.align_texts([text, "", text], a, b)
    monkeypatch.setattr(alignment, "LONG", 50)
    assert len(alignment.cut(text)) > 50 and " ".join(alignment.cut(text)) == text
    assert [side.encode([text])[0].tolist() for side in (a, b)] == whole
    for place in (1, 2, 7, 10**6):
        monkeypatch.setattr(alignment, "PLACE", place)
        again = alignment.align_texts([text, "", text], a, b)
        assert again.groups == got.groups and (again.ids_a == got.ids_a).all() and (again.cuts == got.cuts).all()
    ends = [set(np.cumsum(side.sizes[ids]).tolist()) for side, ids in zip((a, b), whole, strict=True)]
    assert got.cuts[: got.n_links[0]].tolist() == sorted(ends[0] & ends[1])


def test_fast_way_agrees_with_the_library():
    a, rng = alignment.side(A).tokenizer, random.Random(4)
    assert a.fast is not None
    tok = Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    odd = [chr(c) for c in [*range(1, 0x250), *range(0x2000, 0x2070), 0x180E, 0x3000, 0x1F600, 0x301, 0x661, 0xFEFF, 0xE0001]]
    texts = ["".join(rng.choices(odd, k=60)) for _ in range(500)] + [f"x{c}{c} {c}y 'll{c}" for c in odd]
    want = [e.ids for e in tok.encode_batch([" " + t for t in texts], add_special_tokens=False)]
    assert [x.tolist() for x in a.encode(texts)] == want


def test_clashing_names_and_empty_table(spark):
    names = ["row", "block", "at", "pairs", "refs", "ids_a", "n_a", "groups", "links", "best", "n"]
    df = spark.createDataFrame([(1, "some text")], "doc_id bigint, text string").select("*", *[F.lit("mine").alias(n) for n in names])
    out = alignment.align_weighed(df, A, B).collect()
    assert len(out) == 1 and out[0]["text"] == "some text" and out[0]["n_a"] > 0
    assert all(out[0][n] == "mine" for n in names if n not in alignment.OWN)
    empty = brute.frame(spark, [])
    assert alignment.align_weighed(empty, A, B).count() == alignment.align(empty, A, B).count() == 0
