"""Wrongly decoded text: what was meant comes back, and right text stays."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rowgauge.functions import mojibake
from rowgauge.operators import repair


def misread(text):
    return "".join(bytes([b]).decode("cp1252", "replace").replace("�", chr(b)) if b >= 0x80 else chr(b) for b in text.encode())


def repaired(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r[0] for r in df.orderBy("i").select(mojibake.redecode(F.col("t"))).collect()]


def test_all_of_latin_1_and_usual_punctuation(spark):
    meant = [chr(c) for c in range(0xA0, 0x100)] + list("–—‘’‚“”„†‡•…‰‹›€™")
    assert repaired(spark, [f"a{misread(c)}b" for c in meant]) == [f"a{c}b" for c in meant]


def test_stretches_of_any_language(spark):
    texts = ["привет, мир", "日本語のテスト", "Ελληνικά", "naïve “café” – déjà vu…", "🙂🙂 ok", "mixed ž š œ"]
    got = repaired(spark, [misread(t) for t in texts[:5]] + [None, "", "plain"])
    assert got == [*texts[:5], None, "", "plain"]


def test_right_text_is_untouched(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcàéîöüßñçøæœžšÀÉÎÖÜÅØŒЖДяκ日本", k=rng.randint(1, 8)))
    around = [("", ""), ("", ","), ("«", "»"), ("“", "”"), ("„", "“"), ("‹", "›"), ("", "…"), ("", "™"), ("", "’s"), ("“", "”…"), ("(", ")"), ("", "°"), ("– ", " –")]
    texts = ["CAFÉ» dit-il", "Å’s", "É« x", "20 °C", "“so” – „nein“…", "à la", "Ð", "Ãb", "â€", "\ufdd0é", "\u0080\u0081", "‘Sí, “Olé”»"]
    for _ in range(400):
        parts = []
        for _ in range(rng.randint(1, 6)):
            left, right = rng.choice(around)
            parts.append(left + word() + right)
        texts.append(" ".join(parts))
    assert repaired(spark, texts) == texts


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(min_codepoint=0x20, max_codepoint=0x17F), max_size=12), min_size=1, max_size=20))
def test_misread_words_come_back(spark, words):
    """Words between plain letters whose every special character is in a stretch."""
    usual = ["".join(c for c in w if c.isascii() or 0xA0 <= ord(c) <= 0xFF) for w in words]
    assert repaired(spark, ["x" + misread(w) + "y" for w in usual]) == ["x" + w + "y" for w in usual]


def test_known_sequences_that_lost_a_byte(spark):
    df = spark.createDataFrame([("a�b Â x",)], "t string")
    assert df.select(repair.repair_text(F.col("t"))).first()[0] == "ab  x"
