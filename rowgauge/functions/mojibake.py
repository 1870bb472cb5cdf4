"""Text that was UTF-8 and was read as Windows-1252, put right.

Wrongly read text shows every byte as a character. Mapped back to bytes, such a
stretch is valid UTF-8, which ordinary text practically never is: a byte from C2 on
must be followed by exactly its continuation bytes. The automaton for that is a
pattern over the characters; only stretches it accepts are decoded, whole.

A sequence or two may be ordinary text, such as a capital before a quotation mark.
They are repaired only if they mean characters of Latin-1, usual punctuation or, as
four bytes, a picture; from three sequences in a row on, any are.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .spans import marked_parts

#: The characters of bytes 80 to 9F; bytes without one keep their number.
SHOWN = [bytes([b]).decode("cp1252", "replace").replace("�", chr(b)) for b in range(0x80, 0xA0)]


def _char(byte: int) -> str:
    return SHOWN[byte - 0x80] if byte < 0xA0 else chr(byte)


def _of(first: int, last: int) -> str:
    """A set of the characters of some bytes."""
    return "[" + "".join(rf"\x{{{ord(_char(b)):x}}}" for b in range(first, last + 1)) + "]"


ANY = _of(0x80, 0xBF)
#: Valid sequences of two, three and four bytes: no longer forms than needed, no surrogates.
SEQUENCE = "(?:" + "|".join((
    _of(0xC2, 0xDF) + ANY,
    _of(0xE0, 0xE0) + _of(0xA0, 0xBF) + ANY,
    f"(?:{_of(0xE1, 0xEC)}|{_of(0xEE, 0xEF)}){ANY}{ANY}",
    _of(0xED, 0xED) + _of(0x80, 0x9F) + ANY,
    _of(0xF0, 0xF0) + _of(0x90, 0xBF) + ANY + ANY,
    _of(0xF1, 0xF3) + ANY + ANY + ANY,
    _of(0xF4, 0xF4) + _of(0x80, 0x8F) + ANY + ANY,
)) + ")"
#: Latin-1; dashes, quotes, bullets, dots; the euro and trade marks; pictures.
USUAL = "(?:" + "|".join((
    _of(0xC2, 0xC3) + ANY,
    _of(0xE2, 0xE2) + _of(0x80, 0x80) + ANY,
    _of(0xE2, 0xE2) + _of(0x82, 0x82) + _of(0xAC, 0xAC),
    _of(0xE2, 0xE2) + _of(0x84, 0x84) + _of(0xA2, 0xA2),
    _of(0xF0, 0xF0) + _of(0x90, 0xBF) + ANY + ANY,
)) + ")"
STRETCH = f"{SEQUENCE}{{3,}}|{USUAL}"


def redecode(text: Column) -> Column:
    """The text with every stretch of wrongly read UTF-8 as it was meant."""
    shown = "".join(SHOWN)
    latin = "".join(chr(b) for b in range(0x80, 0xA0))
    decoded = lambda part: F.decode(F.encode(F.translate(part, shown, latin), "ISO-8859-1"), "UTF-8")
    parts = F.transform(marked_parts(text, STRETCH), lambda part, i: F.when(i % 2 == 1, decoded(part)).otherwise(part))
    return F.coalesce(F.array_join(parts, ""), text)
