"""Single-byte codecs of program texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where code page 1047 differs from 037, as (byte in 1047, byte in 037 of the same character).
DIFFERENCES = [(0x15, 0x25), (0x25, 0x15), (0x5F, 0xB0), (0xB0, 0x5F), (0xAD, 0xBA), (0xBA, 0xAD), (0xBD, 0xBB), (0xBB, 0xBD)]


def decoding_1047() -> str:
    """The 256 characters of code page 1047, made from 037 and the differences."""
    base = bytes(range(256)).decode("cp037")
    moved = dict(DIFFERENCES)
    return "".join(base[moved.get(i, i)] for i in range(256))


#: Characters of bytes that Latin-1 reads otherwise, and what Latin-1 reads; the page's characters are those of Latin-1.
MOVED_1047, MOVED_LATIN = ("".join(x) for x in zip(*((c, chr(i)) for i, c in enumerate(decoding_1047()) if c != chr(i)), strict=True))


def from_1047(raw: Column) -> Column:
    """Text of bytes in code page 1047."""
    return F.translate(F.decode(raw, "ISO-8859-1"), MOVED_LATIN, MOVED_1047)


def to_1047(text: Column) -> Column:
    """Bytes in code page 1047, null where a character has none."""
    return F.when(F.rlike(text, F.lit(r"^[\x00-\xFF]*$")), F.encode(F.translate(text, MOVED_1047, MOVED_LATIN), "ISO-8859-1"))
