"""Text and name functions as column expressions. Lengths are code points, trims take spaces only, capitals are ASCII."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Forms of names, and widths of fields that computed names fill.
CALL_NAME, TRANSACTION_NAME, FILE_NAME = r"^[A-Z_$][A-Z0-9_@#$]{0,7}$", r"^[A-Z0-9$@#]{1,8}$", r"^[A-Z0-9$@#]{1,8}$"
PROGRAM_WIDTH, FILE_WIDTH, SYSTEM_WIDTH = 8, 8, 4


def fit(text: Column, n: int, pad: str = " ") -> Column:
    """text cut or padded on the right to n characters."""
    return F.rpad(text, n, pad)


def piece(text: Column, start: Column, count: Column) -> Column:
    """count characters from start (0 is the first); null where that leaves the text."""
    inside = (start >= 0) & (count >= 0) & (start + count <= F.length(text))
    return F.when(inside, F.substring(text, (start + 1).cast("int"), count.cast("int")))


def fill(char: str, n: Column) -> Column:
    return F.repeat(F.lit(char), n.cast("int"))


def upper_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_lowercase, string.ascii_uppercase)


def trimmed(text: Column, side: str = "both") -> Column:
    return {"both": F.trim, "leading": F.ltrim, "trailing": F.rtrim}[side](text)


def is_digits(text: Column) -> Column:
    return text.rlike("^[0-9]+$")


def padded_equal(a: Column, b: Column) -> Column:
    """Equality after padding the shorter one with spaces."""
    n = F.greatest(F.length(a), F.length(b))
    return F.rpad(a, n, F.lit(" ")) == F.rpad(b, n, F.lit(" "))


def key_of(*parts: Column) -> Column:
    """One string of several, each with its length before it, so that different parts never meet."""
    return F.concat(*(F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in parts))


def call_name(raw: Column, computed: bool = True) -> Column:
    """The program that a call names, null if it names none: trailing spaces go from computed names."""
    name = F.rtrim(raw) if computed else raw
    return F.when(name.rlike(CALL_NAME), name)


def fixed_name(raw: Column, width: int, form: str = TRANSACTION_NAME, computed: bool = True) -> Column:
    """A name of a field of fixed width, null if it names none: a computed one must fill its field."""
    name = F.rtrim(raw)
    fits = (F.length(raw) == width) if computed else (F.length(raw) <= width)
    return F.when(fits & name.rlike(form), name)


def to_ascii(text: Column) -> Column:
    """The text's bytes if all are ASCII, else null."""
    return F.when(text.rlike(r"^[\x00-\x7F]*$"), F.encode(text, "US-ASCII"))
