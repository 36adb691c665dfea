"""Small text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: What a script's ``trim`` removes: a character class of the fixed set of white space and line ends.
WHITE_SPACE = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fill(template: str, *values: Column | str) -> Column:
    """``template`` with each ``{}`` replaced by a column; a null shows as nothing."""
    parts = template.split("{}")
    out = [F.lit(parts[0])]
    for value, tail in zip(values, parts[1:], strict=True):
        out += [F.coalesce(col(value).cast("string"), F.lit("")), F.lit(tail)]
    return F.concat(*out)


def clock(time: Column | str) -> Column:
    """``HH:mm`` of an ``HH:mm:ss`` text."""
    return F.substring(col(time), 1, 5)


def first_word(text: Column | str) -> Column:
    return F.split_part(col(text), F.lit(" "), F.lit(1))


def trimmed(text: Column | str) -> Column:
    """Without white space at both ends, line ends, no-break and other Unicode spaces included."""
    return F.regexp_replace(col(text), f"^{WHITE_SPACE}+|{WHITE_SPACE}+$", "")


def mark(cell: Column | str) -> Column:
    """A sheet cell ready to compare: trimmed, upper case, never null."""
    return F.upper(trimmed(F.coalesce(col(cell).cast("string"), F.lit(""))))


def goals(text: Column | str) -> Column:
    """Leading whole number of a typed text, null when there is none or it is negative."""
    number = F.regexp_extract(col(text), r"^\s*([+-]?\d+)", 1).try_cast("int")
    return F.when(number >= 0, number)


def display_name(nombre: Column | str, username: Column | str) -> Column:
    """The given name, or the username where the name is null or empty."""
    return F.coalesce(F.nullif(col(nombre), F.lit("")), col(username))
