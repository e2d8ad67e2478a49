"""Text functions. White space is Unicode's, no-break spaces included, as documents use them between thousands."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


#: White space as (?U)\s has it.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE))


def squeeze(text: Column) -> Column:
    """White space inside as single spaces, none at the ends."""
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def split_words(text: Column) -> Column:
    """Words between white space; an empty text has none."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")


def split_wide(text: Column) -> Column:
    """Cells between two or more white space characters."""
    return F.split(text, r"(?U)\s{2,}")


def contains_any(text: Column, words: Iterable[str], upper: bool = True) -> Column:
    """Whether the text (in upper case) holds one of the words as written; false for no words."""
    text = F.upper(text) if upper else text
    out = F.lit(False)
    for word in words:
        out = out | text.contains(word)
    return out


def count_any(text: Column, words: Iterable[str], upper: bool = True) -> Column:
    """How many of the words the text holds."""
    text = F.upper(text) if upper else text
    out = F.lit(0)
    for word in words:
        out = out + text.contains(word).cast("int")
    return out


def one_of(text: Column, words: Iterable[str], upper: bool = False) -> Column:
    return (F.upper(text) if upper else text).isin(*words)


def is_letter(text: Column) -> Column:
    return text.rlike(r"(?U)^\p{IsAlphabetic}$")


def count_matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def count_char(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def join_cells(cells: Column, separator: str = " ") -> Column:
    """The cells that aren't null or empty, joined."""
    return F.array_join(F.filter(cells, lambda x: x.isNotNull() & (x != "")), separator)


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def zero_padded(number: Column, width: int) -> Column:
    """At least width digits; longer numbers stay whole."""
    return F.format_string(f"%0{width}d", number)
