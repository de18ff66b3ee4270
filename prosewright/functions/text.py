"""Text kernels: columns in, columns out; nothing here leaves the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lexicons as L

ABBR = "|".join(re.escape(a) for a in L.ABBREVIATIONS)
#: The blank after a terminator, unless the terminator ends an abbreviation or a single letter; in a flat text.
SENTENCE_GAP = rf"(?iU) (?<=[.!?] )(?<!(?:\b(?:{ABBR})|\b[A-Za-z])\. )"
#: Other characters that are equal to ASCII letters regardless of case.
ODD_CASES = "\u0130\u0131\u017f\u212a"
WORD = "[A-Za-z][A-Za-z'-]*"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value made once, however often ``then`` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def each(df: DataFrame, keys: Sequence[str], array: Column, place: str, item: str) -> DataFrame:
    """One row per element. An outer explode: else the optimizer makes the array once more, in a filter below."""
    return df.select(*keys, F.posexplode_outer(array).alias(place, item)).filter(F.col(place).isNotNull())


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def flat(text: Column) -> Column:
    """One line, single blanks."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def sentences(text: Column) -> Column:
    # a flat text has no line feed; to split at a pattern would compile it for each row
    return F.filter(F.split(F.regexp_replace(flat(text), SENTENCE_GAP, "\n"), "\n"), lambda s: s != "")


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n[ \t]*\n"), strip), lambda p: p != "")


def any_of(entries: Sequence[str], flags: str = "(?iU)", blanks: bool = False) -> str:
    """A pattern for whole entries; longer ones first, as the first that fits wins. ``blanks``: any white space between words."""
    ordered = sorted(entries, key=lambda e: -len(e))
    parts = [r"\s+".join(map(re.escape, e.split(" "))) if blanks else re.escape(e) for e in ordered]
    # one look at the first character, of either case, spares most places the costly word boundary
    first = sorted({c for e in entries for c in (e[0].lower(), e[0].upper())})
    ahead = f"(?=(?-i:[{''.join(map(re.escape, first))}{ODD_CASES}]))" if all(c.isascii() for c in first) else ""
    return flags + ahead + r"\b(?:" + "|".join(parts) + r")\b"


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def count_plain(text: Column, phrase: str) -> Column:
    """Occurrences of a substring that don't overlap."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(phrase), F.lit("")))) / len(phrase)).cast("int")


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, x: a + x)


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 for b = 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / F.when(b != 0, b))
