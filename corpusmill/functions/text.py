"""Column functions on text that follow Unicode rather than ASCII rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Java's \s is ASCII only; with this flag it is the Unicode property.
WS = r"(?U)\s+"
#: The characters of that property.
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without white space at either end, of any Unicode kind."""
    return F.btrim(c, F.lit(WHITE))


def words(c: Column) -> Column:
    """The words between white space; an empty list for blank text, null for null."""
    return F.filter(F.split(c, WS), lambda w: w != "")


def token_count(c: Column) -> Column:
    """Approximate tokens: words / 0.75, rounded, at least 1; null for null."""
    return F.when(c.isNotNull(), F.greatest(F.lit(1), F.round(F.size(words(c)) / F.lit(0.75)).cast("int")))


def sentences(c: Column) -> Column:
    """Split after sentence punctuation before a capital, quote or bracket; blank parts are dropped."""
    return F.filter(
        F.transform(F.split(c, r"""(?<=[.!?])(?U)\s+(?=[A-Z("'])"""), strip), lambda s: s != ""
    )


def title_case(c: Column) -> Column:
    """Upper case after each non-letter, lower case elsewhere (so ``3d`` gives ``3D``, unlike initcap)."""
    parts = F.split(c, r"(?<=[^\p{L}])(?=\p{L})")
    return F.array_join(
        F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1_000_000_000)))), ""
    )


def display_name(stem: Column) -> Column:
    """A readable name from a file stem: ``_`` and ``-`` become spaces, words get capitals."""
    return title_case(strip(F.regexp_replace(stem, r"[_-]", " ")))


def squeeze(c: Column) -> Column:
    """Lower case with runs of white space as one space, stripped."""
    return F.lower(strip(F.regexp_replace(c, WS, " ")))


def instant(c: Column) -> Column:
    """Microseconds since 1970 of an ISO-like string; without an offset it is UTC; null if it is unsound."""
    s = strip(c)
    zoned = s.rlike(r"\d{2}:\d{2}.*(?:[Zz]|[+-]\d{2}:?\d{2})$")
    full = (
        F.when(zoned, s)
        .when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(s, F.lit("T00:00:00Z")))
        .otherwise(F.concat(s, F.lit("Z")))
    )
    return F.unix_micros(full.try_cast("timestamp"))
