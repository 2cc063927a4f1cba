"""Rules on white space, lengths and line ends that the rest of the functions share.

White space is the set of 25 code points that web scripts take for it; lengths and offsets count UTF-16 units.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as a Java and as an RE2 character class (without brackets).
SPACE = r"\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
SPACE_SQL = r"\t\n\x0B\f\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"


def trim(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A[{SPACE}]+|[{SPACE}]+\z", "")


def collapse(text: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return trim(F.regexp_replace(text, f"[{SPACE}]+", " "))


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def lines(text: Column) -> Column:
    """An array of lines; CR and CRLF end lines too."""
    return F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n", -1)
