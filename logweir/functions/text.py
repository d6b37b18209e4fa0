"""Text predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the 25 characters that count as blank (Spark's trim knows U+0020 only).
BLANK_CHARACTERS = (
    "\t\n\x0b\x0c\r \u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)


def is_blank(text: Column) -> Column:
    return F.length(F.btrim(text, F.lit(BLANK_CHARACTERS))) == 0


def contains_ignore_case(text: Column, needle: str) -> Column:
    """Literal, case-insensitive substring test; %, _ and \\ have no special meaning."""
    return F.contains(F.lower(text), F.lower(F.lit(needle)))


def escape_like(text: Column) -> Column:
    """Escape text for use inside a LIKE pattern with backslash as escape character."""
    for special in ("\\", "%", "_"):
        text = F.replace(text, F.lit(special), F.lit("\\" + special))
    return text
