"""Text helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space when text is trimmed.
WHITE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0       "
    "         　"
)
# The same set as a character class for regular expressions.
WHITE_CLASS = (
    r"[\s\x0b\x1c-\x1f\x85\xa0  -     　]"
)


def strip(col: Column) -> Column:
    """Trim every kind of white space at both ends."""
    return F.trim(col, F.lit(WHITE))


def words(col: Column) -> Column:
    """Words between white space; no word in an empty text."""
    return F.filter(F.split(strip(col), WHITE_CLASS + "+"), lambda w: w != "")
