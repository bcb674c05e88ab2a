"""Scalar text functions as Column expressions (JVM-side, no Python in the data path).

Nulls: every function returns null for a null text. Empty texts give empty
arrays, zero counts and empty strings.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ASCII letters, and the preview's length and mark.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
PREVIEW_CHARS = 120
PREVIEW_MARK = "…"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only: a Unicode ``lower`` would fold the Kelvin sign into ``k``."""
    return F.translate(text, UPPER, LOWER)


def terms(text: Column) -> Column:
    """Runs of ASCII letters and digits, in lower case, in order."""
    return F.regexp_extract_all(ascii_lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def words(text: Column) -> Column:
    """Words separated by Unicode white space."""
    return F.regexp_extract_all(text, F.lit(r"(?U)\S+"), F.lit(0))


def word_count(text: Column) -> Column:
    return F.size(words(text))


def preview(text: Column, limit: int = PREVIEW_CHARS) -> Column:
    """White space collapsed; the first ``limit`` characters, with a mark where some were left out."""
    flat = F.array_join(words(text), " ")
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit), F.lit(PREVIEW_MARK))).otherwise(flat)


def last_words(text: Column, n: int) -> Column:
    """The last ``n`` words joined by blanks; empty for n = 0."""
    found = words(text)
    if n <= 0:
        return F.when(text.isNotNull(), F.lit(""))
    return F.array_join(F.slice(found, F.greatest(F.size(found) - n + 1, F.lit(1)), F.lit(n)), " ")


def markdown_title(text: Column) -> Column:
    """The first line whose left-trimmed text starts with ``# ``; null where there is none."""
    return F.trim(F.get(F.regexp_extract_all(text, F.lit(r"(?m)^[^\S\n]*# (.*)$"), F.lit(1)), F.lit(0)))
