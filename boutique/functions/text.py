"""Text predicates and display expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from boutique import constants as K


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def search_term(value) -> str | None:
    """Blank or non-string search input means "no filter" (returns None)."""
    if not isinstance(value, str) or not value.strip():
        return None
    return value.strip()


def contains(col: str | Column, pattern: str, literal: bool = False) -> Column:
    """Case-insensitive "contains"; a null value never matches.

    By default ``pattern`` is a regular expression (Unicode-aware case folding, so É
    matches é). The pattern is compiled on the driver first so that a bad pattern fails
    before any job starts. ``literal=True`` matches the plain substring instead.
    """
    c = _c(col)
    if literal:
        hit = F.lower(c).contains(pattern.lower())
    else:
        re.compile(pattern)
        hit = c.rlike("(?iu)" + pattern)
    return F.coalesce(hit, F.lit(False))


def preview(col: str | Column, n: int = K.PREVIEW_CHARS) -> Column:
    """First ``n`` characters, with an ellipsis when the text is longer."""
    c = _c(col)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(K.ELLIPSIS))).otherwise(c)


def digits_only_phone(col: str | Column) -> Column:
    """Phone number with whitespace, dots and hyphens removed."""
    return F.regexp_replace(_c(col), K.PHONE_SEPARATORS, "")


def yes_no(col: str | Column) -> Column:
    return F.when(_c(col) == 1, K.YES_LABEL).otherwise(K.NO_LABEL)


def availability_label(col: str | Column) -> Column:
    return F.when(_c(col) > 0, K.IN_STOCK_LABEL).otherwise(K.OUT_OF_STOCK_LABEL)


def strip_python(col: str | Column) -> Column:
    """Remove leading and trailing whitespace of any kind (Unicode's, and the separators
    U+001C to U+001F, as Python's ``strip`` does)."""
    return F.regexp_replace(_c(col), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def blank_to_null_stripped(col: str | Column) -> Column:
    """Null or empty -> null; otherwise the stripped text (which may be empty)."""
    c = _c(col)
    return F.when(c.isNull() | (c == ""), F.lit(None).cast("string")).otherwise(strip_python(c))
