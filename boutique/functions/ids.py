"""Prefixed, zero-padded ids such as PROD_00042."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def id_number(col: str | Column, prefix: str) -> Column:
    """Numeric part following ``prefix`` (first run of digits), null when absent."""
    c = F.col(col) if isinstance(col, str) else col
    digits = F.regexp_extract(c, re.escape(prefix) + r"(\d+)", 1)
    return F.nullif(digits, F.lit("")).try_cast("bigint")


def padded(number: Column, width: int) -> Column:
    """Same text as ``%0{width}d``, nulls and negative numbers included, computed with lpad:
    ``format_string`` parses the format for every row, and is slow even as a branch not taken."""
    text = number.cast("bigint").cast("string")
    size = F.length(text)
    return (F.when(number >= 0, F.lpad(text, F.greatest(size, F.lit(width)), F.lit("0")))
            .when(number < 0, F.concat(F.lit("-"), F.lpad(F.substring(text, 2, 20), F.greatest(size - 1, F.lit(width - 1)), F.lit("0"))))
            .otherwise(F.lit("null".rjust(width))))


def format_id(prefix: str, width: int, number: Column) -> Column:
    """``prefix`` followed by the zero-padded number, e.g. PROD_00042."""
    return F.concat(F.lit(prefix), padded(number, width))
