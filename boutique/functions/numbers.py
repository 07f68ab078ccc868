"""Numbers in text as the shop reads them: one grammar, one expression each.

An integer is an optional sign and digits; a float is an optional sign and digits with an
optional fraction and exponent (a fraction or the digits before it may be missing, not
both), or ``inf``, ``infinity`` or ``nan`` in any case. A single underscore may stand
between two digits. Surrounding white space of any kind is ignored. Nothing else is a
number: no type suffixes (``12d``), no hexadecimal, no thousands separators, no blanks
inside. Digits are ASCII.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from boutique.functions.text import strip_python

_DIGITS = "[0-9]+(?:_[0-9]+)*"
INTEGER = rf"^[+-]?{_DIGITS}$"
FLOAT = rf"^[+-]?(?:(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?|(?i:inf|infinity|nan))$"


def _read(col: str | Column, grammar: str, to: str) -> Column:
    text = strip_python((F.col(col) if isinstance(col, str) else col).cast("string"))
    return F.when(text.rlike(grammar), F.replace(text, F.lit("_"), F.lit("")).try_cast(to))


def python_int(col: str | Column, to: str = "int") -> Column:
    """The integer that a text says; null if it says none, or one that ``to`` doesn't hold."""
    return _read(col, INTEGER, to)


def python_float(col: str | Column) -> Column:
    """The double that a text says (infinite and NaN included); null if it says none."""
    return _read(col, FLOAT, "double")
