"""Driver-side parsing of optional filter bounds (a bad bound drops the predicate).

Dates: year first (``2024-1-5``, ``2024/01/05``, ``2024.1.5``, ``20240105``), or month first
(``1/5/2024``, ``01-05-2024``; day first where the first number can't be a month), or with a
month's English name or its first three letters (``5 Jan 2024``, ``January 5, 2024``,
``5-jan-2024``). Month and day may lack their leading zero. A year alone, or a year and a
month (``2024-03``), is its first day. A time may follow after a blank or ``T``: ``H:MM``
with optional seconds and fraction, ``am`` / ``pm``, and a ``Z`` or UTC offset, which is
converted to UTC. Everything else is no date.
"""

from __future__ import annotations

import datetime as dt
import math
import re

_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
_NAME = "(?P<name>[a-z]{3,9})\\.?"
_DATES = [re.compile(p) for p in (
    r"(?P<y>\d{4})(?P<m>\d{2})(?P<d>\d{2})",
    r"(?P<y>\d{4})(?:[-/.](?P<m>\d{1,2})(?:[-/.](?P<d>\d{1,2}))?)?",
    r"(?P<a>\d{1,2})[-/.](?P<b>\d{1,2})[-/.](?P<y>\d{4})",
    rf"(?P<d>\d{{1,2}})[\s-]+{_NAME}[\s-]+(?P<y>\d{{4}})",
    rf"{_NAME}\s+(?P<d>\d{{1,2}})(?:\s*,\s*|\s+)(?P<y>\d{{4}})",
    rf"{_NAME}\s+(?P<y>\d{{4}})",
)]
_TIME = re.compile(r"(?P<h>\d{1,2}):(?P<min>\d{2})(?::(?P<s>\d{2})(?:\.(?P<f>\d{1,9}))?)?\s*(?P<half>am|pm)?\s*(?P<zone>z|utc|[+-]\d{2}:?\d{2})?")


def parse_number(value) -> float | None:
    if value is None:
        return None
    s = str(value).strip()
    if not s:
        return None
    try:
        v = float(s)
    except ValueError:
        return None
    return None if math.isnan(v) else v


def _date(text: str) -> dt.date | None:
    for form in _DATES:
        found = form.fullmatch(text)
        if not found:
            continue
        part = found.groupdict()
        month, day = part.get("m"), part.get("d")
        if part.get("a"):
            month, day = (part["a"], part["b"]) if int(part["a"]) <= 12 else (part["b"], part["a"])
        if part.get("name"):
            named = [k + 1 for k, n in enumerate(_MONTHS) if part["name"] in (n, n[:3])]
            if not named:
                return None
            month = named[0]
        try:
            return dt.date(int(part["y"]), int(month or 1), int(day or 1))
        except ValueError:
            return None
    return None


def _time(text: str) -> dt.timedelta | None:
    """Time since midnight, in UTC if it names a zone."""
    found = _TIME.fullmatch(text)
    if not found:
        return None
    h, minute, s = int(found["h"]), int(found["min"]), int(found["s"] or 0)
    if found["half"]:
        if not 1 <= h <= 12:
            return None
        h = h % 12 + (12 if found["half"] == "pm" else 0)
    if h > 23 or minute > 59 or s > 59:
        return None
    out = dt.timedelta(hours=h, minutes=minute, seconds=s, microseconds=int((found["f"] or "0").ljust(6, "0")[:6]))
    zone = found["zone"]
    if zone and zone[0] in "+-":
        shift = dt.timedelta(hours=int(zone[1:3]), minutes=int(zone[-2:]))
        out = out - shift if zone[0] == "+" else out + shift
    return out


def parse_timestamp(value) -> dt.datetime | None:
    """The zone-less timestamp (UTC) that ``value`` names, or None; forms as above."""
    if value is None or value == "":
        return None
    if isinstance(value, dt.datetime):
        return value if value.tzinfo is None else value.astimezone(dt.timezone.utc).replace(tzinfo=None)
    if isinstance(value, dt.date):
        return dt.datetime(value.year, value.month, value.day)
    text = str(value).strip().lower()
    cut = re.search(r"(?<=\d)(?:t|\s+)(?=\d{1,2}:)", text)
    day = _date(text[:cut.start()] if cut else text)
    time = _time(text[cut.end():]) if cut else dt.timedelta()
    if day is None or time is None:
        return None
    return dt.datetime(day.year, day.month, day.day) + time
