"""Decimal timestamps yyyyMMddHHmmss and 'until' bounds."""

from __future__ import annotations

import calendar
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

FORMAT = "yyyyMMddHHmmss"


def decimal_time(ts: Column) -> Column:
    """A timestamp as a 14-digit number; null stays null."""
    return F.date_format(ts, FORMAT).cast("long")


def unix_time(decimal: Column) -> Column:
    """Seconds since 1970 of a 14-digit number in UTC, whatever the session's zone; -1 for 0, negatives and null."""
    part = lambda at, n: F.floor(decimal / 10**at) % 10**n
    day = F.datediff(F.make_date(part(10, 4).cast("int"), part(8, 2).cast("int"), part(6, 2).cast("int")), F.lit("1970-01-01").cast("date"))
    seconds = day.cast("long") * 86400 + part(4, 2) * 3600 + part(2, 2) * 60 + part(0, 2)
    return F.when(decimal > 0, seconds).otherwise(F.lit(-1)).cast("long")


def until(text: str) -> tuple[str, int]:
    """('version', n), n negative from the end, or ('date', 14 digits) padded to the period's end.

    Dates have at least eight digits; parts may be separated and one-digit parts are padded.
    """
    parts = re.findall(r"\d+", text)
    if re.fullmatch(r"-?\d{1,7}", text):
        return "version", int(text)
    if len(parts) > 1:
        parts = [p.zfill(2) for p in parts]
    digits = "".join(parts)
    if len(digits) < 4 or len(digits) > 14 or len(digits) % 2:
        raise ValueError(f"not a version or date: {text}")
    if len(digits) == 4:
        digits += "12"
    if len(digits) == 6:
        digits += str(calendar.monthrange(int(digits[:4]), int(digits[4:]))[1])
    return "date", int(digits + "235959"[len(digits) - 8 :])
