"""Dates as printed, to ISO text. Kept as text: the day of a month is not checked against the calendar."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import once
from .text import SPACE, trimmed

# The month names that a spelled date may use.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def coerce_date(raw: Column) -> Column:
    """``YYYY-MM-DD`` with month 1-12 and day 1-31, or ``D MonthName YYYY``; null for anything else."""
    iso = r"^(\d{4})-(\d{2})-(\d{2})$"
    spelled = rf"^(\d{{1,2}}){SPACE}+([A-Za-z]+){SPACE}+(\d{{4}})$"

    def read(text: Column) -> Column:
        month, day = (F.regexp_extract(text, iso, k).try_cast("int") for k in (2, 3))
        number = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.regexp_extract(text, spelled, 2)))
        written = once(number, lambda n: F.when(n > 0, F.concat_ws("-", F.regexp_extract(text, spelled, 3), F.lpad(n.cast("string"), 2, "0"), F.lpad(F.regexp_extract(text, spelled, 1), 2, "0"))))
        return F.when(F.regexp_like(text, F.lit(iso)), F.when(month.between(1, 12) & day.between(1, 31), text)).otherwise(written)

    return once(trimmed(raw), read)
