"""Date functions.  Dates are kept as text, as they come; nothing passes through a timestamp, so no zone shifts a day."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from boardlark.functions.text import _col, blank_to_null


def _day(today: date | str | Column) -> Column:
    return today if isinstance(today, Column) else F.lit(str(today)).cast("date")


def normalize_date(x: Column | str) -> Column:
    """The first yyyy-mm-dd in the text, whether the calendar has it or not; else a compact yyyymmdd start; else null."""
    v = blank_to_null(_col(x))
    found = F.nullif(F.regexp_extract(v, r"(\d{4}-\d{2}-\d{2})", 1), F.lit(""))
    compact = F.nullif(F.regexp_extract(v, r"^(\d{8})(?:T.*)?$", 1), F.lit(""))
    return F.coalesce(found, F.try_to_date(compact, "yyyyMMdd").cast("string"))


def parse_date(x: Column | str) -> Column:
    """The first date written with dots, slashes or dashes; null if the calendar lacks it."""
    part = lambda k: F.regexp_extract(_col(x), r"(\d{4})[./-](\d{1,2})[./-](\d{1,2})", k)
    return F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0")).try_cast("date")


def cutoff(today: date | str | Column, days: int) -> Column:
    return F.date_sub(_day(today), days)


def recency(x: Column | str, today: date | str | Column) -> Column:
    """5, 3 or 1 within 7, 30 or 90 days, -2 after 365 days, else 0; 0 for the future and for no valid date."""
    age = F.datediff(_day(today), _col(x).try_cast("date"))
    return F.when(age < 0, 0).when(age <= 7, 5).when(age <= 30, 3).when(age <= 90, 1).when(age > 365, -2).otherwise(0)


def comparable(x: Column | str) -> Column:
    """Days since the epoch, 0 for no valid date."""
    return F.coalesce(F.unix_date(_col(x).try_cast("date")), F.lit(0))
