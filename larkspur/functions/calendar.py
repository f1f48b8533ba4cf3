"""Working days between dates, as one expression: prefix sums over the weeks and over the holidays, no row a day."""

from __future__ import annotations

import datetime
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: a Monday, from which weeks are counted.
MONDAY = datetime.date(1970, 1, 5)


def _before(day: Column, holidays: Column) -> Column:
    """Working days from MONDAY up to the day before (negative before it)."""
    n = F.datediff(day, F.lit(MONDAY))
    weekdays = F.floor(n / 7) * 5 + F.least(F.pmod(n, F.lit(7)), F.lit(5))
    return weekdays - F.size(F.filter(holidays, lambda h: h < day))


def working_days(first: Column, last: Column, holidays: Iterable[datetime.date] = ()) -> Column:
    """How many days from first to last, both included, are neither Saturday, Sunday nor a holiday; 0 if last is before first, null if either
    is. holidays: some hundred dates; those at weekends and repeated ones count once, as no working day."""
    off = F.array(*(F.lit(d) for d in sorted({d for d in holidays if d.weekday() < 5}))).cast("array<date>")
    after = F.date_add(last.cast("date"), 1)
    return F.greatest(_before(after, off) - _before(first.cast("date"), off), F.lit(0)) + F.when(first.isNull() | last.isNull(), F.lit(None).cast("long")).otherwise(0)
