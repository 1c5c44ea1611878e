"""Calendar arithmetic on DATE columns (JVM expressions)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def anniversary(birth: Column, years: Column) -> Column:
    """``birth`` moved by whole years; 29 Feb in a common year rolls to 1 Mar."""
    return F.date_add(F.make_date(F.year(birth) + years, F.month(birth), F.lit(1)),
                      F.dayofmonth(birth) - 1)


def age_years(birth: Column, ref: Column) -> Column:
    """Fractional calendar years from ``birth`` to ``ref``.

    Whole anniversaries passed, plus the elapsed share of the current
    anniversary year measured in days (so leap years count 366 days). Not
    ``months_between/12``, which spreads days over 31-day months.
    """
    span = F.year(ref) - F.year(birth)
    fwd = span - F.when(anniversary(birth, span) > ref, 1).otherwise(0)
    back = span + F.when(anniversary(birth, span) < ref, 1).otherwise(0)
    k = F.when(ref >= birth, fwd).otherwise(back)
    step = F.when(ref >= birth, F.lit(1)).otherwise(F.lit(-1))
    prev_ = anniversary(birth, k)
    next_ = anniversary(birth, k + step)
    frac = F.datediff(ref, prev_) / F.datediff(next_, prev_)
    return k.cast("double") + step * frac


def days_between(start: Column, end: Column) -> Column:
    """Whole days from ``start`` to ``end`` (negative if end is earlier)."""
    return F.datediff(end, start)


def floored_log(x: Column, floor_value: float = 0.1) -> Column:
    """``ln(x)``; values <= 0 take ``ln(floor_value)``; NULL stays NULL."""
    return F.when(x <= 0, F.lit(math.log(floor_value))).when(x > 0, F.ln(x))
