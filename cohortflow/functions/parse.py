"""Text cleaning and typed parsing of raw cells (all JVM expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Day-month-year layouts accepted for date cells; 1- and 2-digit fields both parse.
DMY_FORMATS = ("d/M/yyyy", "d-M-yyyy", "d.M.yyyy")


def clean_text(c: Column) -> Column:
    """Trim; blank and the text ``NA`` become NULL (as the CSV reader did)."""
    t = F.trim(c)
    return F.when((t == F.lit("")) | (t == F.lit("NA")), F.lit(None).cast("string")).otherwise(t)


def parse_decimal_comma(c: Column) -> Column:
    """Number with a decimal comma; any '.' (grouping mark) or junk -> NULL.

    NaN and infinity never come out, so later comparisons such as ``x > 75``
    stay three-valued (in Spark NaN sorts above every number).
    """
    t = clean_text(c)
    v = F.when(~t.contains("."), F.regexp_replace(t, ",", "."))
    # Only plain decimal numerals pass, so NaN / Inf text cannot enter.
    return F.when(v.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"),
                  v.try_cast("double"))


def parse_dmy(c: Column) -> Column:
    """Day-month-year text -> date; impossible dates (31/02) -> NULL."""
    t = clean_text(c)
    return F.coalesce(*[F.try_to_date(t, f) for f in DMY_FORMATS])
