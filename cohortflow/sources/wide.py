"""Wide subject records: the delimited scan and the typing step.

The raw file has positional names, a header line that is skipped, decimal
commas and day-month-year dates. Everything is read as text and typed by
column expressions, so a bad cell becomes NULL instead of failing the job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortflow.functions.parse import clean_text, parse_decimal_comma, parse_dmy
from cohortflow.functions.recode import factor_recode, presence_label
from cohortflow.sources.records import CORRUPT, scan_records
from cohortflow.spec import (DIABETES, GENDER, HTN, NUMERIC_COLUMNS, READMISSION,
                             wide_columns)


def read_wide_csv(spark: SparkSession, path: str, n_slots: int = 9, sep: str = ",", rejects: bool = False) -> DataFrame:
    """Scan delimited files by position (header skipped); quoted cells may hold line breaks and quotes.

    A record of too few or too many cells keeps the cells it has; with ``rejects``
    its text stands in ``corrupt_record`` (``records.count_rejects`` counts them).
    """
    found = scan_records(spark, path, wide_columns(n_slots), sep)
    return found if rejects else found.drop(CORRUPT)


def write_wide_csv(raw: DataFrame, path: str, sep: str = ",") -> None:
    """Write a text wide frame in the form ``read_wide_csv`` reads: header, quoted cells, empty for missing."""
    raw.write.option("header", "true").option("sep", sep).option("quote", '"').option("escape", '"').csv(path)


def _is_date_column(name: str) -> bool:
    n = name.lower()
    return "date" in n or "start" in n or "_end_" in n


def type_wide(raw: DataFrame) -> DataFrame:
    """Type a text wide frame: dates, decimal-comma numbers, factor labels.

    Date columns are chosen by name (``date``, ``start``, ``_end_``), numbers
    by position list; ``hosp_re*``, ``gender`` and ``htn`` become labels, and
    a ``diabetes`` label is derived from the presence of ``diabetes_type``.
    """
    out = []
    for name in raw.columns:
        c = F.col(name)
        if _is_date_column(name):
            e = parse_dmy(c)
        elif name in NUMERIC_COLUMNS:
            e = parse_decimal_comma(c)
        elif "hosp_re" in name.lower():
            e = factor_recode(clean_text(c), READMISSION)
        elif name == "gender":
            e = factor_recode(clean_text(c), GENDER)
        elif name == "htn":
            e = factor_recode(clean_text(c), HTN)
        else:
            e = clean_text(c)
        out.append(e.alias(name))
    typed = raw.select(*out)
    return typed.withColumn("diabetes", presence_label(F.col("diabetes_type"), DIABETES))
