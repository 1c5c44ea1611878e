"""Period classification of stays and cause vocabulary lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortflow.functions.recode import value_map
from cohortflow.operators.cohort import join_dimension
from cohortflow.spec import Period, taxonomy_rows


def period_of_stay(start: Column, end: Column, periods: tuple[Period, ...],
                   bounds: str = "exclusive") -> Column:
    """Label of the first period containing the stay, else NULL.

    ``exclusive`` (the study's rule): start strictly after the period start
    and end strictly before the period end, so stays touching a bound or still
    open (NULL end) belong to no period. ``inclusive`` allows equality. A
    generated CASE over the few windows: no join at all.
    """
    expr = None
    for p in periods:
        s, e = F.lit(p.start), F.lit(p.end)
        cond = ((start > s) & (end < e)) if bounds == "exclusive" else ((start >= s) & (end <= e))
        expr = F.when(cond, F.lit(p.label)) if expr is None else expr.when(cond, F.lit(p.label))
    return expr


def classify_periods(df: DataFrame, periods: tuple[Period, ...], start: str = "hosp_start",
                     end: str = "hosp_end", out: str = "period", bounds: str = "exclusive") -> DataFrame:
    return df.withColumn(out, period_of_stay(F.col(start), F.col(end), periods, bounds))


def vocabulary_maps(vocabulary) -> dict[str, dict[str, str]]:
    return {
        "label": {code: label for code, label, _, _ in vocabulary},
        "group4": {code: g4 for code, _, g4, _ in vocabulary},
        "group6": {code: g6 for code, _, _, g6 in vocabulary},
    }


def recode_causes(df: DataFrame, vocabulary, code_col: str = "hosp_cause",
                  outputs: dict[str, str] | None = None) -> DataFrame:
    """Add vocabulary columns for a raw cause code; unknown codes -> NULL.

    ``outputs`` maps an output column to one of ``label``, ``group4``,
    ``group6``. The vocabulary is a literal map (38 entries) evaluated inside
    the generated code, so the lookup needs neither a join nor a shuffle.
    """
    maps = vocabulary_maps(vocabulary)
    outputs = outputs or {"hosp_cause_label": "label", "hosp_cause_group4": "group4",
                          "hosp_cause_group6": "group6"}
    code = F.col(code_col)
    return df.withColumns({name: value_map(code, maps[kind]) for name, kind in outputs.items()})


TAXONOMY_SCHEMA = "taxonomy string, code string, label string, cause_group string, group_order int"


def taxonomy_table(spark: SparkSession, rows=None) -> DataFrame:
    """The taxonomy dimension: (taxonomy, code, label, cause_group, group_order)."""
    return spark.createDataFrame(rows or taxonomy_rows(), TAXONOMY_SCHEMA)


def classify_causes(df: DataFrame, dimension: DataFrame, taxonomy: str | None = None,
                    code_col: str = "hosp_cause") -> DataFrame:
    """``df`` with the dimension's taxonomy, label, cause_group and group_order for its code.

    With ``taxonomy`` every row stays once and unknown codes get NULL; without, a row comes
    once per taxonomy of the dimension. The dimension may be any table of that
    schema: it is broadcast only if its counted size allows.
    """
    d = dimension.where(F.col("taxonomy") == taxonomy) if taxonomy else dimension
    names = [taxonomy] if taxonomy else [r.taxonomy for r in d.select("taxonomy").distinct().collect()]
    each = df.withColumn("taxonomy", F.explode(F.array(*map(F.lit, sorted(names)))))
    return join_dimension(each, d.withColumnRenamed("code", code_col), ["taxonomy", code_col])
