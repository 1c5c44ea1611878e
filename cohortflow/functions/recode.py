"""Value maps, factor recodes, bands and missing-aware aggregates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortflow.spec import Bands, FactorSpec, literal_map


def value_map(c: Column, mapping: dict) -> Column:
    """Exact-match recode; unmatched or NULL input -> NULL (no default)."""
    return F.try_element_at(literal_map(mapping), c)


def factor_recode(c: Column, spec: FactorSpec) -> Column:
    """Codes to labels in level order; values outside the levels -> NULL."""
    return value_map(c, spec.mapping())


def presence_label(c: Column, spec: FactorSpec) -> Column:
    """Label of ``c IS NOT NULL`` using a FALSE/TRUE factor spec."""
    m = spec.mapping()
    return F.when(c.isNotNull(), F.lit(m["TRUE"])).otherwise(F.lit(m["FALSE"]))


def band(x: Column, bands: Bands) -> Column:
    """Right-closed bands ``lo < x <= hi`` (left-closed if ``right=False``).

    Values at or below the first break, above the last, or NULL -> NULL.
    """
    expr = None
    for lo, hi, label in zip(bands.breaks[:-1], bands.breaks[1:], bands.labels):
        cond = ((x > F.lit(lo)) & (x <= F.lit(hi))) if bands.right else \
               ((x >= F.lit(lo)) & (x < F.lit(hi)))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr


def if_else(cond: Column, yes: Column, no: Column) -> Column:
    """Two-way choice where a NULL condition gives NULL (not the ``no`` branch)."""
    return F.when(cond, yes).when(~cond, no)


def strict_sum(x: Column) -> Column:
    """Sum that is NULL as soon as one input is NULL (R ``sum`` default)."""
    return F.when(F.count_if(x.isNull()) == 0, F.sum(x))


def strict_count_if(cond: Column) -> Column:
    """Number of TRUE; NULL as soon as one condition is NULL."""
    return F.when(F.count_if(cond.isNull()) == 0, F.count_if(cond))


def n_distinct(x: Column) -> Column:
    """Distinct count where NULL counts as one more value."""
    return F.count_distinct(x) + F.max(x.isNull().cast("int"))
