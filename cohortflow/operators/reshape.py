"""Reshapes: multi-measure unpivot / pivot, id x key grids, level completion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortflow.spec import RepeatedGroup


def unpivot_repeated(df: DataFrame, id_cols: list[str], group: RepeatedGroup,
                     key_name: str, key_values: dict | None = None,
                     measures: list[str] | None = None, drop_all_null: bool = False,
                     key_type: str = "string") -> DataFrame:
    """Wide -> long for several measures at once (``.value`` + key semantics).

    Each suffix becomes one output row carrying a key column and one column
    per measure. A measure absent for a suffix becomes a typed NULL. Only the
    measures asked for are referenced, so the scan prunes the rest (Catalyst
    cannot prune through the generator on its own). The generator is a narrow
    operation: no shuffle.
    """
    measures = list(measures or group.measures)
    present = set(df.columns)
    types = {}
    for m in measures:
        for s in group.suffixes:
            c = group.column(m, s)
            if c in present:
                types.setdefault(m, df.schema[c].dataType)
    key_values = key_values or {}
    structs = []
    for s in group.suffixes:
        key = F.lit(key_values.get(s, s)).cast(key_type).alias(key_name)
        vals = []
        for m in measures:
            c = group.column(m, s)
            vals.append((F.col(c) if c in present else F.lit(None).cast(types[m])).alias(m))
        structs.append(F.struct(key, *vals))
    out = df.select(*[F.col(c) for c in id_cols], F.inline(F.array(*structs)))
    if drop_all_null:
        out = out.where(reduce(lambda a, b: a | b, [F.col(m).isNotNull() for m in measures]))
    return out


def pivot_measures(df: DataFrame, id_cols: list[str], key_col: str, key_values: list[str],
                   measures: list[str], sep: str = "_") -> DataFrame:
    """Long -> wide; output names ``<measure><sep><key>`` in measure-major order.

    Explicit key values avoid the extra job that discovers them; one row per
    (ids, key) is assumed, as the long input is keyed that way.
    """
    wide = df.groupBy(*id_cols).pivot(key_col, key_values).agg(
        *[F.first(m, ignorenulls=True).alias(m) for m in measures])
    if len(measures) == 1:
        rename = {str(k): f"{measures[0]}{sep}{k}" for k in key_values}
    else:
        rename = {f"{k}_{m}": f"{m}{sep}{k}" for k in key_values for m in measures}
    cols = [F.col(c) for c in id_cols]
    for m in measures:
        for k in key_values:
            src = f"{k}_{m}" if len(measures) > 1 else str(k)
            cols.append(F.col(f"`{src}`").alias(rename[src]))
    return wide.select(*cols)


def expand_keys(df: DataFrame, key_name: str, values: list, key_type: str = "string") -> DataFrame:
    """Every row repeated once per key value (the grid of ids x keys).

    A generator over a literal array: no join, no shuffle.
    """
    arr = F.array(*[F.lit(v).cast(key_type) for v in values])
    return df.select("*", F.explode(arr).alias(key_name))


def level_grid(df_spark_session, dims: list[tuple[str, list]]) -> DataFrame:
    """Cartesian product of a few literal level lists, as a tiny DataFrame."""
    spark = df_spark_session
    out = spark.range(1).select()
    for name, values in dims:
        out = out.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
    return out


def complete(observed: DataFrame, grid: DataFrame, keys: list[str], fill: dict) -> DataFrame:
    """All key combinations of ``grid`` with observed values, NULLs filled.

    Like completing factor combinations: combinations absent from the data are
    added, and ``fill`` also replaces pre-existing NULLs in those columns.
    Observed keys outside the grid are kept, as are their values.
    """
    cond = [grid[k].eqNullSafe(observed[k]) for k in keys]
    joined = grid.join(observed, cond, "full")
    cols = [F.coalesce(grid[k], observed[k]).alias(k) for k in keys] + [
        observed[c] for c in observed.columns if c not in keys]
    out = joined.select(*cols)
    return out.fillna(fill) if fill else out


def columns_matching(df: DataFrame, pattern: str) -> list[str]:
    """Column names matching a regex (search semantics, like ``matches``)."""
    import re
    rx = re.compile(pattern)
    return [c for c in df.columns if rx.search(c)]


def columns_containing(df: DataFrame, text: str) -> list[str]:
    """Column names containing ``text``, ignoring case (like ``contains``)."""
    t = text.lower()
    return [c for c in df.columns if t in c.lower()]


def stack_columns(df: DataFrame, keep: list[str], columns: dict[str, Column],
                  name_col: str = "variable", value_col: str = "value",
                  value_type: str = "string") -> DataFrame:
    """Several columns -> (name, value) rows, values cast to one type."""
    structs = [F.struct(F.lit(n).alias(name_col), c.cast(value_type).alias(value_col))
               for n, c in columns.items()]
    return df.select(*[F.col(k) for k in keep], F.inline(F.array(*structs)))
