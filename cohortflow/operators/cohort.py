"""Null-safe keyed joins, first-row dedup and membership flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_R = "__r_"


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Equi-join where NULL keys match each other (``<=>``).

    Still planned as a hash / sort-merge equi-join (Spark rewrites ``<=>``
    keys into coalesce + isnull pairs), never a nested loop. Output: left
    columns in their order, keys taken from the side that always exists
    (right for ``right``, left for ``left``/``inner``, coalesced for
    ``full``), then the right side's other columns.
    """
    r = right.select(*[F.col(c).alias(_R + c) for c in right.columns])
    cond = [left[k].eqNullSafe(r[_R + k]) for k in keys]
    joined = left.join(r, cond, how)

    def key_col(k):
        if how == "right":
            return F.col(_R + k)
        if how in ("full", "outer", "full_outer"):
            return F.coalesce(left[k], F.col(_R + k))
        return left[k]

    cols = [key_col(c).alias(c) if c in keys else left[c] for c in left.columns]
    cols += [F.col(_R + c).alias(c) for c in right.columns if c not in keys]
    return joined.select(*cols)


def null_safe_semi(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``left`` whose keys, NULL or not, occur in ``right``."""
    r = right.select(*[F.col(k).alias(_R + k) for k in keys])
    return left.join(r, [left[k].eqNullSafe(r[_R + k]) for k in keys], "left_semi")


#: A dimension of at most this many rows is broadcast, a larger one joined by shuffles.
BROADCAST_ROWS = 100_000


def join_dimension(df: DataFrame, dimension: DataFrame, keys: list[str], most: int = BROADCAST_ROWS) -> DataFrame:
    """Left join to a table whose rows are counted first; it is broadcast if there are at most ``most``."""
    small = dimension.limit(most + 1).count() <= most
    return df.join(F.broadcast(dimension) if small else dimension.hint("merge"), keys, "left")


def first_row_per_key(df: DataFrame, keys: list[str], order_by: list) -> DataFrame:
    """One row per key: the first under an explicit, total tiebreak order.

    ``row_number() = 1`` is planned with a partial group limit ahead of the
    shuffle, so a hot key ships one row per map task, not all of its rows.
    """
    w = Window.partitionBy(*keys).orderBy(*order_by)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") == 1).drop("__rn")


def membership_flag(df: DataFrame, members: DataFrame, key: str, flag: str) -> DataFrame:
    """``key IN members`` as a boolean column, via a left join to distinct keys."""
    m = members.select(F.col(key).alias("__m_key")).distinct().withColumn("__m_hit", F.lit(True))
    j = df.join(m, df[key] == m["__m_key"], "left")
    return j.select(*[df[c] for c in df.columns],
                    F.coalesce(F.col("__m_hit"), F.lit(False)).alias(flag))
