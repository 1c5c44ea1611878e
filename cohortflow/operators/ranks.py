"""Exact order statistics at scale: an index of values with the counts below them.

``order_index`` starts from a value histogram, so ties collapse before anything is
ordered; quantiles, moments and midranks are all read from it. No key's values are
sorted in a single task:

1. the histogram is range-partitioned on (keys, value) into ``buckets`` ranges and
   written with each row's range number, so that the two readers below see
   the same ranges whatever the optimizer does;
2. totals per (keys, range) make a small table; an ordered window over it gives
   each range's offset within its key;
3. windows over (keys, range) give the running counts inside the range.

Range partitions are balanced by sampling, so a key holding a third of all
rows is spread over a third of the ranges. A NULL key is a key like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortflow.operators.cohort import null_safe_join
from cohortflow.session import write_once


def value_histogram(df: DataFrame, keys: list[str], value: str, extra: list[str] = (),
                    weight: str | None = None) -> DataFrame:
    """Rows per (keys, extra, value); ``weight`` sums an existing count instead."""
    w = F.sum(weight) if weight else F.count(F.lit(1))
    return (df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
            .groupBy(*keys, *extra, value).agg(w.alias("n")))


def order_index(hist: DataFrame, keys: list[str], value: str, group: str | None = None, count: str = "n",
                buckets: int | None = None, keep: bool = False) -> DataFrame:
    """``hist`` with ``below``: the total ``count`` of smaller values under the same keys and group.

    ``hist`` has a row per (keys, value), or per (keys, group, value). ``size`` and ``mean`` are those of the
    row's keys and group. With a group there are also ``t``, the value's count over all groups of its keys, and
    ``below_all``, the smaller values' count over all of them. ``keep`` writes the index for several readers.
    """
    if buckets is None:
        buckets = max(int(hist.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1) * 4
    own = [*keys, group] if group else list(keys)
    ranged = write_once(hist.repartitionByRange(buckets, *[F.col(k) for k in keys], F.col(value))
                        .withColumn("__b", F.spark_partition_id()), "ranges")
    none = F.lit(0)
    smaller = Window.orderBy("__b").rangeBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(*own, "__b").agg(
        F.sum(count).alias("__bt"), F.sum(F.col(value).cast("double") * F.col(count)).alias("__bv"))
    every = Window.partitionBy(*own)
    offsets = totals.select(
        *own, "__b", F.coalesce(F.sum("__bt").over(smaller.partitionBy(*own)), none).alias("__off"),
        F.coalesce(F.sum("__bt").over(smaller.partitionBy(*keys)), none).alias("__off_all"),
        F.sum("__bt").over(every).alias("size"), (F.sum("__bv").over(every) / F.sum("__bt").over(every)).alias("mean"))
    inside = Window.partitionBy(*keys, "__b")
    if group:
        upto = F.sum(count).over(inside.orderBy(value).rangeBetween(Window.unboundedPreceding, Window.currentRow))
        ranged = ranged.withColumn("__upto", upto).withColumn(
            "t", F.sum(count).over(Window.partitionBy(*keys, "__b", value)))
    in_group = Window.partitionBy(*own, "__b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranged = ranged.withColumn("__in", F.coalesce(F.sum(count).over(in_group), none))
    placed = null_safe_join(ranged, offsets, [*own, "__b"], "inner")
    more = [F.col("t"), (F.col("__upto") - F.col("t") + F.col("__off_all")).alias("below_all")] if group else []
    out = placed.select(*hist.columns, (F.col("__in") + F.col("__off")).alias("below"), "size", "mean", *more)
    return write_once(out, "order") if keep else out


def cumulative_before(hist: DataFrame, keys: list[str], value: str, count: str, buckets: int | None = None) -> DataFrame:
    """Add ``before``: total ``count`` of rows with the same keys and a smaller value."""
    return order_index(hist, keys, value, None, count, buckets).select(*hist.columns, F.col("below").alias("before"))


def midranks(df: DataFrame, keys: list[str], value: str, group: str, weight: str | None = None) -> DataFrame:
    """Per (keys, value, group): count ``n`` and the midrank of the value.

    Ranks run over all groups of a key together (pooled sample); ``t`` is
    the tie size of the value.
    """
    index = order_index(value_histogram(df.where(F.col(group).isNotNull()), keys, value, [group], weight), keys, value,
                        group)
    return with_midranks(index).select(*keys, group, value, "n", "t", "midrank")


def with_midranks(index: DataFrame) -> DataFrame:
    """The midrank of every row of an index with groups."""
    return index.withColumn("midrank", F.col("below_all") + (F.col("t") + 1) / 2.0)


def _order_positions(n, p, qtype: int):
    """(lower position, upper position, weight of upper) for 1-based order stats."""
    if qtype == 7:
        h = (n - 1) * p + 1
        lo = F.floor(h)
        return lo, F.least(lo + 1, n), h - lo
    if qtype == 2:
        np_ = n * p
        j = F.floor(np_ + F.lit(4 * 2.220446049250313e-16))
        lo = F.greatest(j, F.lit(1))
        hi = F.least(j + 1, n)
        return lo, hi, F.when(np_ > j, 1.0).otherwise(0.5)
    raise ValueError("quantile type must be 7 or 2")


def distribution(index: DataFrame, own: list[str], value: str, probs: dict[str, float], qtype: int = 7) -> DataFrame:
    """Per ``own`` keys (those of ``below``): size, mean, sd and one exact quantile per name in ``probs``, in one pass."""
    n, v = F.col("n"), F.col(value)
    aggs, finals = [F.first("size").alias("size"), F.first("mean").alias("mean"),
                    F.sum(n * (v - F.col("mean")) * (v - F.col("mean"))).alias("__ss")], {}
    for name, p in probs.items():
        lo, hi, w = _order_positions(F.col("size"), F.lit(p), qtype)
        for end, at in (("lo", lo), ("hi", hi)):
            hit = (F.col("below") < at) & (at <= F.col("below") + n)
            aggs.append(F.min(F.when(hit, v)).alias(f"__{end}_{name}"))
        aggs.append(F.first(w).alias(f"__w_{name}"))
        finals[name] = F.col(f"__lo_{name}") * (1 - F.col(f"__w_{name}")) + F.col(f"__hi_{name}") * F.col(f"__w_{name}")
    found = index.groupBy(*own).agg(*aggs)
    sd = F.when(F.col("size") > 1, F.sqrt(F.col("__ss") / (F.col("size") - 1)))
    return found.select(*own, "size", "mean", sd.alias("sd"), *[e.alias(name) for name, e in finals.items()])


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float],
                    qtype: int = 7) -> DataFrame:
    """Exact sample quantiles per key (R types 7 and 2), one column per name in ``probs``."""
    if not keys:  # one pooled sample: a constant key keeps every step keyed
        out = exact_quantiles(df.withColumn("__all", F.lit(1)), ["__all"], value, probs, qtype)
        return out.drop("__all")
    index = order_index(value_histogram(df, keys, value), keys, value)
    return distribution(index, keys, value, probs, qtype).select(*keys, *probs)
