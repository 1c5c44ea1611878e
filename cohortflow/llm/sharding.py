"""Sharding along a Hilbert curve (law ``rows``).

Several metadata columns are quantised to a few bits each, the Hilbert index
of the resulting cell orders the rows, and consecutive runs of the order
become shards, so every shard covers a compact box of the metadata space and
a reader can prune shards by the min and max of any of the columns.

Quantisation takes equi-depth cuts: of numbers from mergeable percentile
sketches over all rows, of texts from counts of their whole values, dealt by
range and summed up range by range, so values that start alike are told apart.
Only the cuts (at most ``2**bits`` per column) and a total per range reach the driver.

Plan: rows are reduced to (doc_id, size, crc, index), dealt by range on
(index, doc_id, crc, size) and written once with their position inside the
range; one small count per range gives the offsets, and the global position
``p`` of ``n`` rows goes to shard ``p * shards div n``. Counts differ by at
most one. No text is shuffled and no window spans a shard.

Defined results: a null text has size 1 (no bytes, plus 1) and the crc of
the empty text; null metadata falls in the lowest cell; equal index values
are ordered by doc_id, then crc and size; repeated rows get positions of
their own; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortflow.llm.common import materialize, prepare

LOCAL_BITS = 33          # monotonically_increasing_id: partition above, row number below


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of integer cells (rows x dimensions, each below ``2**bits``).

    Walks the bit planes from the top: in each plane a dimension whose bit is
    set reflects the first dimension's lower bits, otherwise it swaps them
    with its own; the Gray code of the resulting planes is then undone and
    the planes are interleaved.
    """
    x = cells.T.astype(np.uint64).copy()
    dims = len(x)
    one = np.uint64(1)
    for plane in range(bits - 1, 0, -1):
        mask = np.uint64((1 << plane) - 1)
        for d in range(dims):
            on = (x[d] >> np.uint64(plane)) & one == one
            swapped = np.where(on, np.uint64(0), (x[0] ^ x[d]) & mask)
            x[0] = np.where(on, x[0] ^ mask, x[0] ^ swapped)
            if d:
                x[d] ^= swapped
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    flip = np.zeros_like(x[0])
    for plane in range(bits - 1, 0, -1):
        on = (x[-1] >> np.uint64(plane)) & one == one
        flip ^= np.where(on, np.uint64((1 << plane) - 1), np.uint64(0))
    x ^= flip
    out = np.zeros_like(x[0])
    for plane in range(bits - 1, -1, -1):
        for d in range(dims):
            out = (out << one) | ((x[d] >> np.uint64(plane)) & one)
    return out.astype(np.int64)


def text_cuts(values: DataFrame, bits: int) -> list[str]:
    """The values of ``values`` (one text column ``v``) that hold the row at some multiple of 1/2**bits of all rows.

    In the order of UTF-8 bytes, which is that of code points. Nulls count nowhere.
    """
    counted = (values.filter("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("held"))
               .repartitionByRange("v").withColumn("range", F.spark_partition_id()))
    counted = materialize(counted, "shard-values")
    before, total = [], 0
    for r in sorted(counted.groupBy("range").agg(F.sum("held").alias("held")).collect()):      # one row per range
        before.append((r["range"], total))
        total += r["held"]
    if not total:
        return []
    offsets = values.sparkSession.createDataFrame(before, "range int, before long")
    inside = Window.partitionBy("range").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = counted.join(F.broadcast(offsets), "range").withColumn("upto", F.col("before") + F.sum("held").over(inside))
    step = F.expr(f"(upto * {2 ** bits}L) div {total}L > ((upto - held) * {2 ** bits}L) div {total}L")
    return sorted(r["v"] for r in upto.filter(step).select("v").collect())                     # 2**bits rows at most


def with_hilbert(rows: DataFrame, dims: Mapping[str, Column], bits: int = 6) -> DataFrame:
    """Adds ``hilbert`` to ``rows``; ``dims`` are numeric or text columns over ``rows``."""
    names = [f"dim{i}" for i in range(len(dims))]
    placed = rows.withColumns(dict(zip(names, dims.values())))
    text = {n for n in names if dict(placed.dtypes)[n] == "string"}
    placed = placed.withColumns({n: F.col(n).cast("double") for n in names if n not in text})
    shares = [i / 2 ** bits for i in range(1, 2 ** bits)]
    cuts = {n: text_cuts(placed.select(F.col(n).alias("v")), bits) for n in text}
    if len(text) < len(names):
        found = placed.agg(*[F.percentile_approx(n, shares, 10_000).alias(n) for n in names if n not in text]).first()
        cuts |= {n: sorted(set(found[n] or [])) for n in names if n not in text}

    def index(*columns: pd.Series) -> pd.Series:
        cells = [[0 if pd.isna(x) else bisect_right(cuts[n], x) for x in c] if n in text
                 else np.where(c.isna(), 0, np.searchsorted(cuts[n], c.to_numpy(dtype=float), side="right"))
                 for n, c in zip(names, columns)]
        return pd.Series(hilbert_index(np.minimum(np.stack(cells, axis=1), 2 ** bits - 1), bits))

    return placed.withColumn("hilbert", F.pandas_udf(index, "long")(*names)).drop(*names)


def shard_rows(rows: DataFrame, order: list[str], shards: int) -> DataFrame:
    """Adds ``shard`` and ``slot`` (gapless from 0) to ``rows`` in the order of ``order``."""
    dealt = (rows.repartitionByRange(*order).sortWithinPartitions(*order)
             .withColumn("place", F.monotonically_increasing_id()))
    dealt = materialize(dealt, "shard-order")
    dealt = dealt.withColumn("range", F.shiftright("place", LOCAL_BITS))
    sizes = dealt.groupBy("range").agg(F.count(F.lit(1)).alias("held"))
    before, total = [], 0
    for r in sorted(sizes.collect()):          # one row per range
        before.append((r["range"], total))
        total += r["held"]
    offsets = rows.sparkSession.createDataFrame(before, "range long, before long")
    position = F.col("before") + F.col("place").bitwiseAND(F.lit(2 ** LOCAL_BITS - 1))
    out = dealt.join(F.broadcast(offsets), "range").withColumn("position", position)
    shard = F.expr(f"(position * {shards}L) div {max(total, 1)}L")
    first = F.expr(f"(shard * {max(total, 1)}L + {shards - 1}L) div {shards}L")
    return (out.withColumn("shard", shard).withColumn("slot", F.col("position") - first)
            .withColumn("shard", F.col("shard").cast("int")).drop("range", "before", "place", "position"))


def hilbert_shards(docs: DataFrame, dims: Mapping[str, Column], shards: int = 16, bits: int = 6) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, hilbert, shard, slot and the metadata columns."""
    prepare(docs.sparkSession)
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    light = docs.select("doc_id", (F.octet_length(raw).cast("long") + 1).alias("size"),
                        F.crc32(raw).alias("text_crc32"),
                        *[c.alias(f"meta_{n}") for n, c in dims.items()])
    meta = {n: F.col(f"meta_{n}") for n in dims}
    return shard_rows(with_hilbert(light, meta, bits), ["hilbert", "doc_id", "text_crc32", "size"], shards)


def shard_ranges(sharded: DataFrame) -> DataFrame:
    """Per shard: rows, bytes and the min and max of each metadata column, for pruning."""
    meta = [c for c in sharded.columns if c.startswith("meta_")]
    ends = [f(c).alias(f"{f.__name__}_{c[5:]}") for c in meta for f in (F.min, F.max)]
    return sharded.groupBy("shard").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("size").alias("n_bytes"), *ends)


def write_shards(docs: DataFrame, sharded: DataFrame, path: str) -> None:
    """Write the documents as Parquet files by shard, in curve order inside each."""
    place = sharded.select("doc_id", F.col("text_crc32").alias("__crc"), "shard", "slot")
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    once = place.withColumn("__n", F.row_number().over(
        Window.partitionBy("doc_id", "__crc").orderBy("shard", "slot")))
    rows = docs.withColumn("__crc", F.crc32(raw)).withColumn("__n", F.row_number().over(
        Window.partitionBy("doc_id", "__crc").orderBy(F.lit(0))))
    same = (F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("d.__crc") == F.col("p.__crc"))
            & (F.col("d.__n") == F.col("p.__n")))
    joined = rows.alias("d").join(once.alias("p"), same)
    (joined.select(*[f"d.`{c}`" for c in docs.columns], "p.shard", "p.slot")
     .repartitionByRange(F.col("shard"), F.col("slot")).sortWithinPartitions("shard", "slot")
     .drop("slot").write.partitionBy("shard").parquet(path))
