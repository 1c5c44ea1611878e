"""Helpers shared by the operators of this package."""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortflow.session import ensure_checkpoint_dir, ship_code

#: Bytes 0x20 and 0x09-0x0D separate words; ``bytes.split()`` uses exactly these.
ASCII_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


BLANK = re.compile(rb"[\x20\x09-\x0D]")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path below the session's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it again.

    Cuts the lineage: executors that are lost later cost a re-read, not a
    recomputation, and every consumer sees the same rows.
    """
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sample_labels(known: DataFrame, max_rows: int) -> DataFrame:
    """``known`` (own_id, label): one row per id, the ``max_rows`` ids of smallest hash; of several labels the smallest."""
    return (known.groupBy("own_id").agg(F.min("label").alias("label"))
            .orderBy(F.xxhash64("own_id"), "own_id").limit(max_rows))


def sample_texts(docs: DataFrame, sample: DataFrame, max_rows: int, label: str) -> DataFrame:
    """At most ``max_rows`` rows (own_id, text, label) of ``docs`` (own_id, text) in ``sample``, distinct.

    Every id's first text by hash comes before any other, so that an id of
    many texts does not crowd out the others.
    """
    rows = materialize(docs.join(F.broadcast(sample), "own_id").withColumn("key", F.xxhash64("text"))
                       .dropDuplicates(["own_id", "key"]), label)
    firsts = rows.groupBy("own_id").agg(F.min("key").alias("first"))        # a row per sampled id
    return (rows.join(F.broadcast(firsts), "own_id")
            .orderBy(F.col("key") != F.col("first"), F.xxhash64("own_id"), "own_id", "key").limit(max_rows)
            .select("own_id", "text", "label"))


def prepare(spark: SparkSession) -> SparkSession:
    """Make this package importable in Python workers."""
    ship_code(spark)
    return spark


def giving_back(run):
    """``run`` (batches in, batches out) that hands the memory Arrow keeps unused back to the system when a task ends.

    A Python worker serves task after task, and what Arrow's pool once held stays with it
    through every later stage, beside an executor heap that is at its largest elsewhere.
    """
    def whole(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
    return whole


def text_slices(batch, column: str, most: int):
    """Cut an Arrow batch into runs of rows whose texts hold about ``most`` bytes."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        held += n
        if held >= most:
            yield batch.slice(start, i + 1 - start)
            start, held = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def word_pieces(raw: bytes, most: int = 1 << 20):
    """Consecutive parts of a text of about ``most`` bytes, cut only at white space."""
    start = 0
    while start < len(raw):
        end = start + most
        if end < len(raw):
            blank = BLANK.search(raw, end)
            end = blank.start() if blank else len(raw)
        yield raw[start:end]
        start = end


#: Integer components stay below this, so that sums of products over 4,096 of them fit a long with room to spare.
MOST = 1 << 22


def finite(vector) -> F.Column:
    """True for a vector (array column) without null, NaN or infinite components; null for a null vector."""
    return F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def whole(vector, scale: int) -> F.Column:
    """floor(scale * x) of every component, x as double; a component of ``MOST`` or beyond stops the job."""
    def one(x):
        y = F.floor(x.cast("double") * scale)
        return F.when(F.abs(x.cast("double") * scale) < MOST, y.cast("int")).otherwise(
            F.raise_error(F.lit("a vector component is too large for exact integer arithmetic")).cast("int"))
    return F.transform(vector, one)


def int_matrix(column, dims: int) -> np.ndarray:
    """An Arrow column of integer lists as a matrix of ``dims`` columns; shorter lists end in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy(zero_copy_only=False))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), dims), np.int64)
    out[np.arange(dims) < sizes[:, None]] = flat
    return out
