"""Exact dedup by deterministic block naming. DataFrame functions only.

A text is cut into blocks of ``block_bytes`` UTF-8 bytes. All distinct blocks of
the corpus are sorted and numbered; a block's number is its name. Then adjacent
pairs of names of a document are sorted and numbered in turn (a last name without
a partner pairs with -1), level after level, until every document has one name. Two
documents of as many blocks have the same last name exactly if their texts are
equal, so (number of blocks, last name), numbered once more, is the identity.

Sorted by what. Blocks are ordered by (64-bit hash, content), pairs by (64-bit
hash, left, right). That order is as good as any for names and it balances itself:
the upper 16 bits of the hash are the range in which a row is numbered, and ranges
get their offsets from their counts. Contents are compared only where a hash
has two of them, which is found by grouping on (hash, content): no collision
can join two texts, and the contents are shuffled once, merged on the map side.
Names come back to their places by a join on the hash, whose hot keys (a block
that fills a third of the corpus) adaptive execution splits.

Recovery and size: each level is written to the shared folder and read again;
a level has half the rows of the one before; only counts reach the driver.

Defined results: a null text counts as empty, and all empty texts are one group;
repeated rows are members of their own; of a group the row with the largest id
stays, of rows that share that id one; a null id comes before any other and
``keep_id`` is null where a group has no id. An empty table gives no rows. Columns other than the
named ones are not read, whatever their names. A text of any length is cut by
bytes, at a cost in proportion to its length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortflow.llm.common import materialize

#: Blocks hold so many bytes: long enough that most documents have one, short enough for a row.
BLOCK_BYTES = 4096
#: Of a hash, the bits that say in which range a row is numbered; ranges are added up in groups of 256.
RANGE_BITS = 16


def numbered(distinct: DataFrame, key: F.Column, order: list[str], label: str) -> DataFrame:
    """``distinct`` rows with ``name``: their place, from 0, in the order of (``key``, ``order``).

    ``key`` is a uniform 64-bit hash of the row. Rows are numbered inside ranges
    of it; no task sees more than a range, or the 256 totals of a group of ranges.
    """
    rows = materialize(distinct.withColumn("range", F.shiftright(key, 64 - RANGE_BITS).cast("int"))
                       .withColumn("order_key", key), label)
    totals = rows.groupBy("range").agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.shiftright("range", 8))
    upper = totals.groupBy("part").agg(F.sum("n").alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    upper = upper.select("part", before(Window.partitionBy(F.lit(0)).orderBy("part")).alias("upper"))
    offsets = totals.withColumn("inner", before(Window.partitionBy("part").orderBy("range"))).join(
        F.broadcast(upper), "part").select("range", (F.col("upper") + F.col("inner")).alias("offset"))
    place = F.row_number().over(Window.partitionBy("range").orderBy("order_key", *order))
    return (rows.withColumn("place", place).join(F.broadcast(offsets), "range")       # 65,536 rows at most
            .withColumn("name", F.col("offset") + F.col("place") - 1).drop("range", "order_key", "place", "offset"))


def _blocks(text: F.Column, block_bytes: int) -> F.Column:
    data = text.cast("binary")
    last = F.greatest(F.ceil(F.octet_length(text) / block_bytes).cast("int") - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last),
                       lambda i: F.substring(data, i * block_bytes + 1, F.lit(block_bytes)))


def _places(docs: DataFrame, block_bytes: int, hash_bits: int) -> tuple[DataFrame, DataFrame]:
    """Documents (own_row, own_id, text_sha256, n) and places (own_row, n, i, name) of their blocks."""
    def hashed(block):
        return F.shiftleft(F.xxhash64(block), 64 - hash_bits) if hash_bits < 64 else F.xxhash64(block)

    base = docs.select("own_id", F.coalesce("text", F.lit("")).alias("text"))
    cut = _blocks(F.col("text"), block_bytes)
    contents = (base.select(F.explode(cut).alias("block")).select(hashed(F.col("block")).alias("hash"), "block")
                .groupBy("hash", "block").agg(F.count(F.lit(1)).alias("n")))
    hashes = materialize(contents.groupBy("hash").agg(F.count(F.lit(1)).alias("contents")), "block-hashes")
    several = hashes.filter("contents > 1").select("hash", F.lit(True).alias("several"))
    clash = not several.isEmpty()

    spread = (base.withColumn("own_row", F.monotonically_increasing_id())
              .withColumn("text_sha256", F.sha2("text", 256)).withColumn("n", F.size(cut))
              .select("own_row", "own_id", "text_sha256", "n", F.posexplode(cut).alias("i", "block"))
              .withColumn("hash", hashed(F.col("block"))))
    if clash:       # some hash has two contents: there, and only there, the content goes along
        spread = spread.join(several, "hash", "left").withColumn("block", F.when(F.col("several"), F.col("block")))
    first = F.col("i") == 0
    spread = materialize(spread.select(
        "own_row", "n", "i", "hash", F.when(first, F.col("own_id")).alias("own_id"),
        F.when(first, F.col("text_sha256")).alias("text_sha256"), *(["block"] if clash else [])), "blocks")
    rows = spread.filter("i = 0").select("own_row", "own_id", "text_sha256", "n")
    if not clash:
        names = numbered(hashes.select("hash"), F.col("hash"), [], "block-names")
        return rows, spread.select("own_row", "n", "i", "hash").join(names, "hash").drop("hash")
    alone = hashes.filter("contents = 1").select("hash", F.lit(None).cast("binary").alias("block"))
    both = alone.unionByName(contents.join(several, "hash").select("hash", "block"))
    names = numbered(both, F.col("hash"), ["block"], "block-names").select(
        F.col("hash").alias("hash_"), F.col("block").alias("block_"), "name")
    met = (F.col("hash") == F.col("hash_")) & F.col("block").eqNullSafe(F.col("block_"))
    return rows, spread.join(names, met).select("own_row", "n", "i", "name")


def identities(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", *,
               block_bytes: int = BLOCK_BYTES, hash_bits: int = 64) -> DataFrame:
    """(own_row, own_id, text_sha256, n, identity) of every row; equal identities are equal texts.

    ``own_row`` tells rows apart within this table; ``n`` is the number of blocks.
    Fewer ``hash_bits`` make equal hashes of different blocks common (a test does so).
    """
    rows, now = _places(docs.select(F.col(id_column).alias("own_id"), F.col(text_column).alias("text")),
                        block_bytes, hash_bits)
    done = []
    now = materialize(now.withColumn("left", F.col("n")), "names")
    while True:
        done.append(now.filter("left = 1").select("own_row", "n", "name"))
        more = now.filter("left > 1")
        if more.isEmpty():
            break
        even = F.col("i") % 2 == 0
        pairs = materialize(
            more.groupBy("own_row", "n", "left", F.expr("i div 2").cast("int").alias("i")).agg(
                F.max(F.when(even, F.col("name"))).alias("a"),
                F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("b")), "pairs")
        names = numbered(pairs.select("a", "b").distinct(), F.xxhash64("a", "b"), ["a", "b"], "pair-names")
        now = materialize(pairs.join(names, ["a", "b"]).select(
            "own_row", "n", F.expr("(left + 1) div 2").cast("int").alias("left"), "i", "name"), "names")
    last = done[0]
    for d in done[1:]:
        last = last.unionByName(d)
    last = materialize(last, "last-names")
    final = numbered(last.select("n", "name").distinct().withColumnRenamed("name", "last"),
                     F.xxhash64("n", "last"), ["n", "last"], "identities").withColumnRenamed("name", "identity")
    return rows.drop("n").join(last.withColumnRenamed("name", "last"), "own_row").join(final, ["n", "last"]).drop("last")


def groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """Per row: own_id, keep_id, group_size, kept, text_sha256, identity."""
    found = materialize(identities(docs, id_column, text_column, **options), "identity")
    member = F.struct("own_id", "own_row")
    # written first, so that the join deals both sides out itself and can split a hot identity
    sums = materialize(found.groupBy("identity").agg(F.max(member).alias("stays"), F.count(F.lit(1)).alias("group_size")),
                       "groups")
    return found.join(sums, "identity").select(
        "own_id", F.col("stays.own_id").alias("keep_id"), "group_size",
        (F.col("own_row") == F.col("stays.own_row")).alias("kept"), "text_sha256", "identity")


ORACLE = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))"""
