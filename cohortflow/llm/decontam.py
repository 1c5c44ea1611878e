"""Benchmark decontamination with suffix arrays over the training text.

The training side is cut into shards: runs of documents of a few megabytes
inside each Spark partition. A shard's words become integers (0 for words
that no benchmark item has, and between documents), and its suffix array holds
the word positions sorted by the words that follow. Positions whose run of
benchmark words is shorter than the shortest window are left out, since no
window can start there, and order is kept to ``DEPTH`` words, which is all
a window asks for. Every benchmark suffix is then binary-searched in every
shard; the suffixes under a window's prefix are its occurrences, with their
locations. Occurrences that continue each other along a diagonal (document
position minus item position) give the longest verbatim match.

The benchmark, without its repeated rows, is the broadcast side and is cut into
blocks of at most half of ``block_bytes`` of text (or one longer item). A scan of the documents meets up to
``SCAN_BLOCKS`` blocks; what it finds is written before the next blocks are prepared, so no more than those are
held by the driver or a task. A document's rows, one for the first block and one for each other block that hits it, are
merged. Documents are never shuffled for one block.

Words are runs of ``[0-9a-z]`` and non-ASCII characters after lower-casing
A-Z. A window is ``window`` consecutive item words; a shorter item that has a
word is one window. A document word is hit when any occurrence of any window
covers it.

Defined results: a null or empty text has no words and is clean; an item
without words has no window; repeated items count once by item_id; an item
without id is reported as the empty id; repeated documents each get their
row; an empty benchmark leaves every document clean; an empty documents
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortflow.llm.common import materialize, prepare, text_slices, word_pieces

WINDOW = 10
DEPTH = 16
SHARD_BYTES = 1 << 22
#: A half-full block of this size takes some 450 MB of the driver while it is prepared, and 87 MB broadcast.
BLOCK_BYTES = 8 << 20
#: Blocks that one scan of the documents meets; a task holds as many.
SCAN_BLOCKS = 4
#: Lower-cases A-Z and turns every ASCII byte that is no letter or digit into a space.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
FOUND = ("doc_id long, text_key long, n_words long, n_hit long, spans array<struct<start:long,end:long>>, "
         "items array<string>, longest_words long, longest_item string, longest_start long")


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(WORD_BYTES).split()


class Block:
    """Benchmark items prepared for the search: vocabulary, suffixes and their windows."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        if window > DEPTH:
            raise ValueError(f"windows of more than {DEPTH} words need a deeper suffix order")
        self.vocab: dict[bytes, int] = {}
        at: dict[tuple, list[tuple[int, int]]] = {}
        self.names = sorted({name for name, _ in items})
        number = {n: i for i, n in enumerate(self.names)}
        for name, raw in sorted(set(items)):
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(raw)]
            m = min(window, len(ids))
            for o in range(len(ids) - m + 1 if m else 0):
                at.setdefault(tuple(ids[o:o + m]), []).append((number[name], o))
        self.length = np.array([len(k) for k in at], dtype=np.int64)
        self.shortest = int(self.length.min()) if at else 0
        key = np.zeros((len(at), DEPTH), dtype=">u4")
        for i, k in enumerate(at):
            key[i, :len(k)] = k
        top = key.copy()
        for i, n in enumerate(self.length):
            top[i, n:] = 0xFFFFFFFF
        self.low, self.high = _keys(key), _keys(top)
        self.first = np.cumsum([0] + [len(v) for v in at.values()])
        pairs = [p for v in at.values() for p in v]
        self.item = np.array([p[0] for p in pairs], dtype=np.int64)
        self.offset = np.array([p[1] for p in pairs], dtype=np.int64)


def _keys(words: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(words, dtype=">u4").view(f"S{4 * DEPTH}").ravel()


def _expand(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All integers of the ranges, and the number of the range each comes from."""
    size = end - start
    which = np.repeat(np.arange(len(size)), size)
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size), which


def suffix_array(ids: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, keys) of the suffixes that can start a window, in suffix order."""
    zero = np.flatnonzero(ids == 0)
    stop = zero[np.searchsorted(zero, np.arange(len(ids)))]         # ids end with a zero
    at = np.flatnonzero(stop - np.arange(len(ids)) >= max(shortest, 1))
    around = at[:, None] + np.arange(DEPTH)[None, :]
    words = np.where(around < stop[at][:, None], ids[np.minimum(around, len(ids) - 1)], 0)
    key = _keys(words.reshape(-1, DEPTH)) if len(at) else np.empty(0, dtype=f"S{4 * DEPTH}")
    order = np.argsort(key, kind="stable")
    return at[order], key[order]


def search(shard: list[bytes], block: Block) -> list[tuple]:
    """Per text: n_words, n_hit, spans, items, longest match (words, item, start word)."""
    get, sizes, ids = block.vocab.get, [], []
    for raw in shard:
        n = 0
        for piece in word_pieces(raw.translate(WORD_BYTES)):
            words = piece.split()
            n += len(words)
            ids.append(np.fromiter(map(get, words, repeat(0)), dtype=np.int64, count=len(words)))
        ids.append(np.zeros(1, dtype=np.int64))
        sizes.append(n)
    none = (0, [], [], 0, None, None)
    if not len(block.length) or not shard:
        return [(n, *none) for n in sizes]
    ids = np.concatenate(ids)
    begin = np.cumsum([0] + [n + 1 for n in sizes])[:-1]
    place, key = suffix_array(ids, block.shortest)
    rank, window = _expand(np.searchsorted(key, block.low, side="left"),
                           np.searchsorted(key, block.high, side="right"))
    if not len(rank):
        return [(n, *none) for n in sizes]
    at = place[rank]
    cover = np.zeros(len(ids) + 1, dtype=np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + block.length[window], -1)
    hit = np.cumsum(cover) > 0
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    opens, closes = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    doc = np.searchsorted(begin, at, side="right") - 1
    pair = np.unique(doc * len(block.length) + window)              # a window once per document
    pair_doc, pair_window = pair // len(block.length), pair % len(block.length)
    use, of = _expand(block.first[pair_window], block.first[pair_window + 1])
    has = np.unique(pair_doc[of] * len(block.names) + block.item[use])
    # longest verbatim matches: occurrences that follow each other on one diagonal
    use, of = _expand(block.first[window], block.first[window + 1])
    pos, item, diagonal = at[of], block.item[use], at[of] - block.offset[use]
    order = np.lexsort((pos, diagonal, item))
    pos, item, diagonal, span = pos[order], item[order], diagonal[order], block.length[window[of]][order]
    breaks = np.ones(len(pos), dtype=bool)
    breaks[1:] = (item[1:] != item[:-1]) | (diagonal[1:] != diagonal[:-1]) | (pos[1:] != pos[:-1] + 1)
    head = np.flatnonzero(breaks)
    tail = np.append(head[1:], len(pos)) - 1
    long, long_at, long_item = pos[tail] + span[tail] - pos[head], pos[head], item[head]
    long_doc = np.searchsorted(begin, long_at, side="right") - 1
    best = np.lexsort((long_at, long_item, -long, long_doc))
    lead = best[np.unique(long_doc[best], return_index=True)[1]]
    longest = {int(long_doc[i]): (int(long[i]), block.names[long_item[i]], int(long_at[i] - begin[long_doc[i]]))
               for i in lead}
    spans, items = {}, {}
    for a, b in zip(opens.tolist(), closes.tolist()):
        d = int(np.searchsorted(begin, a, side="right")) - 1
        spans.setdefault(d, []).append({"start": a - int(begin[d]), "end": b - int(begin[d])})
    for x in has.tolist():
        items.setdefault(x // len(block.names), []).append(block.names[x % len(block.names)])
    return [(n, sum(s["end"] - s["start"] for s in spans.get(i, [])), spans.get(i, []),
             sorted(items.get(i, [])), *longest.get(i, (0, None, None))) for i, n in enumerate(sizes)]


def block_starts(items: DataFrame, most: int) -> list[int]:
    """First hash of each block of ``items`` (name, text, at: hash); a block of several items holds at most ``most`` bytes.

    Totals of some 64 ranges of the hash per block reach the driver, and the
    items' sizes only of ranges that alone hold more than a block.
    """
    sized = items.select("at", (F.octet_length("text") + F.octet_length("name") + 64).cast("long").alias("size"))
    held = sized.agg(F.sum("size")).first()[0] or 0
    if held <= most:
        return [-2 ** 63]
    shift = 64 - min(48, (64 * held // most).bit_length())
    totals = sized.groupBy(F.shiftright("at", shift).alias("range")).agg(F.sum("size").alias("size")).collect()
    large = [r["range"] for r in totals if r["size"] > most]
    units = [(r["range"] << shift, r["size"]) for r in totals if r["size"] <= most]
    if large:
        units += [tuple(r) for r in sized.filter(F.shiftright("at", shift).isin(large))
                  .groupBy("at").agg(F.sum("size").alias("size")).collect()]
    starts, room = [-2 ** 63], most
    for at, size in sorted(units):
        if size > room and room < most:
            starts.append(at)
            room = most
        room -= size
    return starts


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
            block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document with the words, hits, hit spans, items and longest match."""
    spark = prepare(docs.sparkSession)
    items = materialize(benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), F.coalesce("text", F.lit("")).alias("text"))
        .distinct().withColumn("at", F.xxhash64("name", "text")), "benchmark")
    starts = block_starts(items, max(block_bytes // 2, 1))          # half: what is measured to fit
    blocks = len(starts)
    schema = pa.schema([
        ("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        ("items", pa.list_(pa.string())), ("longest_words", pa.int64()), ("longest_item", pa.string()),
        ("longest_start", pa.int64()), ("block", pa.int32())])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")

    def prepared(number: int):
        part = items if number == 0 else items.filter(F.col("at") >= starts[number])
        part = part if number + 1 == blocks else part.filter(F.col("at") < starts[number + 1])
        return spark.sparkContext.broadcast(
            Block([(r["name"], r["text"].encode()) for r in part.toLocalIterator()], window))

    def scan(held: dict) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for cut in text_slices(batch, "text", SHARD_BYTES):
                    texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in cut.column("text")]
                    for number, block in held.items():
                        found = search(texts, block.value)
                        use = [i for i, f in enumerate(found) if number == 0 or f[1]]
                        part = cut if len(use) == len(found) else cut.take(pa.array(use, pa.int64()))
                        columns = list(zip(*[found[i] for i in use])) or [()] * (len(schema) - 3)
                        yield pa.RecordBatch.from_arrays(
                            [part.column("doc_id"), part.column("text_key"),
                             *[pa.array(c, t) for c, t in zip(columns, schema.types[2:])],
                             pa.array([number] * len(use), pa.int32())], schema=schema)

        return rows.mapInArrow(run, f"{FOUND}, block int")

    if blocks == 1:
        return scan({0: prepared(0)}).drop("block")
    every = []
    for first in range(0, blocks, SCAN_BLOCKS):
        held = {n: prepared(n) for n in range(first, min(first + SCAN_BLOCKS, blocks))}
        every.append(materialize(scan(held), "decontam-scan"))
        for block in held.values():
            block.destroy()
    return _merge(reduce(DataFrame.union, every))


def _merge(every: DataFrame) -> DataFrame:
    """One row per document from its rows per block; repeated documents come back as often as they were."""
    longest = F.struct((-F.col("longest_words")).alias("less"), F.col("longest_item").alias("item"),
                       F.col("longest_start").alias("start"), "longest_words")
    by_block = (every.groupBy("doc_id", "text_key", "n_words", "block")
                .agg(F.first("spans").alias("spans"), F.first("items").alias("items"),
                     F.min(longest).alias("longest"), F.count(F.lit(1)).alias("copies")))
    # a row per block that hits the document meets here
    merged = by_block.groupBy("doc_id", "text_key", "n_words").agg(
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("raw"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.min("longest").alias("longest"), F.max("copies").alias("copies"))
    joined = F.aggregate("raw", F.array().cast("array<struct<start:long,end:long>>"), lambda acc, s: F.when(
        (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= s["start"]),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(
            F.element_at(acc, -1)["start"].alias("start"),
            F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end")))))
        .otherwise(F.concat(acc, F.array(s))))
    return (merged.withColumn("spans", joined)
            .withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]))
            .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
            .select("doc_id", "text_key", "n_words", "n_hit", "spans", "items", "longest.longest_words",
                    F.col("longest.item").alias("longest_item"), F.col("longest.start").alias("longest_start")))


def digest(found: DataFrame) -> DataFrame:
    """The counting form of ``matches``."""
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
        "longest_words", "longest_item", "longest_start")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the documents that hold a window of the benchmark.

    The affected (doc_id, text) keys are few beside the documents and are
    anti-joined; documents with equal id and text share their verdict.
    """
    bad = (matches(docs, benchmark, window).filter("n_hit > 0")
           .select(F.coalesce("doc_id", F.lit(2 ** 63 - 1)).alias("own_id"), "text_key").distinct())
    rows = docs.select(F.struct("*").alias("own_row"), F.coalesce(F.col("doc_id").cast("long"),
                       F.lit(2 ** 63 - 1)).alias("own_id"), F.xxhash64("text").alias("text_key"))
    return rows.join(bad, ["own_id", "text_key"], "left_anti").select("own_row.*")


ORACLE = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
item_words AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS m, array_to_string(w[o:o + least(len(w), 10) - 1], ' ') AS k
  FROM item_words, unnest(range(1, greatest(len(w) - least(len(w), 10), 0) + 2)) AS t(o) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT m FROM windows),
grams AS (
  SELECT doc_id, p, m, array_to_string(w[p:p + m - 1], ' ') AS k
  FROM words, sizes, unnest(range(1, greatest(len(w) - m + 2, 1))) AS t(p)),
hits AS (SELECT doc_id, p, m, item FROM grams JOIN windows USING (m, k)),
covered AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM hits, unnest(range(p, p + m)) AS t(q) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item) AS n_items,
                 array_to_string(list_sort(list(DISTINCT item)), ',') AS items FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""
