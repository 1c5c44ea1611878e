"""SimHash near-dedup by Golay-code fuzzy hashing.

Fingerprints: 64 bits over word shingles hashed with XXH64 (seed 42); a bit
is set when more than half of the shingle hashes have it. Fingerprints link
at ``max_bits`` = 4 or fewer differing bits; documents linked through any
chain form a component.

Keys. A fingerprint is cut into three segments of 21, 21 and 22 bits. The
binary Golay code (23, 12) is perfect: every 23-bit word lies within three
bits of exactly one codeword, so decoding is a total function. Two segments
at distance two or less have a common neighbour at distance one or less from
both; the codewords to which a segment's neighbours decode (six at most) are
its fuzzy keys, and two such segments share one. With four errors over three
segments, sorted ``e1 <= e2 <= e3``, there are two cases:

* ``e1 = 0``: then ``e2 <= 2``. Key: the untouched segment with one fuzzy key
  of another, for each of the six ordered pairs.
* ``e1 = 1``: then ``e2 = 1`` too. A segment has three blocks and one error
  spoils one of them. Key: two segments, each without one block, for each
  of the three pairs and nine choices of blocks.

So every pair within four bits shares a key, and every key has 33 or more
bits of the fingerprint (28 in the second case), which keeps chance meetings
rare as the corpus grows. Every meeting is verified on the full 64 bits.

Linking without all pairs. Exact copies collapse to one fingerprint first.
Keys met by a single fingerprint go. Each remaining key first links its
members to one lead (linear in the members). Keys whose members now lie in
one component are done; the others choose another lead, while that still
settles a good part; what is left is joined within its keys, between members
of different components only. Links are verified in the join's condition, so
no unverified pair leaves it. No link that matters to a component is lost.

Defined results: a null or empty text has fingerprint zero and links like any
other; fewer words than a shingle make one shingle of the whole text; repeated
rows are documents of their own; component_id is the smallest non-null doc_id
of the component; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortflow.llm.common import ASCII_LOWER, materialize, prepare, text_slices, word_pieces
from cohortflow.llm.components import components

SEED = 42
SEGMENTS = ((0, 21), (21, 21), (42, 22))        # (first bit, bits)
BLOCKS = ((0, 7), (7, 7), (14, 8))              # within a segment
GENERATOR = 0xC75                               # x^11+x^10+x^6+x^5+x^4+x^2+1
MAX_BITS = 4


# --------------------------------------------------------------- fingerprints

def fingerprint(raw: bytes, width: int) -> int:
    """Unsigned SimHash of a text's UTF-8 bytes."""
    import xxhash
    digest = xxhash.xxh64_intdigest
    ones, total, tail = np.zeros(64, dtype=np.int64), 0, []
    for piece in word_pieces(raw.translate(ASCII_LOWER)):
        words = tail + piece.split()
        if len(words) >= width:
            line = b" ".join(words)
            sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
            ends = np.cumsum(sizes + 1) - 1
            starts = (ends - sizes)[:len(words) - width + 1].tolist()
            hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends[width - 1:].tolist())],
                              dtype=">u8")
            for at in range(0, len(hashes), 1 << 16):
                ones += np.unpackbits(hashes[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8),
                                      axis=1).sum(axis=0, dtype=np.int64)
            total += len(hashes)
            words = words[len(words) - width + 1:] if width > 1 else []
        tail = words
    if total == 0:
        if not tail:
            return 0
        return digest(b" ".join(tail), SEED)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, text_key, fp): one row per document; fp is the fingerprint as a signed long."""
    prepare(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text", 1 << 22):
                fps = [fingerprint((t.as_buffer().to_pybytes() if t.is_valid else b""), width)
                       for t in part.column("text").cast(pa.large_string())]
                fp = np.array(fps, dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_key"), pa.array(fp)], schema=schema)

    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    return cols.mapInArrow(run, "doc_id long, text_key long, fp long")


# ----------------------------------------------------------------- fuzzy keys

class Golay:
    """Decoding tables of the cyclic (23, 12) code, built from its generator."""

    def __init__(self):
        self.high = np.array([self._rest(m << 11) for m in range(1 << 12)], dtype=np.int64)
        self.error = np.zeros(1 << 11, dtype=np.int64)
        for n in (1, 2, 3):
            for bits in itertools.combinations(range(23), n):
                e = sum(1 << b for b in bits)
                self.error[self._rest(e)] = e

    @staticmethod
    def _rest(v: int) -> int:
        for b in range(22, 10, -1):
            if v >> b & 1:
                v ^= GENERATOR << (b - 11)
        return v

    def decode(self, v: np.ndarray) -> np.ndarray:
        """12-bit index of the codeword nearest to each 23-bit word."""
        return (v ^ self.error[(v & 0x7FF) ^ self.high[v >> 11]]) >> 11

    def fuzzy(self, v: np.ndarray, bits: int) -> np.ndarray:
        """Sorted indices for each word and its neighbours in the low ``bits``; repeats are -1."""
        flips = np.array([0] + [1 << b for b in range(bits)], dtype=np.int64)
        near = np.sort(self.decode(v[:, None] ^ flips[None, :]), axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        return near


def fuzzy_keys(fp: np.ndarray, golay: Golay) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) pairs for unsigned fingerprints."""
    seg = [((fp >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    rows, keys = [], []
    fuzzy = [golay.fuzzy(s, n) for s, (_, n) in zip(seg, SEGMENTS)]
    for tag, (a, b) in enumerate(itertools.permutations(range(3), 2)):
        row, col = np.nonzero(fuzzy[b] >= 0)
        rows.append(row)
        keys.append((tag << 50) | (seg[a][row] << 12) | fuzzy[b][row, col])
    for p, (a, b) in enumerate(itertools.combinations(range(3), 2)):
        for i, j in itertools.product(range(3), repeat=2):
            without = [s & ~(((1 << n) - 1) << at) for s, (at, n) in ((seg[a], BLOCKS[i]), (seg[b], BLOCKS[j]))]
            rows.append(np.arange(len(fp)))
            keys.append(((6 + 9 * p + 3 * i + j) << 50) | (without[0] << 22) | without[1])
    return np.concatenate(rows), np.concatenate(keys)


def key_table(fps: DataFrame) -> DataFrame:
    """(key, fp) for distinct fingerprints."""
    schema = pa.schema([("key", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        golay = Golay()
        for batch in batches:
            every = batch.column("fp").to_numpy()
            for at in range(0, len(every), 2000):
                fp = every[at:at + 2000]
                row, key = fuzzy_keys(fp.view(np.uint64), golay)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row])], schema=schema)

    return fps.select("fp").mapInArrow(run, "key long, fp long")


# -------------------------------------------------------------------- linking

def _near(a: str, b: str, max_bits: int):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= max_bits


def link(fps: DataFrame, max_bits: int = MAX_BITS, rounds: int = 4) -> DataFrame:
    """(fp, root) for fingerprints that link to another; ``fps``: distinct ``fp``.

    The keys cover up to four differing bits.
    """
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError("the fuzzy keys cover at most four differing bits")
    keys = key_table(fps)
    shared = (keys.groupBy("key").agg(F.min("fp").alias("lead"), F.max("fp").alias("last"))
              .filter("lead < last").drop("last"))
    # the size estimate of ``keys`` is that of the fingerprints, some 59 times too small: never broadcast it
    members = materialize(keys.join(shared.hint("merge"), "key"), "simhash-keys")
    links = (members.filter((F.col("fp") != F.col("lead")) & _near("fp", "lead", max_bits))
             .select("fp", "lead").distinct())
    roots = materialize(components(links, "fp", "lead"), "simhash-roots")
    members, left = members.drop("lead"), None
    for again in range(rounds + 1):
        placed = (members.join(roots, members["fp"] == roots["node"], "left")
                  .select("key", "fp", F.coalesce("root", "fp").alias("root")))
        placed = materialize(placed, "simhash-placed")
        pick = F.min_by("fp", F.xxhash64(F.lit(again), "fp"))
        mixed = (placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"),
                                           pick.alias("lead"))
                 .filter("low < high").select("key", "lead"))
        placed = materialize(placed.join(mixed, "key"), "simhash-open")
        size = placed.count()
        if size == 0:
            return roots.select(F.col("node").alias("fp"), "root")
        last = again == rounds or (left is not None and size > 0.7 * left)
        if last:
            a = placed.select("key", F.col("fp").alias("fp_a"), F.col("root").alias("root_a"))
            b = placed.select("key", F.col("fp").alias("fp_b"), F.col("root").alias("root_b"))
            met = (a.join(b, (a["key"] == b["key"]) & (F.col("root_a") < F.col("root_b"))
                          & _near("fp_a", "fp_b", max_bits))
                   .select(F.col("root_a").alias("u"), F.col("root_b").alias("v")).distinct())
        else:
            # the lead's own component comes with the lead
            lead = (placed.filter("fp = lead").select("key", F.col("root").alias("lead_root")))
            met = (placed.join(lead, "key")
                   .filter((F.col("root") != F.col("lead_root")) & _near("fp", "lead", max_bits))
                   .select(F.col("root").alias("u"), F.col("lead_root").alias("v")).distinct())
        merged = materialize(components(met, "u", "v"), "simhash-merged")
        known = (roots.join(merged.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
                 .select("node", F.coalesce("top", "root").alias("root")))
        fresh = merged.join(roots.select("node"), "node", "left_anti").select("node", "root")
        roots = materialize(known.union(fresh), "simhash-roots")
        if last:
            return roots.select(F.col("node").alias("fp"), "root")
        members, left = placed.select("key", "fp"), size
    raise AssertionError("unreachable")


def near_groups(light: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(fp, root, component_id) of every fingerprint shared or linked; ``light``: doc_id, fp."""
    fps = materialize(light.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("held")),
                      "simhash-fps")
    roots = link(fps, max_bits)
    placed = (fps.join(roots, "fp", "left").filter("root is not null or held > 1")
              .withColumn("root", F.coalesce("root", "fp")))
    placed = materialize(placed, "simhash-groups")
    ids = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    return placed.join(ids, "root").select("fp", "root", "component_id")


def salted(light: DataFrame, groups: DataFrame, salts: int = 16) -> DataFrame:
    """``light`` with root and component_id (null where a fingerprint stands alone)."""
    spread = groups.select("*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    dealt = light.withColumn("salt", F.pmod(F.hash("doc_id", "text_key"), F.lit(salts)))
    return dealt.join(spread, ["fp", "salt"], "left").drop("salt")


def simhash_components(docs: DataFrame, width: int = 4, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    light = materialize(fingerprints(docs, width), "simhash-light")
    met = salted(light, near_groups(light, max_bits))
    return met.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                      F.coalesce("component_id", "doc_id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, width: int = 4, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one document of each component: the smallest doc_id, then the smallest text key.

    Documents without id come last in their component; repeated rows of the
    kept document count once.
    """
    light = materialize(fingerprints(docs, width), "simhash-light")
    met = salted(light, near_groups(light, max_bits)).filter("root is not null")
    ident = [F.coalesce("doc_id", F.lit(2 ** 63 - 1)).alias("own_id"), "text_key"]
    met = materialize(met.select("root", *ident), "simhash-met")
    first = met.groupBy("root").agg(F.min(F.struct("own_id", "text_key")).alias("first"))
    first = first.select("first.own_id", "first.text_key")
    gone = met.select("own_id", "text_key").distinct().join(first.hint("merge"), ["own_id", "text_key"], "left_anti")
    rows = docs.select(F.struct("*").alias("own_row"), F.coalesce(F.col("doc_id").cast("long"),
                       F.lit(2 ** 63 - 1)).alias("own_id"), F.xxhash64("text").alias("text_key"))
    # repeats meet on the keys of the anti-join, so texts are dealt once; ``gone`` grows with the rows: never broadcast it
    kept = rows.dropDuplicates(["own_id", "text_key"]).join(gone.hint("merge"), ["own_id", "text_key"], "left_anti")
    return kept.select("own_row.*")
