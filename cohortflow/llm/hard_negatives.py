"""Hard-negative mining with rotated one-bit codes.

Every vector is turned by a fixed random rotation (seeded sign flips and Hadamard
transforms, the same on every machine). Its code is the signs of its components: a
unit vector ``s``; beside it are stored the alignment ``a = <x, s>`` and the length
``r`` of what the code leaves of the vector. What is left is coded in the same
way, ``levels`` times. A query keeps its rotated components in ``PLANES`` bits, cut into
bit planes, so that its product with a code is a sum of popcounts; the rounding
of those bits has a known bound ``e``.

The estimate of <q, x> is the sum of ``a * <q, s>`` over the levels so far. The rest
of x is orthogonal to its last code, so by Cauchy and Schwarz it adds at most
``r * sqrt(|q|^2 - <q, s>^2)``, and rounding at most ``e`` times the alignments. No
probability is involved: the true product always lies in that interval. A pair
whose interval misses the scores still wanted is dropped, level by level; what survives
is scored with integers. So the answer is exact; the codes only spare work.

Work is dealt as cells of a slab of rows and a block of anchors, both of bounded
size and by hash, so that no label, group of copies or anchor gathers in a task. A cell
returns the few best rows per anchor, and Spark ranks those. Anchors are a stated set
of rows, not all of them, and nothing passes the driver but counts. The codes are
written once, so that a lost executor costs a re-read.

Defined results: rows with a null id or label, a null vector or a null or non-finite
component take no part. Of rows with an equal id one takes part, that of the smallest
label, then vector. Shorter vectors end in zeros. Equal vectors are rows of their
own; ties go to the smaller id. An anchor without other rows of its label gives no rows,
nor does a positive whose range of scores is empty (as for a negative score). An empty table gives
no rows. Columns other than the named ones are not read, whatever their names. A
component beyond 2**22 after scaling stops the job.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortflow.llm.common import finite, int_matrix, materialize, prepare, whole

LEVELS, PLANES, SEED = 4, 8, 13
#: Rows in a slab, anchors in a block; a block is worked through in parts.
SLAB, BLOCK, PART, PAIRS = 1 << 17, 1 << 16, 512, 1 << 20
#: Added to every interval for floating-point rounding, in parts of |q| |x|.
SLACK = 1e-9


# ------------------------------------------------------------------- codes

def rotate(vectors: np.ndarray, seed: int = SEED) -> np.ndarray:
    """The vectors, padded with zeros to a power of two (64 at least), after three rounds of flips and Hadamard."""
    size = max(64, 1 << (max(vectors.shape[1], 1) - 1).bit_length())
    out = np.zeros((len(vectors), size))
    out[:, :vectors.shape[1]] = vectors
    rng = np.random.default_rng(seed)
    for _ in range(3):
        out *= np.where(rng.integers(0, 2, size) == 1, 1.0, -1.0)
        half = 1
        while half < size:
            pair = out.reshape(len(out), -1, 2, half)
            out = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], axis=2).reshape(len(out), size)
            half *= 2
        out /= np.sqrt(size)
    return out


def words(bits: np.ndarray) -> np.ndarray:
    """Booleans along the last axis as 64-bit words."""
    return np.packbits(bits, axis=-1, bitorder="little").view(np.uint64)


def encode(rotated: np.ndarray, levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (rows, levels, words), alignments and lengths of the rest (rows, levels)."""
    rest, size = rotated.copy(), rotated.shape[1]
    codes, aligned, left = [], [], []
    for _ in range(levels):
        sign = rest > 0
        s = np.where(sign, 1.0, -1.0) / np.sqrt(size)
        a = (rest * s).sum(axis=1)
        rest -= a[:, None] * s
        codes.append(words(sign))
        aligned.append(a)
        left.append(np.sqrt((rest * rest).sum(axis=1)))
    return np.stack(codes, axis=1), np.stack(aligned, axis=1), np.stack(left, axis=1)


class Queries:
    """Rotated query vectors in ``PLANES`` bits, as bit planes, with the bound of their rounding."""

    def __init__(self, rotated: np.ndarray):
        self.size = rotated.shape[1]
        self.low = rotated.min(axis=1)
        self.step = np.maximum((rotated.max(axis=1) - self.low) / ((1 << PLANES) - 1), 1e-300)
        units = np.rint((rotated - self.low[:, None]) / self.step[:, None])
        self.error = np.abs(rotated - self.low[:, None] - units * self.step[:, None]).sum(axis=1) / np.sqrt(self.size)
        self.length = np.sqrt((rotated * rotated).sum(axis=1))
        self.total = units.sum(axis=1)
        units = units.astype(np.int64)
        self.planes = np.stack([words((units >> j) & 1 == 1) for j in range(PLANES)], axis=1)

    def product(self, q: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """<rounded query, code vector> of the pairs (q, code), by popcounts."""
        ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
        hits = np.zeros(len(q), np.int64)
        for j in range(PLANES):
            hits += np.bitwise_count(codes & self.planes[q, j]).sum(axis=1, dtype=np.int64) << j
        return (self.low[q] * (2 * ones - self.size) + self.step[q] * (2 * hits - self.total[q])) / np.sqrt(self.size)


def interval_filter(queries: Queries, codes: np.ndarray, aligned: np.ndarray, left: np.ndarray, q: np.ndarray,
                    x: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (q, x) whose product may lie from low[q] to high[q]."""
    estimate, rounding = np.zeros(len(q)), np.zeros(len(q))
    for level in range(codes.shape[1]):
        along = queries.product(q, codes[x, level])
        a = aligned[x, level]
        estimate = estimate + a * along
        rounding = rounding + np.abs(a) * queries.error[q]
        sure = np.maximum(np.abs(along) - queries.error[q], 0)
        across = np.sqrt(np.maximum(queries.length[q] ** 2 - sure ** 2, 0))
        first = np.sqrt(aligned[x, 0] ** 2 + left[x, 0] ** 2)           # the length of x
        width = rounding + left[x, level] * across + SLACK * queries.length[q] * first + 1e-6
        may = (estimate + width >= low[q]) & (estimate - width <= high[q])
        q, x, estimate, rounding = q[may], x[may], estimate[may], rounding[may]
        if not len(q):
            break
    return q, x


class Best:
    """The ``most`` best (score down, id up) rows of each group."""

    def __init__(self, groups: int, most: int):
        self.most = most
        self.ids = np.zeros((groups, most), np.int64)
        self.scores = np.zeros((groups, most), np.int64)
        self.held = np.zeros(groups, np.int64)

    def floor(self) -> np.ndarray:
        """Below this a score cannot enter its group."""
        return np.where(self.held == self.most, self.scores[:, -1].astype(float), -np.inf)

    def add(self, group: np.ndarray, score: np.ndarray, row: np.ndarray) -> None:
        if not len(group):
            return
        touched = np.unique(group)
        old = np.arange(self.most) < self.held[touched, None]
        group = np.concatenate([np.repeat(touched, self.held[touched]), group])
        score = np.concatenate([self.scores[touched][old], score])
        row = np.concatenate([self.ids[touched][old], row])
        order = np.lexsort((row, -score, group))
        group, score, row = group[order], score[order], row[order]
        starts = np.searchsorted(group, touched)
        place = np.arange(len(group)) - np.repeat(starts, np.diff(np.append(starts, len(group))))
        keep = place < self.most
        self.ids[group[keep], place[keep]] = row[keep]
        self.scores[group[keep], place[keep]] = score[keep]
        self.held[touched] = np.bincount(group[keep], minlength=len(self.held))[touched]

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(group, id, score) of all that is held."""
        there = np.arange(self.most) < self.held[:, None]
        return np.repeat(np.arange(len(self.held)), self.held), self.ids[there], self.scores[there]


# ------------------------------------------------------------------- cells

class Cell:
    """A slab of rows beside a block of anchors."""

    def __init__(self, rows: pa.Table, anchors: pa.Table, dims: int):
        flat = lambda t, c: t.column(c).combine_chunks()        # noqa: E731
        numbers = lambda t, c: flat(t, c).to_numpy(zero_copy_only=False)
        self.dims = dims
        self.ids, self.labels = numbers(rows, "id"), numbers(rows, "label")
        self.vectors = int_matrix(rows["vector"], dims)
        self.own, self.kind, self.asked = numbers(anchors, "own"), numbers(anchors, "kind"), int_matrix(anchors["asked"], dims)
        levels = len(rows["aligned"][0]) if rows.num_rows else 0
        grid = lambda c: flat(rows, c).flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, levels)
        self.aligned, self.left = grid("aligned"), grid("rest")
        self.codes = np.frombuffer(b"".join(rows["code"].to_pylist()), np.uint64).reshape(rows.num_rows, levels, -1)

    def parts(self) -> Iterator[tuple[slice, Queries]]:
        for start in range(0, len(self.own), PART):
            part = slice(start, min(start + PART, len(self.own)))
            yield part, Queries(rotate(self.asked[part]))

    def scored(self, part: slice, queries: Queries, same: bool, low, high) -> Iterator[tuple]:
        """(anchor in the part, row, score) of the pairs of equal or different labels that may lie from low() to high."""
        step = max(1, PAIRS // max(part.stop - part.start, 1))
        for start in range(0, len(self.ids), step):
            rows = slice(start, start + step)
            fits = self.kind[part, None] == self.labels[None, rows]
            fits = fits & (self.own[part, None] != self.ids[None, rows]) if same else ~fits
            q, x = np.nonzero(fits)
            x += start
            q, x = interval_filter(queries, self.codes, self.aligned, self.left, q, x, low(), high)
            yield q, x, np.einsum("ij,ij->i", self.asked[part][q], self.vectors[x])


def _positives(cell: Cell, most: int) -> pa.Table:
    out = []
    for part, queries in cell.parts():
        best = Best(part.stop - part.start, most)
        top = np.full(part.stop - part.start, np.inf)
        for q, x, score in cell.scored(part, queries, True, best.floor, top):
            best.add(q, score, cell.ids[x])
        group, row, score = best.entries()
        out.append(pa.table({"anchor_id": cell.own[part][group], "positive_id": row, "positive_score": score}))
    return pa.concat_tables(out)


def _negatives(cell: Cell, pos_ids: pa.ListArray, pos_scores: pa.ListArray, most: int, share: tuple[int, int]) -> pa.Table:
    held = np.diff(pos_ids.offsets.to_numpy(zero_copy_only=False))
    many = int(held.max()) if len(held) else 0
    there = np.arange(many) < held[:, None]
    ids, goal = int_matrix(pos_ids, many), int_matrix(pos_scores, many)
    least, whole_share = share
    out = []
    for part, queries in cell.parts():
        n = part.stop - part.start
        best, goals, real = Best(n * many, most), goal[part], there[part]

        def low():
            wanted = np.maximum(goals * (least / whole_share) - 1, best.floor().reshape(n, many))
            return np.where(real, wanted, np.inf).min(axis=1)

        high = np.where(real, goals.astype(float), -np.inf).max(axis=1)
        for q, x, score in cell.scored(part, queries, False, low, high):
            for j in range(many):
                g = goals[q, j]
                inside = real[q, j] & (least * g <= whole_share * score) & (score <= g)
                best.add(q[inside] * many + j, score[inside], cell.ids[x[inside]])
        group, row, score = best.entries()
        q, j = group // max(many, 1), group % max(many, 1)
        out.append(pa.table({"anchor_id": cell.own[part][q], "positive_id": ids[part][q, j],
                             "positive_score": goals[q, j], "negative_id": row, "negative_score": score}))
    return pa.concat_tables(out)


# ------------------------------------------------------------------- Spark

def integer_rows(rows: DataFrame, id_column: str, label: F.Column, vector_column: str, scale: int) -> DataFrame:
    """(id, label, vector) of the rows that take part, one per id."""
    found = rows.select(F.col(id_column).cast("long").alias("id"), label.cast("long").alias("label"),
                        F.col(vector_column).alias("vector"))
    found = found.filter("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL").filter(finite(F.col("vector")))
    one = found.select("id", F.struct("label", whole(F.col("vector"), scale).alias("vector")).alias("r"))
    return one.groupBy("id").agg(F.min("r").alias("r")).select("id", "r.label", "r.vector")


def with_codes(rows: DataFrame, dims: int, levels: int = LEVELS) -> DataFrame:
    """``rows`` with code, aligned and rest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, aligned, left = encode(rotate(int_matrix(b.column("vector"), dims)), levels)
            lists = lambda m: pa.ListArray.from_arrays(
                pa.array(np.arange(0, m.size + 1, levels), pa.int32()), pa.array(m.ravel()))
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([c.tobytes() for c in codes], pa.binary()), lists(aligned), lists(left)],
                [*b.schema.names, "code", "aligned", "rest"])

    return rows.mapInArrow(run, "id long, label long, vector array<int>, code binary, aligned array<double>, "
                                "rest array<double>")


def _first(rows: DataFrame, keys: list[str], score: str, row: str, most: int) -> DataFrame:
    """The ``most`` best rows per key, numbered from 1."""
    order = Window.partitionBy(*keys).orderBy(F.col(score).desc(), row)
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def hard_negatives(rows: DataFrame, anchors: F.Column, *, positives: int = 5, negatives: int = 5,
                   share: tuple[int, int] = (80, 100), levels: int = LEVELS, slab: int = SLAB,
                   block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` as of ``integer_rows``; ``anchors`` is a condition on id and label. A
    negative n of a positive p has ``share[0] * p <= share[1] * n <= share[1] * p``.
    """
    spark = prepare(rows.sparkSession)
    rows = materialize(rows, "rows")
    n, dims, asked = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vector")), F.lit(0)),
                              F.count_if(anchors)).first()
    dims = max(dims, 1)
    slabs = max(1, -(-n // slab), min(spark.sparkContext.defaultParallelism, n // 2048))
    blocks = max(1, -(-asked // block))
    cells = slabs * blocks
    numbers = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    dealt = lambda row, k: F.pmod(F.xxhash64(row), F.lit(k)).cast("int")
    coded = materialize(with_codes(rows, dims, levels), "codes")
    sides = coded.withColumn("slab", dealt("id", slabs)).withColumn("block", numbers(blocks)).repartition(
        cells, "slab", "block")
    queries = coded.filter(anchors).select(F.col("id").alias("own"), F.col("label").alias("kind"),
                                           F.col("vector").alias("asked"))

    def meet(questions: DataFrame, work, schema: str) -> DataFrame:
        right = questions.withColumn("block", dealt("own", blocks)).withColumn("slab", numbers(slabs)).repartition(
            cells, "slab", "block")
        return (sides.groupBy("slab", "block").cogroup(right.groupBy("slab", "block"))
                .applyInArrow(work, schema))

    pairs_schema = "anchor_id long, positive_id long, positive_score long"

    def near(rows_: pa.Table, anchors_: pa.Table) -> pa.Table:
        if not rows_.num_rows or not anchors_.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in ("anchor_id", "positive_id", "positive_score")})
        return _positives(Cell(rows_, anchors_, dims), positives)

    found = _first(meet(queries, near, pairs_schema), ["anchor_id"], "positive_score", "positive_id", positives)
    chosen = materialize(found.groupBy(F.col("anchor_id").alias("own")).agg(     # ``positives`` entries at most
        F.sort_array(F.collect_list(F.struct("rank", "positive_id", "positive_score"))).alias("p")).select(
            "own", F.col("p.positive_id").alias("positive_ids"), F.col("p.positive_score").alias("positive_scores")),
        "positives")
    columns = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]

    def far(rows_: pa.Table, anchors_: pa.Table) -> pa.Table:
        if not rows_.num_rows or not anchors_.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in columns})
        lists = [anchors_.column(c).combine_chunks() for c in ("positive_ids", "positive_scores")]
        return _negatives(Cell(rows_, anchors_, dims), *lists, negatives, share)

    hard = meet(queries.join(chosen, "own"), far, ", ".join(f"{c} long" for c in columns))
    return _first(hard, ["anchor_id", "positive_id", "positive_score"], "negative_score", "negative_id", negatives
                  ).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE = """
WITH kept AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM kept a JOIN kept b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positive AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) AS INTEGER)
         AS rank,
       s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positive p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
QUALIFY rank <= 5"""
