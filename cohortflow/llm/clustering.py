"""Centroid clustering (k-means) whose assignment is Orchard's search.

Every centroid has a list of the others, sorted by their distance from it. A
vector starts at a centroid and walks that centroid's list; when it meets a
centroid closer to itself it jumps to the head of that one's list. Centroids it
has met are marked and not measured again. The walk ends strictly beyond twice
the current distance: from there on the triangle inequality keeps every listed
centroid farther away than the current one, and a centroid at exactly twice the
distance, which could tie, is still looked at. So the answer is exact, ties
included (the smaller number wins).

Spark deals the vectors to tasks; a task walks a batch of vectors in step, as
numpy arrays. Each round, a task sends one row of sums per centroid and Spark
adds them up, so the driver holds ``k`` centroids of ``dims`` components (both
parameters) and nothing that grows with the table. The integer vectors are
written once, so that a lost executor costs a re-read. All arithmetic is in
64-bit integers.

Defined results: a null vector, one of another length than ``dims``, or one with
a null or non-finite component takes no part. Repeated rows count as often as
they come. Equal hashes of the starting order are settled by the vector, a null id
comes last. Fewer vectors than ``k`` give as many centroids; an empty table gives
no rows. Centroids without vectors stay where they are. Columns other than the
named ones are not read, whatever their names. A component beyond 2**22 after
scaling stops the job, as its distances could not be told exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortflow.llm.common import finite, int_matrix, materialize, prepare, whole


def neighbour_lists(centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each centroid, the others in order of (distance, number), and their squared distances."""
    k = len(centres)
    apart = np.stack([((centres - c) ** 2).sum(axis=1) for c in centres])
    numbers = np.arange(k)
    others = np.stack([np.lexsort((numbers, apart[c]))[np.lexsort((numbers, apart[c])) != c] for c in numbers])
    return others, np.take_along_axis(apart, others, axis=1)


def nearest(vectors: np.ndarray, centres: np.ndarray, lists: tuple[np.ndarray, np.ndarray]
            ) -> tuple[np.ndarray, np.ndarray, int]:
    """(number of the nearest centroid, squared distance) of every vector, and how many distances were measured."""
    others, apart = lists
    n, k = len(vectors), len(centres)
    now = np.zeros(n, np.int64)
    reach = ((vectors - centres[0]) ** 2).sum(axis=1)
    at = np.zeros(n, np.int64)
    met = np.zeros((n, k), bool)
    met[:, 0] = True
    walking, measured = np.arange(n if k > 1 else 0), n
    while len(walking):
        going = apart[now[walking], at[walking]] <= 4 * reach[walking]
        walking = walking[going]
        other = others[now[walking], at[walking]]
        at[walking] += 1
        new = ~met[walking, other]
        who, other = walking[new], other[new]
        met[who, other] = True
        far = ((vectors[who] - centres[other]) ** 2).sum(axis=1)
        measured += len(who)
        jump = (far < reach[who]) | (far == reach[who]) & (other < now[who])
        who = who[jump]
        now[who], reach[who], at[who] = other[jump], far[jump], 0
        walking = walking[at[walking] < k - 1]
    return now, reach, measured


def integer_vectors(rows: DataFrame, id_column: str, vector_column: str, dims: int, scale: int) -> DataFrame:
    """(own_id, vector) of the rows that take part, written once."""
    vector = F.col(vector_column)
    kept = rows.select(F.col(id_column).alias("own_id"), vector.alias("vector")).filter(
        (F.size("vector") == dims) & finite(F.col("vector")))
    return materialize(kept.select("own_id", whole(F.col("vector"), scale).alias("vector")), "vectors")


def first_centres(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    """The ``k`` vectors of smallest SHA-256 of ``seed:id``."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("own_id").cast("string")), 256)
    found = vectors.orderBy(key.asc_nulls_last(), "vector").limit(k).select("vector").collect()   # k rows
    return np.array([r.vector for r in found], np.int64)


def _sums(vectors: DataFrame, centres: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Per centroid with vectors: their number and the sums of their components."""
    k, dims = centres.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = neighbour_lists(centres)
        total, count = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            x = int_matrix(batch.column("vector"), dims)
            own, _, _ = nearest(x, centres, lists)
            if len(own):
                order = np.argsort(own, kind="stable")
                some, starts = np.unique(own[order], return_index=True)
                total[some] += np.add.reduceat(x[order], starts, axis=0)
                count += np.bincount(own, minlength=k)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(some, pa.int32()), "n": pa.array(count[some], pa.int64()),
                                          "total": pa.array(total[some].tolist(), pa.list_(pa.int64()))})

    parts = vectors.select("vector").mapInArrow(run, "cluster int, n long, total array<long>")
    sums = (parts.select("cluster", "n", F.posexplode("total").alias("i", "x")).groupBy("cluster", "i")
            .agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect())                   # k x dims rows
    out: dict[int, tuple[int, list[int]]] = {}
    for r in sums:
        out.setdefault(r.cluster, (r.n, [0] * dims))[1][r.i] = r.x
    return out


def _assigned(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    dims = centres.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = neighbour_lists(centres)
        for batch in batches:
            own, reach, _ = nearest(int_matrix(batch.column("vector"), dims), centres, lists)
            yield pa.RecordBatch.from_arrays([batch.column("own_id"), pa.array(own, pa.int32()),
                                              pa.array(reach, pa.int64())], ["own_id", "cluster", "distance"])

    kind = vectors.schema["own_id"].dataType.simpleString()
    return vectors.mapInArrow(run, f"own_id {kind}, cluster int, distance long")


def cluster(rows: DataFrame, id_column: str, vector_column: str, *, dims: int, scale: int, k: int, rounds: int,
            seed: str = "1") -> tuple[DataFrame, np.ndarray]:
    """(own_id, cluster, distance) of every vector that takes part after ``rounds`` rounds, and the centroids."""
    prepare(rows.sparkSession)
    vectors = integer_vectors(rows, id_column, vector_column, dims, scale)
    centres = first_centres(vectors, k, seed)
    if not len(centres):
        return vectors.select("own_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centres
    for _ in range(rounds):
        for c, (n, total) in _sums(vectors, centres).items():
            centres[c] = [x // n for x in total]
    return materialize(_assigned(vectors, centres), "clusters"), centres


def digest(found: DataFrame, centres: np.ndarray) -> DataFrame:
    """``found`` with each cluster's and the whole inertia and the hash of the cluster's centroid."""
    spark = found.sparkSession
    inertia = {r.cluster: r.x for r in found.groupBy("cluster").agg(F.sum("distance").alias("x")).collect()}   # k rows
    whole_sum = sum(inertia.values())
    names = [(c, inertia.get(c, 0), whole_sum, hashlib.sha256(",".join(map(str, x)).encode()).hexdigest())
             for c, x in enumerate(centres.tolist())]
    table = spark.createDataFrame(names, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(table), "cluster")


def _oracle(dims: int = 64, scale: int = 64, k: int = 16, rounds: int = 3) -> str:
    """The same by brute force: every vector against every centroid, round after round."""
    parts = [f"""
  kept AS (SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = {dims}
           AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  v AS (SELECT vec_id, unnest(range({dims})) AS i,
               unnest(list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT))) AS x
        FROM kept),
  named AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c FROM kept),
  c0 AS (SELECT c, i, x FROM named JOIN v USING (vec_id) WHERE c < {k})"""]
    for r in range(rounds + 1):
        parts.append(f"""
  d{r} AS (SELECT vec_id, c, sum((v.x - t.x) * (v.x - t.x)) AS d FROM v JOIN c{r} t USING (i) GROUP BY vec_id, c),
  a{r} AS (SELECT vec_id, c, d FROM d{r}
           QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1)""")
        if r < rounds:
            parts.append(f"""
  s{r} AS (SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM a{r} JOIN v USING (vec_id) GROUP BY c, i),
  c{r + 1} AS (SELECT c, i, coalesce((s - ((s % n) + n) % n) // n, x) AS x FROM c{r} LEFT JOIN s{r} USING (c, i))""")
    return "WITH" + ",".join(parts) + f""",
  h AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance,
       CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
       centroid_sha256
FROM a{rounds} JOIN h USING (c)"""


ORACLE = _oracle()
