"""Centroid clustering, exact dedup and hard negatives against brute force, with odd rows."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortflow.llm import clustering, exact_dedup, hard_negatives

NAN, INF = float("nan"), float("inf")


def vectors(n, dims, seed=3):
    rng = np.random.default_rng(seed)
    return (np.round(rng.normal(size=(n, dims)) * 64) / 64).astype(np.float32)


# ------------------------------------------------------------- clustering

def brute_nearest(x, centres):
    d = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2)
    return d.argmin(axis=1), d.min(axis=1)          # argmin takes the first, that is the smaller number


@pytest.mark.parametrize("spread", [2, 40])
def test_orchard_search_is_exact_with_ties(spread):
    rng = np.random.default_rng(spread)
    centres = rng.integers(-spread, spread + 1, (40, 3))     # small spreads make equal centroids and equal distances
    x = rng.integers(-spread, spread + 1, (3000, 3))
    own, reach, measured = clustering.nearest(x, centres, clustering.neighbour_lists(centres))
    want, far = brute_nearest(x, centres)
    assert (own == want).all() and (reach == far).all()
    assert measured < x.shape[0] * centres.shape[0]


def test_orchard_search_skips_far_centroids():
    centres = np.array([[1000 * i, 0] for i in range(50)])
    x = np.array([[1000 * i + 3, 1] for i in range(50)])
    own, _, measured = clustering.nearest(x, centres, clustering.neighbour_lists(centres))
    assert own.tolist() == list(range(50)) and measured < 50 * 50


def brute_kmeans(rows, dims, scale, k, rounds):
    kept = [(i, [int(np.floor(scale * float(c))) for c in v]) for i, v in rows
            if v is not None and len(v) == dims and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([v for _, v in kept])
    key = [(i is None, hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept]
    centres = np.array([v for _, _, v in sorted(key)[:k]])
    for _ in range(rounds):
        own, _ = brute_nearest(x, centres)
        for c in range(len(centres)):
            if (own == c).any():
                centres[c] = [int(s) // int((own == c).sum()) for s in x[own == c].sum(axis=0)]
    own, reach = brute_nearest(x, centres)
    return sorted(((i, int(c), int(d)) for (i, _), c, d in zip(kept, own, reach)), key=repr), centres


def test_clusters_equal_brute_force_with_odd_rows(spark):
    v = vectors(300, 4).tolist()
    rows = [(i, x) for i, x in enumerate(v)]
    rows += [(5, v[5]), (5, v[5]), (None, v[7]), (900, None), (901, []), (902, v[0][:3]), (903, [*v[0], 1.0]),
             (904, [NAN, 0.0, 0.0, 0.0]), (905, [INF, 0.0, 0.0, 0.0]), (906, [None, 0.0, 0.0, 0.0]), (907, v[0])]
    table = spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows],
                                  "vec_id long, embedding array<float>, cluster int, own_id string, vector double")
    found, centres = clustering.cluster(table.repartition(3), "vec_id", "embedding", dims=4, scale=64, k=7, rounds=3)
    want, c = brute_kmeans(rows, 4, 64, 7, 3)
    got = clustering.digest(found, centres).collect()
    assert (centres == c).all()
    assert sorted(((r.own_id, r.cluster, r.distance) for r in got), key=repr) == want
    assert {r.inertia for r in got} == {sum(d for _, _, d in want)}
    for r in got:
        assert r.cluster_inertia == sum(d for _, k, d in want if k == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centres[r.cluster])).encode()).hexdigest()


def test_clusters_of_few_and_no_rows(spark):
    few = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    found, centres = clustering.cluster(few, "vec_id", "embedding", dims=2, scale=64, k=16, rounds=2)
    assert len(centres) == 2 and {(r.cluster, r.distance) for r in found.collect()} == {(0, 0)}
    found, centres = clustering.cluster(few.limit(0), "vec_id", "embedding", dims=2, scale=64, k=16, rounds=2)
    assert clustering.digest(found, centres).collect() == []


def test_a_component_beyond_exact_arithmetic_stops_the_job(spark):
    far = spark.createDataFrame([(1, [1e30, 2.0])], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="too large"):
        clustering.cluster(far, "vec_id", "embedding", dims=2, scale=64, k=2, rounds=1)


# ------------------------------------------------------------ exact dedup

LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))
TEXTS = ["", None, " ", "a", "a ", "A", "é", "é", LONG, LONG + ".", LONG, "b" * 4096, "b" * 4097, "b" * 8192, "b" * 12288,
         "x" + "b" * 4095, "a", "tail" * 5000, "tail" * 5000, "\x00", "nul\x00l"]


def by_text(rows):
    out = {}
    for i, t in rows:
        out.setdefault(t or "", []).append(i)
    return out


@pytest.mark.parametrize("options", [{}, {"block_bytes": 7, "hash_bits": 64}, {"block_bytes": 64, "hash_bits": 3},
                                     {"block_bytes": 4096, "hash_bits": 1}])
def test_exact_dedup_equals_grouping_by_text(spark, options):
    texts = [t[:3000] if t and "block_bytes" in options and options["block_bytes"] < 100 else t for t in TEXTS]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "a"), (16, "a"), (None, "a"), (None, "only without id"),
                                                    (20, "same id, other text")]
    table = spark.createDataFrame([(i, t, "e", 1, 2, "h") for i, t in rows],
                                  "doc_id long, text string, identity string, own_row int, n int, hash string")
    got = exact_dedup.groups(table.repartition(5), **options).collect()
    groups = by_text(rows)
    assert len(got) == len(rows)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()     # noqa: E731
    want = sorted(((i, max((m for m in ids if m is not None), default=None), len(ids), sha(t))
                   for t, ids in groups.items() for i in ids), key=repr)
    assert sorted(((r.own_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == want
    assert len({r.identity for r in got}) == len(groups)
    for t in groups:
        kept = [r.own_id for r in got if r.kept and r.text_sha256 == sha(t)]
        assert kept == [max((m for m in groups[t] if m is not None), default=None)]


def test_names_are_dense_and_ordered(spark):
    rows = spark.range(5000).select(F.col("id").alias("a"), (F.col("id") * 3).alias("b"))
    got = exact_dedup.numbered(rows, F.xxhash64("a", "b"), ["a", "b"], "test").select(
        "name", F.xxhash64("a", "b").alias("h")).orderBy("name").collect()
    assert [r.name for r in got] == list(range(5000))
    assert [r.h for r in got] == sorted(r.h for r in got)


def test_exact_dedup_of_an_empty_table(spark):
    assert exact_dedup.groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []


# --------------------------------------------------------- hard negatives

def brute_negatives(rows, scale, anchor, positives=5, negatives=5, share=(80, 100)):
    kept = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(c is None or not np.isfinite(c) for c in v):
            continue
        x = (label, [int(np.floor(scale * float(c))) for c in v])
        kept[i] = min(kept.get(i, x), x)
    dot = lambda a, b: sum(p * q for p, q in zip(a, b))     # noqa: E731
    out = []
    for a, (label, v) in kept.items():
        if not anchor(a):
            continue
        score = {i: dot(v, x) for i, (_, x) in kept.items()}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if i != a and kept[i][0] == label][:positives]:
            fits = [i for i in order if kept[i][0] != label
                    and share[0] * score[p] <= share[1] * score[i] <= share[1] * score[p]]
            out += [(a, p, r, i, score[p], score[i]) for r, i in enumerate(fits[:negatives], 1)]
    return sorted(out)


def odd_rows():
    v = vectors(400, 6, 5)
    v[100:140] = v[100]                     # a group of copies, with ties at every score
    rows = [(i, int(i % 4) if i < 390 else 9, x) for i, x in enumerate(v.tolist())]
    good = rows[3][2]
    return rows + [rows[8], rows[8], (8, 3, good), (None, 1, good), (500, None, good), (505, 1, None), (510, 1, [NAN] * 6),
                   (515, 1, [None] * 6), (520, 1, [INF] * 6), (525, 1, []), (530, 2, good[:2]), (-5, 1, good), (605, 77, good)]


@pytest.mark.parametrize("options", [{}, {"slab": 90, "block": 11}, {"levels": 1}, {"levels": 7, "slab": 50}])
def test_hard_negatives_equal_brute_force(spark, options):
    data = odd_rows()
    table = spark.createDataFrame([(*r, 1.0, "x", 7) for r in data],
                                  "vec_id long, label int, embedding array<float>, id double, slab string, own long")
    rows = hard_negatives.integer_rows(table.repartition(3), "vec_id", F.col("label"), "embedding", 256)
    got = hard_negatives.hard_negatives(rows, F.col("id") % 5 == 0, **options)
    assert sorted(tuple(r) for r in got.collect()) == brute_negatives(data, 256, lambda i: i % 5 == 0)


def test_hard_negatives_of_an_empty_table(spark):
    none = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    rows = hard_negatives.integer_rows(none, "vec_id", F.col("label"), "embedding", 256)
    assert hard_negatives.hard_negatives(rows, F.col("id") % 5 == 0).collect() == []


@pytest.mark.parametrize("dims", [3, 64, 100])
def test_intervals_hold_the_true_product_and_narrow(dims):
    rng = np.random.default_rng(dims)
    x = rng.integers(-300, 300, (400, dims))
    asked = np.vstack([rng.integers(-300, 300, (18, dims)), x[:1], np.zeros((1, dims), int)])
    assert np.allclose((hard_negatives.rotate(x) ** 2).sum(axis=1), (x ** 2).sum(axis=1))
    codes, aligned, left = hard_negatives.encode(hard_negatives.rotate(x), 4)
    queries = hard_negatives.Queries(hard_negatives.rotate(asked))
    q, r = (i.ravel() for i in np.meshgrid(np.arange(20), np.arange(400), indexing="ij"))
    true = (asked[q] * x[r]).sum(axis=1).astype(float)
    # a pair whose product is just inside the wanted range is never dropped
    for low, high in ((true, np.full(len(q), np.inf)), (np.full(len(q), -np.inf), true)):
        for level in range(1, 5):
            kept = sum(len(hard_negatives.interval_filter(queries, codes[:, :level], aligned[:, :level], left[:, :level],
                                                          q[i:i + 1], r[i:i + 1], _at(low[i], 20),
                                                          _at(high[i], 20))[0]) for i in range(0, len(q), 97))
            assert kept == len(range(0, len(q), 97))
    # and of the pairs far below, more go with every level
    bound = np.full(20, np.sort(true)[-40])
    seen = [len(hard_negatives.interval_filter(queries, codes[:, :n], aligned[:, :n], left[:, :n], q, r, bound,
                                               np.full(20, np.inf))[0]) for n in (1, 2, 4)]
    assert seen[0] >= seen[1] >= seen[2] and seen[2] < len(q) / 2


def _at(value, n):
    return np.full(n, value)
