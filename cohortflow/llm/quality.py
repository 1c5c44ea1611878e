"""Quality rules: gradient-boosted trees over document statistics.

Statistics are counted over every whole text inside ``mapInArrow``. The model
is trained here, on at most ``max_rows`` labelled documents (those with the
smallest hash of their doc_id), with logistic loss and depth-limited trees;
features listed in ``FALLING`` may only lower the score as they grow: a split
on one must order its leaf values, and the midpoint bounds everything below.
The trees are flattened into numpy node arrays, and a batch of documents is
scored by walking all rows down one level at a time.

A document is kept when the base rule accepts it and its score is 0.5 or more.

Defined results: a null or empty text has no words, so it fails the base
rule; repeated rows get equal verdicts; without usable labels (none, or all of one
class) the model is the constant class share, or 1 without any label; extra
columns pass through untouched; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortflow.llm.common import prepare, sample_labels, sample_texts, text_slices

FEATURES = ("log_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "distinct_share",
            "upper_share", "digit_share", "odd_word_share", "words_per_line", "stop_share")
#: The score never rises with these.
FALLING = ("symbol_share", "dup_line_share", "repeat_share", "upper_share", "odd_word_share")
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCHEMA = [*[(c, pa.int64()) for c in COUNTS], *[(f, pa.float64()) for f in FEATURES]]


def statistics(text: str | None) -> tuple:
    """``COUNTS`` then ``FEATURES`` of one text."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    if n == 0:
        symbols = len(raw) - len(raw.translate(None, SYMBOLS))
        return (0, 0, symbols, 0, 0, *[0.0] * len(FEATURES))
    in_words = sum(map(len, words))
    chars = len(text) - (len(raw) - in_words)
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dup_lines = len(lines) - len(set(lines))
    repeat = 0
    if n >= 3:
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) < len(windows):
            seen, covered = Counter(windows), 0
            for i, w in enumerate(windows):
                if seen[w] > 1:
                    repeat += i + 3 - max(covered, i)
                    covered = i + 3
    counts = Counter(words)
    odd = sum(c for w, c in counts.items() if not w[-1:].isalnum() and w[-1] < 128 and w[-1:] not in b".,;:?!")
    top = sum(c for _, c in counts.most_common(10))
    return (n, chars, symbols, dup_lines, repeat, float(np.log1p(n)), chars / n, symbols / chars,
            dup_lines / len(lines), repeat / n, len(counts) / n,
            (len(raw) - len(raw.translate(None, UPPER))) / len(raw),
            (len(raw) - len(raw.translate(None, DIGITS))) / len(raw), odd / n, n / len(lines), top / n)


def base_failed(n_words, n_repeat_words):
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


# ---------------------------------------------------------------------- trees

@dataclass
class Trees:
    """All trees in flat node arrays; a leaf points to itself."""
    start: float
    roots: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        row = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[row, self.feature[node]] <= self.cut[node], self.left[node], self.right[node])
            total += self.value[node]
        return 1 / (1 + np.exp(-np.clip(total, -50, 50)))


def train(x: np.ndarray, y: np.ndarray, falling: tuple[int, ...] = (), rounds: int = 80, depth: int = 3,
          rate: float = 0.2, bins: int = 64, least: float = 2.0, ridge: float = 1.0) -> Trees:
    """Histogram gradient boosting with logistic loss and falling features."""
    share = y.mean() if len(y) else 1.0
    nothing = np.zeros(0)
    if not len(y) or share in (0.0, 1.0):
        start = 50.0 if share == 1.0 else -50.0
        return Trees(start, nothing.astype(int), nothing.astype(int), nothing, nothing.astype(int),
                     nothing.astype(int), nothing, 0)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    cells = np.stack([np.searchsorted(k, c, side="left") for k, c in zip(cuts, x.T)], axis=1)
    start = float(np.log(share / (1 - share)))
    total = np.full(len(y), start)
    feature, cut, left, right, value, roots = [], [], [], [], [], []

    def leaf(v: float) -> int:
        feature.append(0), cut.append(0.0), left.append(len(value)), right.append(len(value)), value.append(v)
        return len(value) - 1

    def grow(rows: np.ndarray, level: int, low: float, high: float) -> int:
        g, h = grad[rows].sum(), hess[rows].sum()
        node = leaf(float(np.clip(-g / (h + ridge), low, high)) * rate)
        if level == depth:
            total[rows] += value[node]
            return node
        best = (1e-6, None)
        for f, ks in enumerate(cuts):
            if not len(ks):
                continue
            gl = np.cumsum(np.bincount(cells[rows, f], grad[rows], len(ks) + 1))[:-1]
            hl = np.cumsum(np.bincount(cells[rows, f], hess[rows], len(ks) + 1))[:-1]
            vl = np.clip(-gl / (hl + ridge), low, high)
            vr = np.clip(-(g - gl) / (h - hl + ridge), low, high)
            gain = gl ** 2 / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g ** 2 / (h + ridge)
            ok = (hl >= least / 4) & (h - hl >= least / 4)
            if f in falling:
                ok &= vl >= vr
            gain = np.where(ok, gain, -1.0)
            i = int(np.argmax(gain))
            if gain[i] > best[0]:
                best = (float(gain[i]), f, i, float(vl[i]), float(vr[i]))
        if best[1] is None:
            total[rows] += value[node]
            return node
        _, f, i, vl, vr = best
        goes = cells[rows, f] <= i
        middle = (vl + vr) / 2
        bounds = ((middle, high), (low, middle)) if f in falling else ((low, high), (low, high))
        a = grow(rows[goes], level + 1, *bounds[0])
        b = grow(rows[~goes], level + 1, *bounds[1])
        feature[node], cut[node], left[node], right[node] = f, float(cuts[f][i]), a, b
        return node

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-total))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-9)
        roots.append(grow(np.arange(len(y)), 0, -np.inf, np.inf))
    return Trees(start, np.array(roots), np.array(feature), np.array(cut), np.array(left), np.array(right),
                 np.array(value), depth)


def labelled_sample(labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """At most ``max_rows`` labelled ids: those with the smallest hash (a documented bound)."""
    known = labels.filter(f"doc_id is not null and {label} is not null").select(
        F.col("doc_id").cast("long").alias("own_id"), F.col(label).cast("int").alias("label"))
    return sample_labels(known, max_rows)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 8_000) -> Trees:
    """Train on a bounded sample of labelled documents."""
    prepare(docs.sparkSession)
    sample = labelled_sample(labels, "quality", max_rows)
    rows = sample_texts(docs.select(F.col("doc_id").cast("long").alias("own_id"), "text"), sample, max_rows,
                        "quality-sample")
    schema = pa.schema([("label", pa.int32()), *SCHEMA[len(COUNTS):]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(t.as_py())[len(COUNTS):] for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), *[pa.array(c, pa.float64()) for c in (zip(*found) if found else
                                                                              [[]] * len(FEATURES))]], schema=schema)

    known = rows.select("label", "text").mapInArrow(run, "label int, " + ", ".join(f"{f} double" for f in FEATURES))
    held = known.toPandas().sort_values(["label", *FEATURES])      # at most max_rows rows
    x = held[list(FEATURES)].to_numpy(dtype=float).reshape(-1, len(FEATURES))
    return train(x, held["label"].to_numpy(dtype=float), tuple(FEATURES.index(f) for f in FALLING))


def verdicts(docs: DataFrame, trees: Trees) -> DataFrame:
    """One row per document: doc_id, counts, score, base_failed, kept, and the document's text key."""
    prepare(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), *SCHEMA[:len(COUNTS)],
                        ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text", 1 << 23):
                found = [statistics(t.as_py()) for t in part.column("text")]
                x = np.array([f[len(COUNTS):] for f in found])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_key"),
                     *[pa.array(c, pa.int64()) for c in list(zip(*found))[:len(COUNTS)]],
                     pa.array(trees.score(x))], schema=schema)

    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    kinds = "doc_id long, text_key long, " + ", ".join(f"{c} long" for c in COUNTS) + ", score double"
    return (cols.mapInArrow(run, kinds)
            .withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words")))
            .withColumn("kept", ~F.col("base_failed") & (F.col("score") >= 0.5)))


def keep_good(docs: DataFrame, labels: DataFrame, max_rows: int = 8_000) -> DataFrame:
    """``docs`` with the rows whose verdict is kept, all columns unchanged; no shuffle."""
    trees = fit(docs, labels, max_rows)

    def judge(text: pa.Array) -> pa.Array:
        if not len(text):
            return pa.array([], pa.bool_())
        found = [statistics(t.as_py()) for t in text]
        good = trees.score(np.array([f[len(COUNTS):] for f in found])) >= 0.5
        return pa.array([bool(g) and not base_failed(f[0], f[4]) for f, g in zip(found, good)])

    return docs.filter(F.arrow_udf(judge, "boolean")(F.col("text")))
