"""Toxic spans and scores from a linear-chain conditional random field.

Training uses at most ``max_rows`` labelled documents outside the held-out
fifth (those with the smallest hash of their doc_id) of at most ``max_bytes``
of text each. The field is fitted on whole documents in at most ``max_chains``
chains, toxic ones first up to half of them, both kinds in a seeded random order. Their tokens get labels
from the document labels: a small set of indicators (whole words and word
beginnings) that explains the toxic documents and is rare in clean ones is
chosen greedily, and a token of a toxic document is toxic if one applies. The field has two states, hashed features of the word (itself, its
beginnings and endings) and learned transitions, and is fitted by Adam on the
exact gradient, forward-backward marginals minus labels.

Every document's tokens are then tagged as one sequence. It is laid out in
chains of ``CHAIN`` tokens which are advanced together, one position at a time;
each chain's product of transitions carries the messages from chain to chain, so
the marginals are those of the whole text. The document
score is a logistic function, fitted on the training documents, of its two
largest token marginals in log odds, so long texts gain little by length.
Offending offsets are the runs of tokens with a marginal of one half or more.

Labels, language, source and doc_id are never inputs of a score.

Defined results: a null or empty text, or one without letters, has no token
and scores as the cleanest document does; repeated rows score alike; without
any labelled document, or with labels of one class only, the score is that
class's share (0 without labels); a null doc_id counts as the empty text in
the split; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortflow.llm.common import prepare, sample_labels, sample_texts, text_slices

WORD = re.compile(r"[^\W\d_]+")
BITS = 18
CHAIN = 64
MAX_ROWS = 4_000
MAX_BYTES = 1 << 16         # of one training text
MAX_CHAINS = 8_000          # training chains at most
CACHE = 500_000             # word scores kept per worker
FLOOR = -12.0               # log odds of a document without tokens


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 5 == 0


def word_features(word: str) -> list[int]:
    w = word.lower()
    names = [f"={w}"] + [f"^{w[:k]}" for k in range(2, min(7, len(w)) + 1)]
    names += [f"${w[-k:]}" for k in range(3, min(5, len(w)) + 1)]
    mask = (1 << BITS) - 1
    return [zlib.crc32(n.encode()) & mask for n in names]


@dataclass
class Field:
    """Feature weights, transitions (01, 10, 11; 00 is 0) and the line of the score."""
    weights: np.ndarray
    bias: float
    moves: np.ndarray
    line: np.ndarray | None = None          # of the score: two largest marginals, constant
    share: float | None = None              # constant score, when nothing can be learned

    def scores(self, tops: list[tuple[float, float]]) -> np.ndarray:
        return _logistic(np.column_stack([np.array(tops).reshape(-1, 2), np.ones(len(tops))]) @ self.line)

    def word(self, word: str) -> float:
        return float(self.weights[word_features(word)].sum() + self.bias)


# --------------------------------------------------------- forward, backward

def chains_of(sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(position in the padded chain table, number of chains per document) for documents of these sizes."""
    sizes = np.asarray(sizes, dtype=np.int64)
    rows = -(-sizes // CHAIN)
    begin = (np.cumsum(rows) - rows) * CHAIN
    place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(begin, sizes)
    return place, rows


def _lae(a, b):
    return np.logaddexp(a, b)


def marginals(s: np.ndarray, real: np.ndarray, moves: np.ndarray, before: np.ndarray | None = None,
              after: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log odds of state 1 for each position of each chain, and the two messages.

    ``s``: chains x positions of unary log odds; ``real``: the same shape, false on padding.
    ``before``: message into the chain (nan where a text starts); ``after``: message into its end.
    """
    t01, t10, t11 = moves
    ahead, back = np.empty_like(s), np.zeros_like(s)
    ahead[:, 0] = s[:, 0]
    if before is not None:
        r = np.nan_to_num(before)
        ahead[:, 0] += np.where(np.isnan(before), 0.0, _lae(t01, r + t11) - _lae(0.0, r + t10))
        back[:, -1] = after
    for i in range(1, s.shape[1]):
        r = ahead[:, i - 1]
        ahead[:, i] = s[:, i] + _lae(t01, r + t11) - _lae(0.0, r + t10)
    for i in range(s.shape[1] - 2, -1, -1):
        z = s[:, i + 1] + back[:, i + 1]
        back[:, i] = np.where(real[:, i + 1], _lae(t10, t11 + z) - _lae(0.0, t01 + z), 0.0)
    return ahead + back, ahead, back


def _products(s: np.ndarray, real: np.ndarray, starts: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, ...]:
    """Logs of each chain's 2x2 product (11, 10, 01, 00: to, from), up to a factor; a text's start has no transition."""
    t01, t10, t11 = moves
    one = [np.zeros(len(s)), np.full(len(s), -np.inf)]          # to state 1, from 1 and 0
    none = [np.full(len(s), -np.inf), np.zeros(len(s))]
    for i in range(s.shape[1]):
        free = starts if i == 0 else np.zeros(len(s), dtype=bool)
        up = [s[:, i] + np.where(free, a, _lae(t11 + a, t01 + b)) for a, b in zip(one, none)]
        down = [np.where(free, b, _lae(t10 + a, b)) for a, b in zip(one, none)]
        top = np.maximum.reduce(up + down)
        one = [np.where(real[:, i], new - top, old) for new, old in zip(up, one)]
        none = [np.where(real[:, i], new - top, old) for new, old in zip(down, none)]
    return *one, *none


def text_marginals(unary: np.ndarray, sizes: list[int], moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``marginals`` of whole texts, laid end to end: messages are carried from chain to chain of a text."""
    place, rows = chains_of(sizes)
    if not len(place):
        return unary, unary, unary
    s, real = np.zeros(rows.sum() * CHAIN), np.zeros(rows.sum() * CHAIN, dtype=bool)
    s[place], real[place] = unary, True
    s, real = s.reshape(-1, CHAIN), real.reshape(-1, CHAIN)
    before, after = np.full(len(s), np.nan), np.zeros(len(s))
    begin = np.cumsum(rows) - rows
    first, held = begin[rows > 1], rows[rows > 1]
    if len(held):
        order = np.argsort(-held, kind="stable")                # texts of more chains first
        first, held = first[order], held[order]
        many = np.repeat(rows > 1, rows)
        starts = np.zeros(len(s), dtype=bool)
        starts[first] = True
        p11, p10, p01, p00 = (np.zeros(len(s)) for _ in range(4))
        p11[many], p10[many], p01[many], p00[many] = _products(s[many], real[many], starts[many], moves)
        more = np.searchsorted(-held, -np.arange(1, held[0]), side="left")     # texts of more than k chains
        for k, n in enumerate(more.tolist()):
            at = first[:n] + k
            r = before[at] if k else np.zeros(n)
            before[at + 1] = _lae(p11[at] + r, p10[at]) - _lae(p01[at] + r, p00[at])
            at = first[:n] + held[:n] - 1 - k
            b = after[at]
            after[at - 1] = _lae(p11[at] + b, p01[at]) - _lae(p10[at] + b, p00[at])
    return tuple(x.ravel()[place] for x in marginals(s, real, moves, before, after))


def _logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


# ------------------------------------------------------------------- training

def _names(word: str) -> list[str]:
    return [f"={word}"] + [f"^{word[:k]}" for k in range(3, min(7, len(word)) + 1)]


def indicators(words: list[str], doc: np.ndarray, word: np.ndarray, toxic: np.ndarray, precision: float = 0.7,
               least: int = 3, cost: float = 2.0, rare: float = 0.02, most: int = 500) -> list[str]:
    """Names (``=word`` or ``^beginning``) that explain the toxic documents, chosen greedily.

    ``doc``, ``word``: distinct (document, word number) pairs. The next name
    is the one with the largest gain, toxic documents newly explained less
    ``cost`` times the clean ones newly hit; a name that explains fewer than
    ``least`` more must at least occur in the share ``rare`` of all toxic
    documents.
    """
    number: dict[str, int] = {}
    lists = [[number.setdefault(n, len(number)) for n in _names(w)] for w in words]
    size = np.array([len(x) for x in lists], dtype=np.int64)
    first = np.cumsum(size) - size
    flat = np.array([n for x in lists for n in x], dtype=np.int64)
    use = np.repeat(first[word], size[word]) + np.arange(size[word].sum()) - np.repeat(
        np.cumsum(size[word]) - size[word], size[word])
    pair = np.unique(flat[use] * len(toxic) + np.repeat(doc, size[word]))
    name, at = pair // len(toxic), pair % len(toxic)
    bad = np.bincount(name[toxic[at] == 1], minlength=len(number))
    every = np.bincount(name, minlength=len(number))
    sharp = np.flatnonzero((bad >= least) & (bad >= precision * every))
    shown = list(number)
    ends = np.searchsorted(name, np.arange(len(number) + 1))
    hits = {int(n): at[ends[n]:ends[n + 1]] for n in sharp}
    seen, chosen, enough = np.zeros(len(toxic), dtype=bool), [], max(least, rare * toxic.sum())
    # gains only fall as documents get explained, so a stale gain bounds the fresh one
    heap = [(-float(bad[n]), -int(bad[n]), -len(shown[n]), shown[n], n) for n in hits]
    heapq.heapify(heap)
    while heap and len(chosen) < most:
        _, _, _, _, n = heapq.heappop(heap)
        new = hits[n][~seen[hits[n]]]
        fresh = int(toxic[new].sum())
        gain = fresh - cost * (len(new) - fresh)
        if gain <= 0 or (fresh < least and bad[n] < enough):
            continue
        entry = (-gain, -int(bad[n]), -len(shown[n]), shown[n], n)
        if heap and entry > heap[0]:
            heapq.heappush(heap, entry)
            continue
        chosen.append(shown[n])
        seen[new] = True
    return chosen


def train(texts: list[str], toxic: np.ndarray, rounds: int = 40, rate: float = 0.4, decay: float = 1e-4,
          max_chains: int = MAX_CHAINS) -> Field:
    """Field from labelled documents; equal texts count once."""
    first = {}
    for t, y in zip(texts, toxic):
        first.setdefault(t, int(y))
    texts, toxic = list(first), np.array(list(first.values()), dtype=int)
    blank = Field(np.zeros(1 << BITS), 0.0, np.zeros(3))
    if not len(toxic) or toxic.min() == toxic.max():
        blank.share = float(toxic.mean()) if len(toxic) else 0.0
        return blank
    number: dict[str, int] = {}
    docs = [np.array([number.setdefault(w, len(number)) for w in map(str.lower, WORD.findall(t))], dtype=np.int64)
            for t in texts]
    words = list(number)
    held = [np.unique(d) for d in docs]
    pick = set(indicators(words, np.repeat(np.arange(len(docs)), [len(h) for h in held]),
                          np.concatenate(held), toxic))
    marked = np.array([not pick.isdisjoint(_names(w)) for w in words], dtype=bool)
    labels = [marked[d] & bool(y) for d, y in zip(docs, toxic)]

    # whole documents with toxic tokens and without, in random order, up to half of the chains each
    chains = np.array([-(-len(d) // CHAIN) for d in docs])
    has = np.array([x.any() for x in labels])
    rng = np.random.default_rng(7)
    clean, marked_docs = rng.permutation(np.flatnonzero(~has)), rng.permutation(np.flatnonzero(has))
    use = np.sort(np.concatenate([x[np.cumsum(chains[x]) <= max_chains // 2] for x in (marked_docs, clean)]))
    sizes = [len(docs[i]) for i in use]
    flat = np.concatenate([docs[i] for i in use])
    label = np.concatenate([labels[i] for i in use]).astype(float)
    inside = np.diff(np.repeat(np.arange(len(use)), sizes)) == 0       # neighbours of one text
    used, local = np.unique(flat, return_inverse=True)
    lists = [word_features(words[i]) for i in used]
    feature = np.concatenate([np.array(x) for x in lists]) if lists else np.zeros(0, dtype=int)
    owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    theta = np.zeros((1 << BITS) + 4)
    theta[1 << BITS] = -4.0
    one, two = np.zeros_like(theta), np.zeros_like(theta)
    n = max(1.0, label.sum())
    for step in range(1, rounds + 1):
        weights, bias, moves = theta[:1 << BITS], theta[1 << BITS], theta[(1 << BITS) + 1:]
        unary = np.bincount(owner, weights[feature], len(lists)) + bias
        s = unary[local]
        logit, ahead, back = text_marginals(s, sizes, moves)
        wrong = _logistic(logit) - label
        grad = np.zeros_like(theta)
        per_word = np.bincount(local, wrong, len(lists))
        grad[:1 << BITS] = np.bincount(feature, per_word[owner], 1 << BITS)
        grad[1 << BITS] = wrong.sum()
        z = s[1:] + back[1:]
        t01, t10, t11 = moves
        logs = np.stack([np.zeros_like(z), t01 + z, ahead[:-1] + t10, ahead[:-1] + t11 + z])
        part = np.exp(logs - logs.max(axis=0))
        part /= part.sum(axis=0)
        a, b = label[:-1], label[1:]
        seen = ((1 - a) * b, a * (1 - b), a * b)
        grad[(1 << BITS) + 1:] = [np.where(inside, part[i + 1] - seen[i], 0).sum() for i in range(3)]
        grad = grad / n + decay * theta
        one = 0.9 * one + 0.1 * grad
        two = 0.99 * two + 0.01 * grad ** 2
        theta -= rate * (one / (1 - 0.9 ** step)) / (np.sqrt(two / (1 - 0.99 ** step)) + 1e-8)
    field = Field(theta[:1 << BITS].copy(), float(theta[1 << BITS]), theta[(1 << BITS) + 1:].copy())
    top = np.array([m for m, _ in scan(texts, Scores(field))])
    field.line = _line(top, toxic.astype(float))
    return field


def _line(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 0.05) -> np.ndarray:
    """Logistic weights of the columns of ``x`` (none below 0) and of the constant."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.append(np.full(x.shape[1], 0.3), 0.0)
    for _ in range(rounds):
        p = _logistic(a @ w)
        slope = a.T @ (p - y) + ridge * w
        curve = (a * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ a + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w -= step / max(1.0, np.abs(step).max())
        w[:-1] = np.maximum(w[:-1], 0.0)
    return w


# -------------------------------------------------------------------- scoring

class Scores(dict):
    """Word -> unary log odds, computed once per worker while the cache holds it."""

    def __init__(self, field: Field):
        super().__init__()
        self.field = field

    def __missing__(self, word: str) -> float:
        if len(self) >= CACHE:
            self.clear()
        out = self[word] = self.field.word(word)
        return out


def scan(texts: list[str], scores: Scores, spans: bool = False) -> list[tuple]:
    """Per text: its two largest marginals in log odds (``FLOOR`` for missing ones) and offending character spans."""
    get, unary, sizes = scores.__getitem__, [], []
    for t in texts:
        words = WORD.findall(t)
        sizes.append(len(words))
        unary.append(np.fromiter(map(get, words), dtype=float, count=len(words)))
    logit = text_marginals(np.concatenate(unary) if unary else np.zeros(0), sizes, scores.field.moves)[0]
    out, at = [], 0
    for t, n in zip(texts, sizes):
        own = logit[at:at + n]
        at += n
        two = np.sort(np.partition(own, n - 2)[n - 2:])[::-1] if n > 1 else own
        top, second = (float(max(x, FLOOR)) for x in [*two, FLOOR, FLOOR][:2])
        found: list[tuple[int, int]] = []
        if spans and top >= 0:
            last = -2
            for i, m in enumerate(WORD.finditer(t)):
                if own[i] >= 0:
                    if last == i - 1:
                        found[-1] = (found[-1][0], m.end())
                    else:
                        found.append(m.span())
                    last = i
        out.append(((top, second), found))
    return out


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES,
        max_chains: int = MAX_CHAINS) -> Field:
    """Train on a bounded sample of labelled documents outside the held-out fifth."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sample = sample_labels(known.select(F.col("doc_id").cast("long").alias("own_id"),
                                        F.col("toxic").cast("int").alias("label")), max_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("own_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = (sample_texts(texts.filter(F.octet_length("text") <= max_bytes), sample, max_rows, "toxic-sample")
            .toPandas().sort_values(["own_id", "text", "label"]))
    bound = {} if max_chains == MAX_CHAINS else {"max_chains": max_chains}
    return train(rows["text"].tolist(), rows["label"].to_numpy(dtype=int), **bound)


def score(docs: DataFrame, field: Field) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, n_spans, spans (start:end, comma-joined)."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(field)          # 2 MB, whatever the corpus
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("n_spans", pa.int64()),
                        ("spans", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = Scores(shared.value)
        own = scores.field
        for batch in batches:
            for part in text_slices(batch, "text", 1 << 22):
                texts = [t.as_py() or "" for t in part.column("text")]
                if own.share is not None:
                    value, found = np.full(len(texts), own.share), [[]] * len(texts)
                else:
                    tagged = scan(texts, scores, spans=True)
                    value = own.scores([m for m, _ in tagged])
                    found = [f for _, f in tagged]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(value), pa.array([len(f) for f in found], pa.int64()),
                     pa.array([",".join(f"{a}:{b}" for a, b in f) for f in found], pa.string())], schema=schema)

    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = cols.mapInArrow(run, "doc_id long, score double, n_spans long, spans string")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_spans", "spans")


def toxic_scores(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES,
                 max_chains: int = MAX_CHAINS) -> DataFrame:
    return score(docs, fit(docs, labels, max_rows, max_bytes, max_chains))
