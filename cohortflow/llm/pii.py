"""Personal data by aggregated weak supervision.

Base rules find emails, IP addresses, cards and phones (``base_spans``); they
always count. Beyond them, wider patterns propose candidate spans, and three
sorts of labelers vote on each: regexes (shape, check digits, ranges),
gazetteers (given names, top-level domains, dialling codes) and context (cue
and counter-cue words before the span, neighbouring characters). A vote is
for, against or abstain.

The first pass counts, over all documents, how often each combination of
kind, votes and span features occurs (a bounded table, added up map-side).
Expectation-maximisation on those counts, kind by kind, estimates every labeler's
reliability and each combination's probability; candidates that touch a base span are
known to be personal data, those that fail a check are known not to be, and both
anchor it. A logistic classifier over the span's features is then trained on these
probabilities. The second pass adds the candidates to which the classifier gives
``threshold`` or more and which touch no base span. Beside the base kinds these
are names, national ids, IBANs and secrets (keys and tokens).

Defined results: a null or empty text has no spans; repeated rows get equal
spans; equal starts are ordered by kind; a corpus without candidates adds
nothing; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortflow.llm.common import prepare, text_slices

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "name", "national_id", "iban", "secret")

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Word lists of the labelers.
GIVEN_NAMES = ("James", "Mary", "John", "Patricia", "Robert", "Jennifer", "Michael", "Linda", "William", "Elizabeth",
               "David", "Susan", "Richard", "Jessica", "Joseph", "Sarah", "Thomas", "Karen", "Anna", "Peter",
               "Hans", "Klaus", "Ursula", "Sabine", "Pierre", "Marie", "Camille", "Carlos", "Carmen", "Lucia",
               "Charles", "Christopher", "Daniel", "Matthew", "Anthony", "Mark", "Steven", "Paul", "Andrew", "Kenneth",
               "Nancy", "Lisa", "Margaret", "Sandra", "Ashley", "Emily", "Donna", "Michelle", "Laura", "Emma",
               "Jürgen", "Wolfgang", "Stefan", "Andreas", "Monika", "Petra", "Claudia", "Jean", "François", "Philippe",
               "Nathalie", "Isabelle", "Sophie", "José", "Antonio", "Manuel", "Francisco", "María", "Isabel", "Ana",
               "Mohammed", "Fatima", "Ahmed", "Wei", "Li", "Yuki", "Giuseppe", "Marco", "Giulia", "Ivan")
TITLES = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame")
TOP_DOMAINS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu", "us", "ch", "at",
               "it", "nl", "be", "pl", "se", "no", "fi", "dk", "pt", "ru", "cn", "jp", "in", "br", "mx", "au", "ca", "biz",
               "app", "dev", "cloud")
DIAL_CODES = ("1", "7", "33", "34", "39", "41", "43", "44", "49", "52", "55", "61", "81", "86", "91",
              "20", "27", "30", "31", "32", "36", "40", "45", "46", "47", "48", "51", "53", "54", "56", "57", "60", "62",
              "63", "64", "65", "66", "82", "84", "90", "92", "351", "353", "358", "380", "420", "971", "972")
CUES = ("phone", "tel", "telephone", "call", "mobile", "cell", "fax", "whatsapp", "contact", "email", "mail",
        "ssn", "social security", "card", "iban", "account", "name", "telefon", "telefono", "adresse")
SECRET_CUES = ("token", "secret", "key", "apikey", "api_key", "password", "passwd", "pwd", "bearer", "auth", "credential",
               "private")
SECRET_COUNTER = ("commit", "sha1", "sha256", "md5", "checksum", "hash", "digest", "uuid", "revision", "etag")
SECRET_HEADS = ("AKIA", "ghp_", "gho_", "sk-", "sk_live_", "xoxb-", "xoxp-", "AIza", "eyJ")
COUNTER_CUES = ("isbn", "page", "figure", "table", "version", "order", "invoice", "$", "=", "#", "€")

NUMBER = re.compile(r"(?<![0-9+])\+?\(?[0-9][0-9().\x20-]{5,30}[0-9]")
NORTH = re.compile(r"\+?1?[ .-]?\(?[2-9][0-9]{2}\)?[ .-][0-9]{3}[ .-][0-9]{4}")
SOCIAL = re.compile(r"(?!000|666)[0-8][0-9]{2}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}")
HIDDEN_MAIL = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?[(\[] ?at ?[)\]] ?[A-Za-z0-9-]{1,63}"
                         r"(?: ?(?:\.|[(\[] ?dot ?[)\]]) ?[A-Za-z0-9-]{1,63})+", re.I)
IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b")
NAME = re.compile(r"\b(?:(?:" + "|".join(TITLES) + r")\.? +[A-Z][a-z]{2,}|(?:" + "|".join(GIVEN_NAMES)
                  + r") +[A-Z][a-z]{2,})(?: [A-Z][a-z]{2,})?\b")
CUE = re.compile("(?:" + "|".join(map(re.escape, CUES)) + r")\b[^0-9A-Za-z]*(?:is|no|nr|number)?[^0-9A-Za-z]*$", re.I)
COUNTER = re.compile("(?:" + "|".join(map(re.escape, COUNTER_CUES)) + r")[^0-9A-Za-z]*$", re.I)


LONG_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,512}={0,2}(?![A-Za-z0-9+/_-])")
SECRET_CUE = re.compile("(?:" + "|".join(map(re.escape, SECRET_CUES)) + r")s?[\"']?\s*(?:=|:|is|=>)?\s*[\"']?$", re.I)
SECRET_NOT = re.compile("(?:" + "|".join(map(re.escape, SECRET_COUNTER)) + r")[\"']?\s*(?:=|:|is)?\s*[\"']?$", re.I)


# ----------------------------------------------------------------- base rules

def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    for d in digits[-2::-2]:
        total += sum(divmod(2 * int(d), 10))
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join([c for c in s if "0" <= c <= "9"])


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost, non-overlapping addresses, found from their at signs."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = free + len(text[free:at].rstrip(LOCAL)) if at > free else at
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, domain.end()))
            free = domain.end()
        else:
            free = max(free, at + 1)        # no address holds an at sign that failed
        at = text.find("@", max(free, at + 1))
    return out


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) by start, then kind as listed."""
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    for m in CARD.finditer(text):
        d = _digits(m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return [(s, BASE_KINDS[k], e) for s, k, e in sorted(out)]


# ------------------------------------------------------ candidates and votes

def _vote(yes: bool, no: bool = False) -> int:
    return 1 if yes else -1 if no else 0


def _context(text: str, start: int, end: int) -> tuple[int, int]:
    before = text[max(0, start - 24):start]
    beside = (start > 0 and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum())
    return _vote(bool(CUE.search(before)), bool(COUNTER.search(before))), _vote(False, beside)


def candidates(text: str) -> Iterator[tuple[int, int, str, tuple, tuple]]:
    """(start, end, kind, votes, features) of every candidate span."""
    for m in NUMBER.finditer(text):
        s, e = m.span()
        d, body = _digits(m[0]), m[0]
        if len(d) < 7:
            continue
        parts = body.split(".")
        dotted = len(parts) == 4 and all(p.isdigit() for p in parts)
        social = bool(SOCIAL.fullmatch(body))
        cue, beside = _context(text, s, e)
        valid = (all(int(p[-9:]) <= 255 for p in parts) if dotted else luhn(d) if 14 <= len(d) <= 19
                 else len(d) < 14 and beside == 0)
        votes = (_vote(bool(NORTH.fullmatch(body)) or bool(PHONE.fullmatch(body)) and 10 <= len(d) <= 15,
                       not 7 <= len(d) <= 19),
                 _vote(valid and (dotted or len(d) >= 14 or social), dotted or len(d) >= 14),
                 _vote(body[0] == "+" and body[1:].lstrip("(").startswith(DIAL_CODES), body[0] == "+"),
                 cue, beside)
        kind = "ip" if dotted else "national_id" if social else "card" if len(d) >= 14 else "phone"
        separators = len(body) - len(d) - (body[0] == "+")
        yield s, e, kind, (kind, *votes), (
            kind, min(len(d), 20) // 3, body[0] == "+", min(separators, 4), "(" in body, valid)
    spans = [(s, e, "plain") for s, e in emails(text)] if "@" in text else []
    if "(" in text or "[" in text:
        spans += [(*m.span(), "hidden") for m in HIDDEN_MAIL.finditer(text)]
    for s, e, form in spans:
        body = text[s:e]
        tail = re.split(r"[^A-Za-z]+", body)[-1].lower()
        cue, beside = _context(text, s, e)
        votes = (_vote(form == "plain"), _vote(form == "hidden"), _vote(tail in TOP_DOMAINS, len(tail) < 2), cue, beside)
        yield s, e, "email", ("email", *votes), ("email", form, tail in TOP_DOMAINS, min(body.count("."), 3))
    for m in NAME.finditer(text):
        s, e = m.span()
        words = m[0].replace(".", "").split()
        cue, beside = _context(text, s, e)
        votes = (_vote(any(w in GIVEN_NAMES for w in words)), _vote(words[0] in TITLES),
                 _vote(len(words) >= 3, False), cue, beside)
        yield s, e, "name", ("name", *votes), ("name", words[0] in TITLES, words[0] in GIVEN_NAMES, len(words))
    for m in IBAN.finditer(text):
        s, e = m.span()
        body = m[0].replace(" ", "")
        number = int("".join(str(int(c, 36)) for c in body[4:] + body[:4]))
        cue, beside = _context(text, s, e)
        votes = (_vote(number % 97 == 1, number % 97 != 1), _vote(15 <= len(body) <= 34, True), cue, beside, 0)
        yield s, e, "iban", ("iban", *votes), ("iban", number % 97 == 1, len(body) // 6)
    for m in LONG_TOKEN.finditer(text):
        s, e = m.span()
        token = m[0]
        if not any(map(str.isdigit, token)) or not any(map(str.isalpha, token)):
            continue                                    # a long word or number
        size = len(token)
        share = [token.count(c) / size for c in set(token)]
        bits = -sum(x * math.log2(x) for x in share)
        before = text[max(0, s - 32):s]
        quoted = s > 0 and e < len(text) and text[s - 1] in "\"'`" and text[e] == text[s - 1]
        shape = "hex" if all(c in "0123456789abcdefABCDEF" for c in token) else "other"
        head = token.startswith(SECRET_HEADS)
        path = token.count("/") > 1 and max(map(len, token.split("/"))) < 20
        votes = (_vote(head or shape == "hex" and size in (32, 40, 48, 64, 128), path),
                 _vote(bits >= 3.0, bits < 2.5), _vote(bool(SECRET_CUE.search(before)), bool(SECRET_NOT.search(before))),
                 _vote(quoted), _vote(False, text[s - 1:s] == "/" or text[s - 3:s] == "://"))
        yield s, e, "secret", ("secret", *votes), ("secret", shape, head, min(size, 80) // 8, quoted, bits >= 3.0,
                                                   votes[2])


def known_candidates(text: str) -> Iterator[tuple[tuple, tuple]]:
    """(votes, features) of every candidate; the votes' second entry tells whether it touches a base span."""
    found = list(candidates(text))
    own = base_spans(text) if found else []
    for s, e, _, votes, features in found:
        touches = any(s < b and a < e for a, _, b in own)
        yield (votes[0], int(touches), *votes[1:]), features


# -------------------------------------------------------------- aggregation

#: P(for | voted) at the start, for (other, checking) labelers: not personal data, then personal data.
START = ((0.25, 0.1), (0.75, 0.95))
#: Numbers of the checking labelers of each kind.
CHECKING = {"ip": (1, 4), "card": (1, 4), "phone": (1, 4), "national_id": (1, 4), "email": (4,), "name": (4,),
            "iban": (0, 3), "secret": (0, 1, 2, 4)}


def reliabilities(counts: dict[tuple, float], rounds: int = 60) -> tuple[dict[tuple, float], dict]:
    """Expectation-maximisation over vote combinations, kind by kind.

    ``counts``: votes (kind, 1 if known to be personal data, then the labelers) -> number of
    spans. Returns the probability of each combination and, per kind, the class share and
    P(for | voted) by class and labeler. An abstention says nothing about the
    class. Labelers start as right three times out of four. A span that touches a base
    span is known to be personal data; any other that fails a checking labeler (check digits,
    ranges, word boundaries) is known not to be; these known spans anchor the other labelers'
    estimates, and the start stays in with a small part of the labeler's
    votes, so that a kind of one-sided votes doesn't drift. The class share is that of the
    spans not known, as the known ones say nothing of them.
    """
    chance, tables = {}, {}
    for kind in sorted({v[0] for v in counts}):
        keys = sorted(v for v in counts if v[0] == kind)
        votes = np.array([k[2:] for k in keys])
        sure = np.array([k[1] == 1 for k in keys])
        pro, con = (votes == 1).astype(float), (votes == -1).astype(float)
        weight = np.array([float(counts[k]) for k in keys])
        share = 0.5
        start = np.array([[START[c][j in CHECKING[kind]] for j in range(votes.shape[1])] for c in (0, 1)])
        table, hold = start, 10.0 + 0.05 * (weight @ (pro + con))
        failed = (votes[:, list(CHECKING[kind])] == -1).any(axis=1) & ~sure
        open_ = weight * ~(sure | failed)
        for _ in range(rounds):
            odds = (np.log(share / (1 - share)) + pro @ np.log(table[1] / table[0])
                    + con @ np.log((1 - table[1]) / (1 - table[0])))
            p = np.where(sure, 1.0, np.where(failed, 0.0, 1 / (1 + np.exp(-np.clip(odds, -50, 50)))))
            share = float(np.clip((p @ open_ + 1) / (open_.sum() + 2), 0.02, 0.98))
            table = np.stack([(hold * start[c] + (weight * q) @ pro) / (hold + (weight * q) @ (pro + con))
                              for c, q in enumerate((1 - p, p))])
            table = np.clip(table, 0.01, 0.99)
        chance |= dict(zip(keys, p.tolist()))
        tables[kind] = (share, table)
    return chance, tables


class SpanClassifier:
    """Logistic regression over one-hot span features, fitted to probabilities."""

    def __init__(self, rows: list[tuple[tuple, float, float]], rounds: int = 30, ridge: float = 0.1):
        """``rows``: (features, probability, weight)."""
        names = sorted({x for f, _, _ in rows for x in self._names(f)})
        self.number = {x: i + 1 for i, x in enumerate(names)}
        self.weights = np.zeros(len(names) + 1)
        if not rows:
            return
        x = np.zeros((len(rows), len(names) + 1))
        for i, (f, _, _) in enumerate(rows):
            x[i, [0, *[self.number[n] for n in self._names(f)]]] = 1
        y, w = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))
            slope = x.T @ (w * (p - y)) + ridge * self.weights
            curve = (x * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.eye(x.shape[1])
            step = np.linalg.solve(curve, slope)
            self.weights -= step / max(1.0, np.abs(step).max() / 4)
            if np.abs(step).max() < 1e-8:
                break

    @staticmethod
    def _names(features: tuple) -> list[str]:
        one = [f"{features[0]}/{i}={v}" for i, v in enumerate(features)]
        return one + ["&".join(map(str, features))]

    def probability(self, features: tuple) -> float:
        known = [self.number[n] for n in self._names(features) if n in self.number]
        return float(1 / (1 + np.exp(-np.clip(self.weights[[0, *known]].sum(), -30, 30))))


def vote_counts(docs: DataFrame) -> DataFrame:
    """(votes, features, n) over the candidates of all documents; both as text."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for t in batch.column("text"):
                if t.is_valid:
                    seen.update((repr(v), repr(f)) for v, f in known_candidates(t.as_py()))
        if seen:
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in seen]), pa.array([k[1] for k in seen]), pa.array(list(seen.values()))],
                names=["votes", "features", "n"])

    return (docs.select("text").mapInArrow(run, "votes string, features string, n long")
            .groupBy("votes", "features").agg(F.sum("n").alias("n")))


def learn(docs: DataFrame) -> tuple[SpanClassifier, dict]:
    """Span classifier and labeler reliabilities from the whole corpus."""
    import ast
    held = [(ast.literal_eval(r["votes"]), ast.literal_eval(r["features"]), r["n"])
            for r in vote_counts(docs).orderBy("votes", "features").collect()]      # bounded by the vote alphabet
    votes: Counter = Counter()
    for v, _, n in held:
        votes[v] += n
    chance, tables = reliabilities(votes)
    return SpanClassifier([(f, chance[v], float(n)) for v, f, n in held]), tables


def spans(docs: DataFrame, classifier: SpanClassifier, threshold: float = 0.9) -> DataFrame:
    """One row per document: doc_id, base and all, arrays of struct(kind, start, end)."""
    prepare(docs.sparkSession)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("base", span), ("spans", span)])
    rank = {k: i for i, k in enumerate(KINDS)}

    def shown(found: list[tuple[int, str, int]]) -> list[dict]:
        return [{"kind": k, "start": s, "end": e} for s, k, e in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sure: dict[tuple, bool] = {}
        for batch in batches:
            for part in text_slices(batch, "text", 1 << 23):
                base, every = [], []
                for t in part.column("text"):
                    text = t.as_py() or ""
                    own = base_spans(text)
                    more = []
                    for s, e, kind, _, f in candidates(text):
                        if f not in sure:
                            sure[f] = classifier.probability(f) >= threshold
                        if sure[f] and all(e <= a or b <= s for a, _, b in own):
                            more.append((s, kind, e))
                    base.append(shown(own))
                    every.append(shown(sorted(own + more, key=lambda x: (x[0], rank[x[1]], x[2]))) if more
                                 else base[-1])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(base, span), pa.array(every, span)], schema=schema)

    kind = "array<struct<kind:string,start:long,end:long>>"
    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return cols.mapInArrow(run, f"doc_id long, base {kind}, spans {kind}")


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base spans by kind, the hash of the base spans, and all spans as text."""
    line = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(     # noqa: E731
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    secrets = F.size(F.filter("spans", lambda s: s["kind"] == "secret")).cast("long")
    return found.select("doc_id", *[of(k) for k in BASE_KINDS], F.sha2(line("base"), 256).alias("base_sha256"),
                        line("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"),
                        secrets.alias("n_secret"))


def find_personal_data(docs: DataFrame, threshold: float = 0.9) -> DataFrame:
    classifier, _ = learn(docs)
    return spans(docs, classifier, threshold)


def redact(text: str, found: list[tuple[int, str, int]], mask: str = "[{kind}]") -> str:
    """``text`` with the given (start, kind, end) spans replaced."""
    out, at = [], 0
    for s, kind, e in sorted(found):
        if s >= at:
            out += [text[at:s], mask.format(kind=kind)]
            at = e
    return "".join([*out, text[at:]])
