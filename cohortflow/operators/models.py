"""Design matrices and GLM fits (logistic, Poisson, negative binomial).

Fitting runs on Spark in two stages:

1. rows are aggregated to covariate patterns (``groupBy(terms, offset[, y])``):
   one shuffle over the data, written once. With factor covariates the
   pattern table is small however many rows there are.
2. Newton's method, whose every round needs only sums over the patterns. A
   pattern table of at most ``IN_TASK`` rows is held by one task, which runs
   all rounds (one job); a larger one stays dealt out and each round is one
   job whose tasks return their partial sums. Both use the same functions.

The negative binomial (log link, offset) is fitted jointly in its coefficients
and log theta. All that theta needs of the counts themselves is how many rows
have a count above k, a table that is made once (``TailCounts``) and gives score
and information at any theta.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortflow.session import ship_code, write_once

#: Pattern tables of more rows are summed by Spark in every round; this many take about 100 bytes each in a task.
IN_TASK = 200_000
#: Distinct counts beyond this many are not gathered; each task then makes the table of its own rows.
TAIL_ROWS = 1_000_000
#: Above this theta the counts show no over-dispersion and the fit is the Poisson limit.
THETA_LIMIT = 1e6
STEP = 1e-8                     # rounds end when no coefficient moves by more
Z_975 = 1.959963984540054


@dataclass
class Term:
    name: str
    expr: Column


def design_terms(factors: dict[str, list[str]], numeric: list[str]) -> list[Term]:
    """Treatment contrasts against each factor's FIRST level, then numerics as is."""
    terms = []
    for f, levels in factors.items():
        for lv in levels[1:]:
            terms.append(Term(f"{f}{lv}", (F.col(f) == F.lit(lv)).cast("double")))
    for c in numeric:
        terms.append(Term(c, F.col(c).cast("double")))
    return terms


def design_matrix(df: DataFrame, factors: dict[str, list[str]], numeric: list[str],
                  keep: list[str]) -> DataFrame:
    """Complete cases (every column named is present, factor values within levels)
    with one 0/1 column per non-reference level plus the numeric columns.

    ``keep`` names the columns of ONE model besides its terms (outcome, offset), so
    that a row is only left out of the models whose own columns it lacks.
    """
    d = df.na.drop(subset=[*factors, *numeric, *keep])
    for f, levels in factors.items():
        d = d.where(F.col(f).isin(levels))
    return d.select(*[F.col(k) for k in keep], *[t.expr.alias(t.name) for t in design_terms(factors, numeric)])


# ------------------------------------------------------------- sums over patterns

def polygamma_step(order: int, low: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Sum of 1 / (low + k) ** order for k from 0 to length - 1; order 1 or 2.

    Short runs are added up; long ones are differences of the digamma or
    trigamma function, whose asymptotic series is used from 30 on.
    """
    low, length = np.asarray(low, float), np.asarray(length, float)
    near = np.minimum(length, 64).astype(int)
    k = np.arange(64)
    out = np.where(k < near[:, None], 1 / (low[:, None] + k) ** order, 0.0).sum(axis=1)
    far = np.flatnonzero(length > 64)
    if len(far):
        a, b = low[far] + 64, low[far] + length[far]        # both 64 or more
        if order == 1:
            tail = lambda x: -1 / (2 * x) - 1 / (12 * x ** 2) + 1 / (120 * x ** 4) - 1 / (252 * x ** 6)
            out[far] += np.log1p((b - a) / a) + tail(b) - tail(a)
        else:
            tail = lambda x: 1 / x + 1 / (2 * x ** 2) + 1 / (6 * x ** 3) - 1 / (30 * x ** 5) + 1 / (42 * x ** 7)
            out[far] += tail(a) - tail(b)
    return out


class TailCounts:
    """N(Y > k) of a sample of counts, in runs of equal numbers: as many runs as distinct counts."""

    def __init__(self, y: np.ndarray, weight: np.ndarray):
        values, at = np.unique(np.asarray(y, float), return_inverse=True)
        held = np.bincount(at, weights=weight, minlength=len(values))
        above = np.cumsum(held[::-1])[::-1]                # rows with a count of at least values[j]
        start = np.concatenate([[0.0], values[:-1]])
        some = values > 0
        self.start, self.length, self.above = start[some], (values - start)[some], above[some]

    def sums(self, theta: float) -> tuple[float, float]:
        """Sums of N(Y > k) / (theta + k) and of N(Y > k) / (theta + k)^2."""
        one = polygamma_step(1, theta + self.start, self.length)
        two = polygamma_step(2, theta + self.start, self.length)
        return float(self.above @ one), float(self.above @ two)


def pattern_sums(family: str, X, off, m, y, beta, theta) -> np.ndarray:
    """What a round needs of these patterns, as one vector (``unpack`` names the parts).

    Gradient, observed and expected information of the coefficients, deviance, rows,
    and for theta: score and information without the tail sums, the cross terms
    with the coefficients, and the moment sum of (y / mu - 1)^2.
    """
    eta = np.clip(X @ beta + off, -700, 700)
    score = info = 0.0
    cross = np.zeros(X.shape[1])
    if family == "binomial":
        mu = 1 / (1 + np.exp(-eta))
        grad, seen = m * (y - mu), m * mu * (1 - mu)
        expected, moment = seen, 0.0
        dev = 2 * m * (np.logaddexp(0, eta) - y * eta)      # y is the share of ones among m rows
    else:
        mu = np.exp(eta)
        over = 1.0 if theta is None else theta / (theta + mu)
        grad, expected = m * (y - mu) * over, m * mu * over
        seen = expected if theta is None else m * mu * theta * (y + theta) / (theta + mu) ** 2
        moment = (m * (y / mu - 1) ** 2).sum()
        with np.errstate(divide="ignore", invalid="ignore"):
            dev = np.where(y > 0, y * np.log(y / mu), 0.0)
        if theta is None:
            dev = 2 * m * (dev - (y - mu))
        else:
            dev = 2 * m * (dev - (y + theta) * np.log((y + theta) / (mu + theta)))
            score = (m * (1 - np.log1p(mu / theta) - (y + theta) / (mu + theta))).sum()
            info = (m * (2 / (mu + theta) - 1 / theta - (y + theta) / (mu + theta) ** 2)).sum()
            cross = -X.T @ (m * (y - mu) * mu / (theta + mu) ** 2)
    return np.concatenate([X.T @ grad, ((X.T * seen) @ X).ravel(), ((X.T * expected) @ X).ravel(), cross,
                           [dev.sum(), m.sum(), score, info, moment, (m * y).sum(), (m * np.exp(off)).sum()]])


def unpack(total: np.ndarray, p: int) -> dict:
    parts = np.split(total, np.cumsum([p, p * p, p * p, p]))
    named = dict(zip(["dev", "n", "score", "info", "moment", "events", "exposure"], parts[4].tolist()))
    return {"grad": parts[0], "seen": parts[1].reshape(p, p), "expected": parts[2].reshape(p, p), "cross": parts[3],
            **named}


Totals = Callable[[str, np.ndarray, float | None], dict]


# ------------------------------------------------------------------------ fits

@dataclass
class Fit:
    beta: np.ndarray
    gram: np.ndarray            # expected information of the coefficients
    deviance: float
    n: float
    rounds: int
    converged: bool
    theta: float | None = None
    theta_info: float | None = None


def free_terms(A: np.ndarray, tol: float = 1e-9) -> np.ndarray:
    """True for the columns of a Gram matrix that do not depend on the columns before them."""
    free = np.zeros(len(A), dtype=bool)
    for j in range(len(A)):
        rest = A[j, j]
        if free.any():
            rest = rest - A[j, free] @ np.linalg.solve(A[np.ix_(free, free)], A[free, j])
        free[j] = A[j, j] > 0 and rest > tol * A[j, j]
    return free


def _step(A: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Newton step; terms that depend on earlier ones do not move."""
    free = free_terms(A)
    out = np.zeros(len(b))
    out[free] = np.linalg.solve(A[np.ix_(free, free)], b[free])
    return out


def newton(totals: Totals, p: int, family: str, max_iter: int) -> tuple[Fit, dict]:
    """Binomial or Poisson fit. Starts at zero, a Poisson fit at the mean rate."""
    beta = np.zeros(p)
    if family == "poisson":
        s = totals(family, beta, None)
        beta[0] = math.log((s["events"] + 0.1) / s["exposure"])
    rounds, done = 0, False
    while rounds < max_iter and not done:
        s = totals(family, beta, None)
        step = _step(s["seen"], s["grad"])
        beta, rounds = beta + step, rounds + 1
        done = bool(np.max(np.abs(step)) < STEP)
    s = totals(family, beta, None)
    return Fit(beta, s["expected"], s["dev"], s["n"], rounds, done), s


def negative_binomial(totals: Totals, tails: Callable[[float], tuple[float, float]], p: int, max_iter: int) -> Fit:
    """Joint Newton fit of coefficients and log theta, from the Poisson fit and the moment estimate of theta.

    A step of log theta is at most 1; where the information of theta is not positive its
    sign is turned, which moves uphill. Without over-dispersion theta grows without end:
    past ``THETA_LIMIT`` the Poisson fit is returned, with theta None.
    """
    limit, s = newton(totals, p, "poisson", max_iter)
    if s["moment"] <= 0 or s["n"] / s["moment"] > THETA_LIMIT:
        return limit
    beta, theta, rounds, done = limit.beta, s["n"] / s["moment"], 0, False
    while rounds < max_iter and not done:
        s = totals("negbin", beta, theta)
        one, two = tails(theta)
        score, info = s["score"] + one, s["info"] + two
        slope, bend = theta * score, theta * theta * info - theta * score          # by log theta
        cross = theta * s["cross"]
        left = bend - cross @ _step(s["seen"], cross)
        joint = np.block([[s["seen"], cross[:, None]], [cross[None], np.array([[bend]])]])
        if left > 0:
            step = _step(joint, np.append(s["grad"], slope))
        else:
            step = np.append(_step(s["seen"], s["grad"]), slope / max(abs(bend), 1e-300))
        step[-1] = np.clip(step[-1], -1, 1)
        beta, theta, rounds = beta + step[:-1], theta * math.exp(step[-1]), rounds + 1
        if theta > THETA_LIMIT:
            return limit
        done = bool(np.max(np.abs(step)) < STEP)
    s = totals("negbin", beta, theta)
    return Fit(beta, s["expected"], s["dev"], s["n"], rounds, done, theta, s["info"] + tails(theta)[1])


def _arrays(pdf: pd.DataFrame, terms: list[str]):
    X = np.column_stack([np.ones(len(pdf))] + [pdf[t].to_numpy(float) for t in terms])
    return X, pdf["__off"].to_numpy(float), pdf["__m"].to_numpy(float), pdf["__y"].to_numpy(float)


def _fit(family: str, totals: Totals, tails, p: int, max_iter: int) -> Fit:
    return negative_binomial(totals, tails, p, max_iter) if family == "negbin" else newton(totals, p, family, max_iter)[0]


def _constant(family: str, ones: float, n: float) -> bool:
    return family == "binomial" and (ones <= 0.5 or ones >= n - 0.5)


def _fit_in_task(pat: DataFrame, terms: list[str], family: str, max_iter: int, most: int) -> Fit | None:
    """All rounds in the one task that holds the pattern table; None beyond ``most`` patterns, which it doesn't keep."""
    p = len(terms) + 1

    def run(it):
        held, size = [], 0
        for pdf in it:
            held, size = [*held, pdf], size + len(pdf)
            if size > most:
                yield pd.DataFrame([[False, *[None] * (len(names) - 1)]], columns=names, dtype=object)
                return
        fit = Fit(np.zeros(p), np.zeros((p, p)), 0.0, 0.0, 0, False)
        if size:
            X, off, m, y = _arrays(pd.concat(held, ignore_index=True), terms)
            fit.n = float(m.sum())
            if not _constant(family, float(m @ y), fit.n):
                fit = _fit(family, lambda f, b, t: unpack(pattern_sums(f, X, off, m, y, b, t), p),
                           TailCounts(y, m).sums if family == "negbin" else None, p, max_iter)
        yield pd.DataFrame([{"fitted": True, "beta": fit.beta.tolist(), "gram": fit.gram.ravel().tolist(),
                             "deviance": fit.deviance, "n": fit.n, "rounds": fit.rounds, "converged": fit.converged,
                             "theta": fit.theta, "theta_info": fit.theta_info}], columns=names)

    schema = T.StructType.fromDDL("fitted boolean, beta array<double>, gram array<double>, deviance double, n double, "
                                  "rounds int, converged boolean, theta double, theta_info double")
    names = schema.fieldNames()
    r = pat.coalesce(1).mapInPandas(run, schema).first()
    if not r.fitted:
        return None
    return Fit(np.array(r.beta), np.array(r.gram).reshape(p, p), r.deviance, r.n, r.rounds, r.converged, r.theta,
               r.theta_info)


def _fit_by_passes(pat: DataFrame, terms: list[str], family: str, max_iter: int) -> Fit:
    """One job per round; a task returns one vector of sums, its size set by the number of terms."""
    p = len(terms) + 1
    n, ones = pat.agg(F.sum("__m"), F.sum(F.col("__m") * F.col("__y"))).first()
    if _constant(family, ones, n):
        return Fit(np.zeros(p), np.zeros((p, p)), 0.0, n, 0, False)
    by_task: list[tuple[float, float]] = []
    tails = None
    if family == "negbin":
        counts = write_once(pat.groupBy("__y").agg(F.sum("__m").alias("n")), "tails")
        if counts.count() <= TAIL_ROWS:
            held = counts.toPandas()
            tails = TailCounts(held["__y"].to_numpy(), held["n"].to_numpy()).sums

    def totals(f, beta, theta):
        own_tails = f == "negbin" and tails is None

        def run(it):
            for pdf in it:
                X, off, m, y = _arrays(pdf, terms)
                more = TailCounts(y, m).sums(theta) if own_tails else (0.0, 0.0)
                yield pd.DataFrame({"sums": [np.append(pattern_sums(f, X, off, m, y, beta, theta), more).tolist()]})

        vectors = pat.mapInPandas(run, "sums array<double>").select(F.posexplode("sums").alias("i", "x"))
        total = np.array([r.x for r in vectors.groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()])
        by_task[:] = [tuple(total[-2:])]
        return unpack(total[:-2], p)

    return _fit(family, totals, tails or (lambda theta: by_task[0]), p, max_iter)


# ------------------------------------------------------------------ models

def _patterns(design: DataFrame, terms: list[str], y: str, offset: str | None, by_y: bool) -> DataFrame:
    """The pattern table, written once: terms, ``__off``, ``__y`` (a share of ones unless ``by_y``), rows ``__m``."""
    keys = [F.col(f"`{t}`") for t in terms]
    off = F.col(offset).cast("double") if offset else F.lit(0.0)
    d = design.select(*keys, off.alias("__off"), F.col(y).cast("double").alias("__y"))
    m = F.count(F.lit(1)).cast("double").alias("__m")
    if by_y:
        return write_once(d.groupBy(*keys, "__off", "__y").agg(m), "patterns")
    return write_once(d.groupBy(*keys, "__off").agg(m, F.avg("__y").alias("__y")), "patterns")


COEF_SCHEMA = T.StructType([
    T.StructField("term", T.StringType()), T.StructField("estimate", T.DoubleType()),
    T.StructField("std_error", T.DoubleType()), T.StructField("statistic", T.DoubleType()),
    T.StructField("p_value", T.DoubleType()), T.StructField("exp_estimate", T.DoubleType()),
    T.StructField("ci_lower", T.DoubleType()), T.StructField("ci_upper", T.DoubleType()),
    T.StructField("n_obs", T.LongType()), T.StructField("deviance", T.DoubleType()),
    T.StructField("theta", T.DoubleType()), T.StructField("theta_std_error", T.DoubleType()),
    T.StructField("iterations", T.IntegerType()), T.StructField("converged", T.BooleanType())])


def _fitted(design: DataFrame, y: str, terms: list[str], family: str, offset: str | None, max_iter: int,
            in_task: int) -> DataFrame:
    """One row per term with its Wald interval; a term that depends on earlier ones has NULL figures.

    ``theta_std_error`` is from the observed information of theta at the fitted means.
    """
    spark = design.sparkSession
    ship_code(spark)
    pat = _patterns(design, terms, y, offset, by_y=family != "binomial")
    fit = _fit_in_task(pat, terms, family, max_iter, in_task) or _fit_by_passes(pat, terms, family, max_iter)
    if not fit.n:
        raise ValueError(f"no complete row to fit {y!r} on")
    if not fit.rounds:
        raise ValueError(f"outcome {y!r} is constant; a logistic fit is not identified")
    free = free_terms(fit.gram)
    var = np.full(len(free), np.nan)
    var[free] = np.diag(np.linalg.inv(fit.gram[np.ix_(free, free)]))
    known = fit.theta is not None and fit.theta_info is not None and fit.theta_info > 0
    common = (int(round(fit.n)), float(fit.deviance), fit.theta, 1 / math.sqrt(fit.theta_info) if known else None,
              int(fit.rounds), bool(fit.converged))
    out = []
    for name, b, v, ok in zip(["(Intercept)", *terms], fit.beta.tolist(), var.tolist(), free):
        if not ok:
            out.append((name, *[None] * 7, *common))
            continue
        se = math.sqrt(v)
        out.append((name, b, se, b / se, math.erfc(abs(b / se) / math.sqrt(2)), math.exp(b), b - Z_975 * se,
                    b + Z_975 * se, *common))
    return spark.createDataFrame(out, COEF_SCHEMA)


def fit_logistic(design: DataFrame, y: str, terms: list[str], max_iter: int = 25, in_task: int = IN_TASK) -> DataFrame:
    """Logistic regression on 0/1 outcome ``y``; rejects a constant outcome."""
    return _fitted(design, y, terms, "binomial", None, max_iter, in_task)


def fit_poisson(design: DataFrame, y: str, terms: list[str], offset: str | None = None, max_iter: int = 50,
                in_task: int = IN_TASK) -> DataFrame:
    return _fitted(design, y, terms, "poisson", offset, max_iter, in_task)


def fit_negative_binomial(design: DataFrame, y: str, terms: list[str], offset: str | None = None,
                          max_iter: int = 100, in_task: int = IN_TASK) -> DataFrame:
    """Negative binomial (log link) with optional offset; theta estimated."""
    return _fitted(design, y, terms, "negbin", offset, max_iter, in_task)
