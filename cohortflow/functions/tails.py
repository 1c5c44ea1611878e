"""Distribution tails for p values.

Spark has no chi-square or t tails, so the finishing step of each test (a
handful of already-aggregated rows) goes through these small pure Python
routines, wrapped as pandas UDFs so plans stay lazy and the call runs on an
executor.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortflow.session import ship_code

# Both tails are written as integrals of exp(-s^2 / 2) times a slowly varying factor, so that a fixed set of nodes
# serves any number of degrees of freedom; nothing is iterated to convergence.
NODES, WEIGHTS = np.polynomial.legendre.leggauss(16)
PANEL, REACH = 0.5, 13.0        # beyond REACH the integrand has fallen by exp(-80) even at its slowest
DIRECT_DF = 200                 # up to here a chi-square tail is a short sum of positive terms


def _normal_integral(start: float, factor) -> float:
    """Integral of exp(-(s^2 - start^2) / 2) factor(s) over s from ``start`` >= 0."""
    left = start + PANEL * np.arange(round(REACH / PANEL))
    s = (left[:, None] + PANEL / 2 * (NODES + 1)).ravel()
    weight = np.tile(PANEL / 2 * WEIGHTS, len(left))
    return float(weight @ (np.exp(-(s - start) * (s + start) / 2) * factor(s)))


def _ratio_series(n: int) -> np.ndarray:
    """Coefficients c of u = sum c[k] v^k where v^2 / 2 = u - log(1 + u), from u u' = v (1 + u)."""
    c = np.zeros(n + 1)
    c[1] = 1.0
    for k in range(2, n + 1):
        c[k] = (c[k - 1] - sum(j * c[j] * c[k + 1 - j] for j in range(2, k))) / (k + 1)
    return c


RATIO = _ratio_series(16)


def _excess(u: float) -> float:
    """u - log(1 + u), without cancellation near 0."""
    if abs(u) > 0.05:
        return u - math.log1p(u)
    return sum((-u) ** k / k for k in range(2, 16))


def _ratio(v: np.ndarray) -> np.ndarray:
    """u with v^2 / 2 = u - log(1 + u) and the sign of v."""
    u = np.polynomial.polynomial.polyval(np.clip(v, -0.2, 0.2), RATIO)
    far = np.abs(v) > 0.2
    if far.any():
        goal = v[far] ** 2 / 2
        w = np.where(v[far] > 0, v[far] + goal, np.exp(np.minimum(-goal - 1, 0)) - 1)     # starts on the right side
        w = np.where((v[far] < 0) & (goal < 0.5), v[far] + v[far] ** 2 / 3, w)
        for _ in range(12):                                                 # Newton by log(1 + u); quadratic
            log = np.log1p(w)
            rise = np.expm1(log)
            log = log - (rise - log - goal) / np.where(rise == 0, 1.0, rise)
            w = np.expm1(log)
        u[far] = w
    return u


def chi2_sf(x, df):
    """P(X >= x) for a chi-square with a whole number ``df`` of degrees of freedom."""
    if x is None or df is None or not math.isfinite(x) or df <= 0:
        return None
    if x <= 0:
        return 1.0
    a, y = df / 2.0, x / 2.0
    if df <= DIRECT_DF:
        whole = int(df) % 2 == 0
        k = np.arange(int(df) // 2) + (0.0 if whole else 0.5)               # exponents of the terms
        logs = k * math.log(y) - y - np.array([math.lgamma(v + 1) for v in k.tolist()])
        return float(min(1.0, np.exp(logs).sum() + (0.0 if whole else math.erfc(math.sqrt(y)))))
    # x = a (1 + u); with v as above and s = v sqrt(a), the density of s is exp(-s^2 / 2) v / u, up to a constant
    u = (y - a) / a
    level = a * _excess(u)                                                  # s^2 / 2
    start, sign = math.sqrt(2 * level), 1.0 if u >= 0 else -1.0
    scale = math.exp(-level - 1 / (12 * a) + 1 / (360 * a ** 3)) / math.sqrt(2 * math.pi)

    def factor(s):
        v = sign * s / math.sqrt(a)
        return np.where(np.abs(v) < 1e-12, 1.0, v / np.where(v == 0, 1.0, _ratio(v)))

    tail = scale * _normal_integral(start, factor)
    return float(min(1.0, max(0.0, tail if u >= 0 else 1.0 - tail)))


def _log_gamma_half_step(x: float) -> float:
    """log Gamma(x + 1/2) - log Gamma(x)."""
    if x < 50:
        return math.lgamma(x + 0.5) - math.lgamma(x)
    return 0.5 * math.log(x) - 1 / (8 * x) + 1 / (192 * x ** 3) - 1 / (640 * x ** 5)


def t_two_sided(t, df):
    """Two-sided p of a Student t statistic."""
    if t is None or df is None or not math.isfinite(t) or df <= 0:
        return None
    # with t^2 = df (exp(s^2 / (df + 1)) - 1) the density of s is exp(-s^2 / 2) dt/ds, up to a constant
    start = math.sqrt((df + 1) * math.log1p(t * t / df))
    lead = math.exp(_log_gamma_half_step(df / 2) - start * start / 2) / math.sqrt(math.pi * df)

    def factor(s):
        q = s * s / (df + 1)
        return df / (df + 1) * s * np.exp(q) / np.sqrt(df * np.expm1(q))

    return float(min(1.0, 2 * lead * _normal_integral(start, factor)))


def norm_two_sided(z):
    if z is None or not math.isfinite(z):
        return None
    return math.erfc(abs(z) / math.sqrt(2.0))


UNDERFLOW = -746.0         # exp of less is 0 in double
FISHER_BLOCK = 1 << 16


def fisher_2x2(a: int, b: int, c: int, d: int) -> float:
    """Two-sided exact p of a 2x2 table (tables no more likely than observed).

    The hypergeometric pmf of the first cell, relative to its mode, is walked
    outward block by block through its ratio recurrence (log space, no
    factorial) until the terms are zero in double, so the work follows the
    spread of the distribution and not the size of its support.
    """
    r1, c1, rest = a + b, a + c, d - a
    lo, hi = max(0, -rest), min(r1, c1)
    mode = min(max((r1 + 1) * (c1 + 1) // (r1 + c1 + rest + 2), lo), hi)

    def outward(sign: int, last: int) -> np.ndarray:
        at, level, logs = mode, 0.0, [np.empty(0)]
        while at != last and level > UNDERFLOW:
            n = min(FISHER_BLOCK, abs(last - at))
            x = at + sign * np.arange(n, dtype=np.float64)
            if sign > 0:
                step = np.log(r1 - x) + np.log(c1 - x) - np.log(x + 1) - np.log(rest + x + 1)
            else:
                step = np.log(x) + np.log(rest + x) - np.log(r1 - x + 1) - np.log(c1 - x + 1)
            logs.append(level + np.cumsum(step))
            level, at = float(logs[-1][-1]), at + sign * n
        return np.concatenate(logs)

    above, below = outward(1, hi), outward(-1, lo)
    side, far = (above if a > mode else below), abs(a - mode)
    if far > len(side):
        return 0.0
    seen = side[far - 1] if far else 0.0
    logs = np.concatenate([below, [0.0], above])
    p = np.exp(logs)
    return float(min(1.0, p[logs <= seen + 1e-7].sum() / p.sum()))


def _vectorised(fn, *series: pd.Series) -> pd.Series:
    out = []
    for vals in zip(*series):
        vals = [None if (v is None or (isinstance(v, float) and math.isnan(v))) else v
                for v in vals]
        out.append(None if any(v is None for v in vals) else fn(*vals))
    return pd.Series(out, dtype="float64")


@F.pandas_udf(T.DoubleType())
def _chi2_sf_udf(x: pd.Series, df: pd.Series) -> pd.Series:
    return _vectorised(lambda a, b: chi2_sf(float(a), float(b)), x, df)


@F.pandas_udf(T.DoubleType())
def _t_two_sided_udf(t: pd.Series, df: pd.Series) -> pd.Series:
    return _vectorised(lambda a, b: t_two_sided(float(a), float(b)), t, df)


@F.pandas_udf(T.DoubleType())
def _norm_two_sided_udf(z: pd.Series) -> pd.Series:
    return _vectorised(lambda a: norm_two_sided(float(a)), z)


@F.pandas_udf(T.DoubleType())
def _fisher_udf(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return _vectorised(lambda *v: fisher_2x2(*[int(x) for x in v]), a, b, c, d)


def chi2_p(stat: Column, df: Column) -> Column:
    ship_code()
    return _chi2_sf_udf(stat.cast("double"), df.cast("double"))


def t_p(stat: Column, df: Column) -> Column:
    ship_code()
    return _t_two_sided_udf(stat.cast("double"), df.cast("double"))


def norm_p(z: Column) -> Column:
    ship_code()
    return _norm_two_sided_udf(z.cast("double"))


def fisher_p(a: Column, b: Column, c: Column, d: Column) -> Column:
    ship_code()
    return _fisher_udf(a.cast("long"), b.cast("long"), c.cast("long"), d.cast("long"))
