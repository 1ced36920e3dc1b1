"""Tail probabilities that Spark lacks, in double precision and without cancellation."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The least positive normal double; -log10 is taken of p values no smaller.
TINY = 2.2250738585072014e-308


#: Steps after which a series or fraction that has not settled raises.
MAX_STEPS = 20_000


def _settle(step, n: int) -> None:
    """Runs ``step(m, at)`` for m = 1, 2, ..., where ``at`` are the elements that have not settled and the result says which
    of these have now. Elements leave as soon as they settle."""
    at = np.arange(n)
    for m in range(1, MAX_STEPS):
        if not len(at):
            return
        at = at[~step(m, at)]
    raise ArithmeticError(f"a tail did not converge in {MAX_STEPS} steps")


def _lentz(first: np.ndarray, terms) -> np.ndarray:
    """The continued fraction 1 / (first + terms(1) / (. + terms(2) / ...)) by Lentz's method; ``terms(m, at)`` gives the
    (numerator, denominator) pairs of step m."""
    tiny = 1e-300
    d = 1 / np.where(np.abs(first) < tiny, tiny, first)
    c, h = np.full_like(d, 1 / tiny), d.copy()

    def step(m, at):
        dd, cc, hh = d[at], c[at], h[at]
        for a, b in terms(m, at):
            dd = b + a * dd
            dd = 1 / np.where(np.abs(dd) < tiny, tiny, dd)
            cc = b + a / cc
            cc = np.where(np.abs(cc) < tiny, tiny, cc)
            change = dd * cc
            hh = hh * change
        d[at], c[at], h[at] = dd, cc, hh
        return np.abs(change - 1) < 1e-15

    _settle(step, len(d))
    return h


def _series(ratio, n: int) -> np.ndarray:
    """1 + r(1) + r(1) r(2) + ..., for positive ratios ``ratio(m, at)`` that fall."""
    term, total = np.ones(n), np.ones(n)

    def step(m, at):
        term[at] *= ratio(m, at)
        total[at] += term[at]
        return term[at] < 1e-17 * total[at]

    _settle(step, n)
    return total


def _half_gamma_ratio(a: float) -> float:
    """Gamma(a + 1/2) / Gamma(a), without the cancellation of two large logarithms."""
    if a < 40:
        return math.exp(math.lgamma(a + 0.5) - math.lgamma(a))
    x = 1 / a
    return math.sqrt(a) * (1 + x * (-1 / 8 + x * (1 / 128 + x * (5 / 1024 + x * (-21 / 32768 + x * (-399 / 262144 + x * 869 / 4194304))))))


def student_t_two_sided(t, df: float) -> np.ndarray:
    """2 P(T > |t|) with df degrees of freedom. Below t^2 = 3 one minus the power series of the centre, whose terms fall
    like those of an exponential; beyond, the continued fraction of the tail, so that small values keep all digits."""
    t = np.atleast_1d(np.asarray(t, float))
    out = np.full(t.shape, np.nan)
    ok = ~np.isnan(t)
    if df <= 0 or not ok.any():
        return out
    with np.errstate(over="ignore", under="ignore", invalid="ignore", divide="ignore"):
        tt, a = t[ok] ** 2, df / 2
        p, near = np.zeros(len(tt)), tt < 3
        # both parts share x^a y^(1/2) / B(a, 1/2) with x = df / (df + t^2), y = 1 - x
        front = np.exp(-a * np.log1p(tt / df)) * np.sqrt(tt / (df + tt)) * (_half_gamma_ratio(a) / math.sqrt(math.pi))
        y = tt[near] / (df + tt[near])
        p[near] = 1 - 2 * front[near] * _series(lambda m, at: (a + m - 0.5) / (m + 0.5) * y[at], len(y))
        far = ~near & (front > 0)
        x = df / (df + tt[far])

        def terms(m, at):
            z = x[at]
            for k in (2 * m - 1, 2 * m):  # the incomplete beta function's fraction with b = 1/2
                j = k // 2
                yield (-(a + j) * (a + 0.5 + j) * z / ((a + 2 * j) * (a + 2 * j + 1)) if k % 2 else j * (0.5 - j) * z / ((a + 2 * j - 1) * (a + 2 * j))), 1.0

        p[far] = front[far] / a * _lentz(np.ones(int(far.sum())), terms)
    out[ok] = np.clip(p, 0.0, 1.0)
    return out


def critical_t(p: float, df: float) -> float:
    """A |t| at or just below that whose two-sided p value is ``p``: rows with a smaller |t| have larger p values."""
    low, high = 0.0, 1.0
    while student_t_two_sided(high, df)[0] > p and high < 1e150:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        low, high = (mid, high) if student_t_two_sided(mid, df)[0] > p else (low, mid)
    return low * (1 - 1e-12)


def chi_square_upper(x, df: int) -> np.ndarray:
    """P(X > x): the regularised upper incomplete gamma function, by its series below the mean and its fraction beyond."""
    x = np.atleast_1d(np.asarray(x, float))
    out = np.full(x.shape, np.nan)
    ok = ~np.isnan(x)
    half, a = np.maximum(x[ok], 0) / 2, df / 2
    p = np.zeros(len(half))
    near, finite = half < a + 1, np.isfinite(half)
    with np.errstate(divide="ignore", under="ignore", invalid="ignore"):
        front = np.where(half > 0, np.exp(np.where(finite, -half + a * np.log(np.where(half > 0, half, 1.0)), -np.inf) - math.lgamma(a)), 0.0)
    z = half[near]
    p[near] = 1 - front[near] / a * _series(lambda m, at: z[at] / (a + m), len(z))
    far = ~near & (front > 0)
    w = half[far]
    p[far] = front[far] * _lentz(w + 1 - a, lambda m, at: [(-m * (m - a), w[at] + 2 * m + 1 - a)])
    out[ok] = np.clip(p, 0.0, 1.0)
    return out


def negative_log10(p) -> np.ndarray:
    return -np.log10(np.clip(np.asarray(p, float), TINY, 1.0))


def negative_log10_col(p: Column) -> Column:
    return -F.log10(F.least(F.greatest(p, F.lit(TINY)), F.lit(1.0)))
