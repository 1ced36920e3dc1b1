"""The association statistics as column expressions over sufficient statistics, safe under ANSI arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

R_LIMIT, EPS = 0.999999999, 1e-12


def correlation(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """Pearson's r of population moments, deviations not below EPS, within +-R_LIMIT."""
    sd = lambda s, q: F.greatest(F.sqrt(F.greatest(q / n - (s / n) * (s / n), F.lit(0.0))), F.lit(EPS))
    return F.least(F.greatest((sxy / n - (sx / n) * (sy / n)) / (sd(sx, sxx) * sd(sy, syy)), F.lit(-R_LIMIT)), F.lit(R_LIMIT))


def t_statistic(r: Column, n: Column) -> Column:
    return r * F.sqrt((n - 2) / F.greatest(1 - r * r, F.lit(EPS)))


def standard_error(r: Column, t: Column) -> Column:
    """|r| / |t|; NaN where t is 0."""
    return F.when(t == 0, F.lit(float("nan"))).otherwise(F.abs(r) / F.abs(F.nullif(t, F.lit(0.0))))
