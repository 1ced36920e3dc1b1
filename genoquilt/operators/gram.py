"""Sufficient statistics of sample-major arrays: one pass, one small row a pair of columns and task is shuffled."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.statistics import correlation


def cross_products(df: DataFrame, array_col: str, left: list[int], right: list[int]) -> DataFrame:
    """(i, j, n, sx, sy, sxx, syy, sxy) for each column i of left and j of right, over the rows of an array column.
    Rows whose array is null take no part; a task holds one batch and the sums."""

    def run(batches):
        a, b = np.array(left), np.array(right)
        n, sx, sy, sxx, syy, sxy = 0, np.zeros(len(a)), np.zeros(len(b)), np.zeros(len(a)), np.zeros(len(b)), np.zeros((len(a), len(b)))
        for batch in batches:
            lists = batch.column(0)
            if not batch.num_rows:
                continue
            x = lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
            p, q = x[:, a], x[:, b]
            n += len(x)
            sx, sy, sxx, syy, sxy = sx + p.sum(0), sy + q.sum(0), sxx + (p * p).sum(0), syy + (q * q).sum(0), sxy + p.T @ q
        if n:
            i, j = np.repeat(np.arange(len(a)), len(b)), np.tile(np.arange(len(b)), len(a))
            yield pa.RecordBatch.from_arrays([pa.array(a[i].astype(np.int32)), pa.array(b[j].astype(np.int32)), pa.array(np.full(len(i), n)), *map(pa.array, (sx[i], sy[j], sxx[i], syy[j], sxy.ravel()))], names=["i", "j", "n", "sx", "sy", "sxx", "syy", "sxy"])

    parts = df.where(F.col(array_col).isNotNull()).select(array_col).mapInArrow(run, "i int, j int, n long, sx double, sy double, sxx double, syy double, sxy double")
    return parts.groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")))


def correlations(df: DataFrame, array_col: str, left: list[int], right: list[int]) -> DataFrame:
    """(i, j, n, r) for each pair of columns."""
    s = cross_products(df, array_col, left, right)
    return s.select("i", "j", "n", correlation(*(F.col(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy"))).alias("r"))


def covariance_matrix(df: DataFrame, array_col: str, columns: list[int]) -> tuple[np.ndarray, np.ndarray, int]:
    """Means, population covariances and row count; k x k numbers reach the driver."""
    rows = cross_products(df, array_col, columns, columns).collect()
    at = {c: k for k, c in enumerate(columns)}
    mean, cov, n = np.zeros(len(columns)), np.zeros((len(columns),) * 2), 0
    for r in rows:
        n = r["n"]
        mean[at[r["i"]]] = r["sx"] / n
        cov[at[r["i"]], at[r["j"]]] = r["sxy"] / n - (r["sx"] / n) * (r["sy"] / n)
    return mean, cov, n


def residual_weights(cov: np.ndarray, traits: list[int], covariates: list[int]) -> np.ndarray:
    """Columns w so that the centred row times w is a trait without its part along the covariates, with deviation 1.
    The same projection as by a QR of the covariates, from their Gram matrix; dependent covariates add nothing."""
    k = len(cov)
    w = np.zeros((k, len(traits)))
    for m, t in enumerate(traits):
        w[t, m] = 1.0
    if covariates:
        sd = np.sqrt(np.diag(cov)[covariates])
        use = [c for c, s in zip(covariates, sd) if s > 0]
        scale = 1 / np.sqrt(np.diag(cov)[use])
        inner = cov[np.ix_(use, use)] * np.outer(scale, scale)
        w[np.ix_(use, range(len(traits)))] -= scale[:, None] * (np.linalg.pinv(inner) @ (scale[:, None] * cov[np.ix_(use, traits)]))
    sd = np.sqrt(np.einsum("im,ij,jm->m", w, cov, w).clip(0))
    return w / np.where(sd > 0, sd, 1.0)
