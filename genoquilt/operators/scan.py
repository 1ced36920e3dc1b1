"""The marker x trait scans over marker-major tables (marker_idx long, marker_id string, g array<double>).

A marker is a row, so a scan is one map over the table without a shuffle: blocks of markers meet the
broadcast traits in a matrix product. p-value thresholds and per-trait limits act inside the block, so that only
rows of the result leave Python.
"""

from __future__ import annotations

import dataclasses
import warnings

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.statistics import EPS, R_LIMIT
from ..functions.tails import chi_square_upper, critical_t, negative_log10, student_t_two_sided
from .tables import unused

#: Bytes of traits that one broadcast holds; more traits are scanned in several passes.
BROADCAST_BYTES = 256 << 20
#: Bytes of dosages in one matrix product.
BLOCK_BYTES = 64 << 20
LINEAR = "marker_idx long, marker_id string, trait_idx int, n int, p_value double, `-log10_p` double, beta double, t_stat double, se double"


@dataclasses.dataclass
class Prepared:
    """Traits (n x T), residualised and scaled, and the covariates' orthonormal basis (n x k) or None."""

    traits: np.ndarray
    basis: np.ndarray | None
    names: list[str]


#: Singular values below this share of the largest count as none.
RANK_TOLERANCE = 1e-9


def residualise(y: np.ndarray, covariates: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None]:
    """Traits without their mean and their part in the space of the covariates, in units of their population deviation, and an
    orthonormal basis of that space. Covariates that depend on each other, or do not vary, span fewer
    dimensions than there are columns; that is warned about."""
    basis, left = None, y - y.mean(axis=0, keepdims=True)
    if covariates is not None and covariates.size:
        scale = covariates.std(axis=0)
        varying = (covariates[:, scale > 0] - covariates[:, scale > 0].mean(axis=0)) / scale[scale > 0]
        space, strength, _ = np.linalg.svd(varying, full_matrices=False)
        basis = space[:, strength > RANK_TOLERANCE * strength.max(initial=0.0)]
        if basis.shape[1] < covariates.shape[1]:
            warnings.warn(f"{covariates.shape[1]} covariates span {basis.shape[1]} dimensions only", stacklevel=2)
        for _ in range(2):  # the second pass removes what rounding left
            left = left - basis @ (basis.T @ left)
    spread = left.std(axis=0)
    return np.divide(left, spread, out=np.zeros_like(left), where=spread > 0), basis


def blocks_of(batch: pa.RecordBatch, n: int, most: int | None = None):
    """(rows, dosages as a matrix) of a batch, within BLOCK_BYTES and ``most`` rows."""
    step = max(1, min(BLOCK_BYTES // max(1, 8 * n), most or batch.num_rows))
    for at in range(0, batch.num_rows, step):
        part = batch.slice(at, step)
        g = part.column("g").flatten().to_numpy(zero_copy_only=False)
        if len(g) != part.num_rows * n:
            raise ValueError(f"a marker does not have {n} dosages")
        yield part, g.reshape(part.num_rows, n)


def deviations(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Markers without their means, and their population deviations as a column."""
    centred = g - g.mean(1, keepdims=True)
    return centred, centred.std(1, keepdims=True)


def correlate(g: np.ndarray, y: np.ndarray, dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Clamped correlations (markers x traits), their t statistics, and the markers' deviations."""
    g, y = g.astype(dtype, copy=False), y.astype(dtype, copy=False)
    centred, sd = deviations(g)
    r = (centred / np.maximum(sd, dtype(EPS))) @ y / dtype(g.shape[1])
    r = np.clip(r, dtype(-R_LIMIT), dtype(R_LIMIT)).astype(float)
    t = r * np.sqrt((g.shape[1] - 2) / np.maximum(1 - r * r, EPS))
    return r, t, sd[:, 0]


def linear_scan(markers: DataFrame, prepared: Prepared, compute_dtype: str = "float64", drop_monomorphic: bool = True, p_value_threshold: float | None = None, topk_per_trait: int | None = None, chunk_size: int | None = None) -> DataFrame:
    """LINEAR rows for each marker and trait: the semi-partial correlation, its t statistic with n - 2 degrees of freedom,
    two-sided p value and standard error (NaN where t is 0). A threshold and then a limit per trait (highest -log10 p,
    then highest |t|, then first marker) apply if given. ``chunk_size``: markers in one product, at most."""
    n, total = prepared.traits.shape
    if n <= 2:
        raise ValueError("more than two samples are needed")
    if compute_dtype not in ("float32", "float64"):
        raise ValueError("compute_dtype must be float32 or float64")
    dtype, step = np.dtype(compute_dtype).type, max(1, BROADCAST_BYTES // (8 * n))
    out = None
    for first in range(0, total, step):
        part = _linear_pass(markers, prepared.traits[:, first : first + step], first, dtype, drop_monomorphic, p_value_threshold, topk_per_trait, chunk_size)
        out = part if out is None else out.unionByName(part)
    return out if topk_per_trait is None else top_per_trait(out, topk_per_trait)


def _linear_pass(markers, traits, first, dtype, drop, threshold, topk, chunk_size):
    n = len(traits)
    shared = markers.sparkSession.sparkContext.broadcast(traits)  # at most BROADCAST_BYTES

    least = 0.0 if threshold is None else critical_t(threshold, n - 2)

    def run(batches):
        y = shared.value
        for batch in batches:
            for part, g in blocks_of(batch, n, chunk_size):
                r, t, sd = correlate(g, y, dtype)
                size = np.abs(t)
                keep = np.broadcast_to((sd > 0)[:, None] if drop else True, t.shape) & (size >= least)
                if topk is not None:  # of this block no more can be among the trait's best
                    rank = np.where(keep, size, -1.0)
                    for j in np.flatnonzero(keep.sum(0) > topk):
                        floor = -np.partition(-rank[:, j], topk - 1)[topk - 1]
                        keep[:, j] &= rank[:, j] >= floor
                i, j = np.nonzero(keep)
                rr, tt = r[i, j], t[i, j]
                pp = student_t_two_sided(tt, n - 2)  # only of the rows that are left
                if threshold is not None:
                    low = pp <= threshold
                    i, j, rr, tt, pp = i[low], j[low], rr[low], tt[low], pp[low]
                with np.errstate(divide="ignore", invalid="ignore"):
                    se = np.where(tt == 0, np.nan, np.abs(rr) / np.abs(tt))
                take = pa.array(i)
                columns = [(j + first).astype(np.int32), np.full(len(i), n, np.int32), pp, negative_log10(pp), rr, tt, se]
                yield pa.RecordBatch.from_arrays(
                    [part.column("marker_idx").take(take), part.column("marker_id").take(take), *map(pa.array, columns)],
                    names=["marker_idx", "marker_id", "trait_idx", "n", "p_value", "-log10_p", "beta", "t_stat", "se"],
                )

    return markers.select("marker_idx", "marker_id", "g").mapInArrow(run, LINEAR)


def top_per_trait(scan: DataFrame, k: int) -> DataFrame:
    """Each trait's k best rows; Spark limits each group before the shuffle."""
    order = Window.partitionBy("trait_idx").orderBy(F.desc("-log10_p"), F.desc(F.abs("t_stat")), "marker_idx")
    rank = unused(scan, "rank")
    return scan.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k).drop(rank)


def top_hit(scan: DataFrame) -> DataFrame:
    """The row with the highest -log10 p, the first marker and trait of equals."""
    order = [F.desc("-log10_p"), "marker_idx"] + ["trait_idx"] * ("trait_idx" in scan.columns)
    return scan.orderBy(*order).limit(1)


def trait_correlation(traits: np.ndarray, ridge: float) -> tuple[np.ndarray, np.ndarray]:
    """The traits' correlation matrix with the ridge on its diagonal, and its pseudo-inverse; one trait gives 1 x 1."""
    r = np.atleast_2d(np.corrcoef(traits, rowvar=False)) + ridge * np.eye(traits.shape[1])
    return r, np.linalg.pinv(r)


def multivariate_scan(markers: DataFrame, prepared: Prepared, ridge: float = 1e-6, drop_monomorphic: bool = True, chunk_size: int | None = None) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(marker_idx, marker_id, n_traits, chi2, df, p_value, -log10_p) for each marker, the traits' correlation and its
    inverse: chi2 is the quadratic form of the marker's t statistics, with as many degrees of freedom as traits."""
    n, k = prepared.traits.shape
    if n <= 2:
        raise ValueError("more than two samples are needed")
    if prepared.traits.nbytes + 8 * k * k > BROADCAST_BYTES:
        raise ValueError(f"the joint test of {k} traits and {n} samples needs more than {BROADCAST_BYTES} bytes a task")
    corr, inverse = trait_correlation(prepared.traits, ridge)
    shared = markers.sparkSession.sparkContext.broadcast((prepared.traits, inverse))

    def run(batches):
        y, w = shared.value
        for batch in batches:
            for part, g in blocks_of(batch, n, chunk_size):
                _, t, sd = correlate(g, y, np.float64)
                keep = np.flatnonzero(sd > 0) if drop_monomorphic else np.arange(len(sd))
                z = t[keep]
                chi2 = ((z @ w) * z).sum(1)
                p = chi_square_upper(chi2, k)
                take, ks = pa.array(keep), np.full(len(keep), k, np.int32)
                yield pa.RecordBatch.from_arrays([part.column("marker_idx").take(take), part.column("marker_id").take(take), pa.array(ks), pa.array(chi2), pa.array(ks), pa.array(p), pa.array(negative_log10(p))], names=["marker_idx", "marker_id", "n_traits", "chi2", "df", "p_value", "-log10_p"])

    out = markers.select("marker_idx", "marker_id", "g").mapInArrow(run, "marker_idx long, marker_id string, n_traits int, chi2 double, df int, p_value double, `-log10_p` double")
    return out, corr, inverse


def marker_quality(markers: DataFrame, n: int) -> dict[str, int]:
    """How many markers there are and vary, whether dosages are missing, and whether lengths differ: one pass, in which a
    dosage is read a fixed number of times."""

    def run(batches):
        total = uneven = missing = kept = 0
        for batch in batches:
            g = batch.column("g")
            sizes = pc.list_value_length(g).fill_null(-1).to_numpy(zero_copy_only=False)
            absent = sizes < 0
            total, uneven, missing = total + len(sizes), uneven + int(((sizes != n) & ~absent).sum()), missing + int(absent.sum())
            whole = batch.filter(pa.array(sizes == n))
            for _, x in blocks_of(whole, n):
                lacks = np.isnan(x).any(1)
                missing += int(lacks.sum())
                kept += int((deviations(x[~lacks])[1] > 0).sum())
        yield pa.RecordBatch.from_pydict({"n": [total], "uneven": [uneven], "missing": [missing], "kept": [kept]})

    counts = ("n", "uneven", "missing", "kept")
    parts = markers.select("g").mapInArrow(run, ", ".join(f"{c} long" for c in counts))
    row = parts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts)).first()
    if row["uneven"]:
        raise ValueError(f"{row['uneven']} markers do not have {n} dosages")
    if row["missing"]:
        raise ValueError("genotype contains missing values; complete matrices are required")
    return {"input": row["n"], "kept": row["kept"]}
