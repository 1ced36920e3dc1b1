"""``run_linear`` and ``run_multivariate``: from inputs of any form to a lazy result table with its metadata."""

from __future__ import annotations

import dataclasses
import time
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scan, tables
from ..sources import genotypes, sinks

VERSION = "0.1.0"


@dataclasses.dataclass
class LinearResult:
    table: DataFrame
    run_metadata: dict
    qc_summary: dict


@dataclasses.dataclass
class MultivariateResult:
    table: DataFrame
    run_metadata: dict
    qc_summary: dict
    phenotype_correlation: list[list[float]]


@dataclasses.dataclass
class Inputs:
    genotype: genotypes.Genotype
    phenotype: np.ndarray
    covariates: np.ndarray | None
    trait_names: list[str]
    covariate_names: list[str] | None
    sample_ids: list[str] | None
    qc: dict


def as_genotype(spark, genotype, marker_ids=None, **options) -> genotypes.Genotype:
    """A path, a samples x markers array, a marker table or a Genotype; given marker ids replace the source's."""
    ids = genotypes.read_ids(marker_ids) if isinstance(marker_ids, (str, Path)) else None if marker_ids is None else [str(m) for m in marker_ids]
    if isinstance(genotype, genotypes.Genotype):
        out = genotype
    elif isinstance(genotype, (str, Path)):
        out = genotypes.open_genotype(spark, str(genotype), **options)
    elif isinstance(genotype, DataFrame):
        out = genotypes.Genotype(genotype, genotype.select(F.size("g")).first()[0], None, True, True)
    else:
        return genotypes.from_array(spark, genotype, ids)
    if ids is not None:
        if (n := out.markers.count()) != len(ids):
            raise ValueError(f"{len(ids)} marker IDs for {n} markers")
        names = spark.createDataFrame(list(enumerate(ids)), "marker_idx long, marker_id string")
        out = dataclasses.replace(out, markers=out.markers.drop("marker_id").join(names, "marker_idx").select("marker_idx", "marker_id", "g"), has_marker_ids=True)
    return out


def _matrix(value, what: str) -> np.ndarray:
    x = np.asarray(genotypes.read_matrix(value) if isinstance(value, (str, Path)) else value, float)
    if x.ndim == 1:
        x = x[:, None]
    if x.ndim != 2:
        raise ValueError(f"{what} must be one- or two-dimensional")
    return x


def _values(spark, table, value, sample_ids, wanted, id_col, what):
    """The matrix and names of a table aligned to the samples, or of a matrix."""
    if table is not None:
        if sample_ids is None:
            raise ValueError(f"tabular {what} input requires genotype sample IDs")
        df = table if isinstance(table, DataFrame) else genotypes.read_table(spark, str(table))
        samples = spark.createDataFrame(list(enumerate(sample_ids)), "idx long, id string")
        aligned, names = tables.align(samples, df, id_col, wanted)
        rows = aligned.orderBy("idx").select(*names).collect()  # samples x values: the driver holds this for the projection
        return np.array([[np.nan if x is None else x for x in r] for r in rows], float).reshape(len(rows), len(names)), names
    return (None, wanted) if value is None else (_matrix(value, what), wanted)


def collect_inputs(spark, genotype, phenotype, covariates, phenotype_table, covariates_table, trait_columns, covariate_columns, sample_id_column, sample_ids, marker_ids, options, drop_empty_genotype) -> Inputs:
    g = as_genotype(spark, genotype, marker_ids, **options)
    ids = genotypes.read_ids(sample_ids) if isinstance(sample_ids, (str, Path)) else g.sample_ids if sample_ids is None else [str(s) for s in sample_ids]
    y, traits = _values(spark, phenotype_table, phenotype, ids, trait_columns, sample_id_column, "phenotype")
    if y is None:
        raise ValueError("a phenotype is required")
    c, covariate_names = _values(spark, covariates_table, covariates, ids, covariate_columns, sample_id_column, "covariate")
    for what, x in (("phenotype", y), ("covariates", c)):
        if x is not None and len(x) != g.n_samples:
            raise ValueError(f"{what} has {len(x)} rows; the genotype has {g.n_samples} samples")
        if x is not None and np.isnan(x).any():
            raise ValueError(f"{what} contains missing values; complete matrices are required")
    traits = list(traits) if traits else [f"trait_{i}" for i in range(y.shape[1])]
    if len(traits) != y.shape[1]:
        raise ValueError(f"{len(traits)} trait names for {y.shape[1]} traits")
    quality = scan.marker_quality(g.markers, g.n_samples)
    varies, used = y.std(0) > 0, np.zeros(0, bool) if c is None else c.std(0) > 0
    if not varies.any():
        raise ValueError("all phenotype columns were dropped due to zero variance")
    if drop_empty_genotype and not quality["kept"]:
        raise ValueError("all genotype columns were dropped due to zero variance")
    qc = {"n_samples": g.n_samples}
    for what, total, kept in (("genotype", quality["input"], quality["kept"]), ("phenotype", y.shape[1], int(varies.sum())), ("covariate", len(used), int(used.sum()))):
        qc |= {f"{what}_columns_input": total, f"{what}_columns_kept": kept, f"dropped_{what}_columns": total - kept}
    return Inputs(g, y[:, varies], None if c is None else c[:, used], [t for t, v in zip(traits, varies) if v], None if covariate_names is None else list(covariate_names), ids, qc)


def _metadata(analysis, spark, started, inputs, q, shape, device, chunk_size, sample_id_column) -> dict:
    return {
        "analysis": analysis, "chunk_size": int(chunk_size or min(shape[1], 4096) or 1), "device_requested": device, "device_used": "cpu", "genotype_shape": shape,
        "phenotype_shape": list(inputs.phenotype.shape), "covariate_shape": None if inputs.covariates is None else list(inputs.covariates.shape), "has_sample_ids": inputs.sample_ids is not None,
        "has_marker_ids": inputs.genotype.has_marker_ids, "sample_id_column": sample_id_column, "trait_columns": inputs.trait_names, "covariate_columns": inputs.covariate_names,
        "q_matrix_shape": None if q is None else list(q.shape), "runtime_seconds": time.time() - started, "version": VERSION,
    }


def run_linear(
    spark: SparkSession, genotype, phenotype=None, covariates=None, phenotype_table=None, covariates_table=None, trait_columns=None, covariate_columns=None, genotype_format="auto", sample_file=None,
    genotype_cache_dir=None, bim=None, fam=None, plink2_binary=None, sample_id_column="IID", sample_ids=None, marker_ids=None, device="auto", compute_dtype="auto", chunk_size=None, topk_per_trait=None,
    p_value_threshold=None, return_beta=True, return_se=True, return_t=True, output_dir=None, drop_monomorphic=None, distributed_output=True,
) -> LinearResult:
    """Association of every marker with every trait. Thresholds and limits apply in every mode. Markers without variance are
    dropped unless the genotype is disk-backed (or as ``drop_monomorphic`` says). ``output_dir`` gets results, run.json and qc.json:
    a folder ``results`` of parts that the tasks write, or without ``distributed_output`` one file in order of markers."""
    started = time.time()
    if topk_per_trait is not None and topk_per_trait <= 0:
        raise ValueError("topk_per_trait must be positive")
    if p_value_threshold is not None and not 0 < p_value_threshold <= 1:
        raise ValueError("p_value_threshold must be in (0, 1]")
    if compute_dtype not in ("auto", "float32", "float64"):
        raise ValueError("compute_dtype must be auto, float32 or float64")
    options = {"fmt": genotype_format, "bim": bim, "fam": fam, "sample_file": sample_file, "cache_dir": genotype_cache_dir, "plink2": plink2_binary}
    g = as_genotype(spark, genotype, marker_ids, **options)
    drop = not g.disk_backed if drop_monomorphic is None else drop_monomorphic
    inputs = collect_inputs(spark, g, phenotype, covariates, phenotype_table, covariates_table, trait_columns, covariate_columns, sample_id_column, sample_ids, None, {}, drop)
    used = compute_dtype if compute_dtype != "auto" else "float32" if g.disk_backed else "float64"
    y, q = scan.residualise(inputs.phenotype, inputs.covariates)
    found = scan.linear_scan(g.markers, scan.Prepared(y, q, inputs.trait_names), used, drop, p_value_threshold, topk_per_trait, chunk_size)
    names = F.array(*map(F.lit, inputs.trait_names))
    columns = ["marker_id", F.element_at(names, F.col("trait_idx") + 1).alias("trait"), "n", "p_value", "`-log10_p`"] + ["beta"] * return_beta + ["t_stat"] * return_t + ["se"] * return_se
    order = ["trait_idx", F.desc("-log10_p"), F.desc(F.abs("t_stat")), "marker_idx"] if topk_per_trait else ["marker_idx", "trait_idx"]
    shape = [g.n_samples, inputs.qc["genotype_columns_kept" if drop else "genotype_columns_input"]]
    meta = _metadata("linear", spark, started, inputs, q, shape, device, chunk_size, sample_id_column)
    meta |= {"compute_dtype_requested": compute_dtype, "compute_dtype_used": used, "topk_per_trait": topk_per_trait, "p_value_threshold": p_value_threshold, "results_streamed": output_dir is not None, "n_result_rows": None} | g.meta
    result = LinearResult(found.select(*columns), meta, inputs.qc)
    if output_dir is not None:
        _write(result, found.orderBy(*order).select(*columns), output_dir, distributed_output, p_value_threshold is not None or topk_per_trait is not None or not drop, started)
    return result


def _write(result, ordered: DataFrame, output_dir, distributed: bool, allow_empty: bool, started: float) -> None:
    out = Path(output_dir)
    out.mkdir(parents=True, exist_ok=True)
    if distributed:
        result.run_metadata["n_result_rows"] = n = sinks.write_rows(result.table, str(out / "results"))
        if not n and not allow_empty:
            raise ValueError("refusing to write an empty result table")
    else:
        result.run_metadata["n_result_rows"] = sinks.export_rows(ordered, out / "results.tsv.gz", allow_empty)
    result.run_metadata["runtime_seconds"] = time.time() - started
    sinks.write_json(result.run_metadata, out / "run.json")
    sinks.write_json(result.qc_summary, out / "qc.json")


def run_multivariate(
    spark: SparkSession, genotype, phenotype=None, covariates=None, phenotype_table=None, covariates_table=None, trait_columns=None, covariate_columns=None, genotype_format="auto", sample_file=None,
    genotype_cache_dir=None, bim=None, fam=None, plink2_binary=None, sample_id_column="IID", sample_ids=None, marker_ids=None, device="auto", chunk_size=None, output_dir=None, ridge=1e-6, distributed_output=True, allow_disk_backed=True,
) -> MultivariateResult:
    """One joint test a marker over all traits. Disk-backed genotypes are scanned too, unless ``allow_disk_backed`` is off."""
    started = time.time()
    options = {"fmt": genotype_format, "bim": bim, "fam": fam, "sample_file": sample_file, "cache_dir": genotype_cache_dir, "plink2": plink2_binary}
    g = as_genotype(spark, genotype, marker_ids, **options)
    if g.disk_backed and not allow_disk_backed:
        raise NotImplementedError("the multivariate scan of disk-backed genotypes is switched off")
    inputs = collect_inputs(spark, g, phenotype, covariates, phenotype_table, covariates_table, trait_columns, covariate_columns, sample_id_column, sample_ids, None, {}, True)
    y, q = scan.residualise(inputs.phenotype, inputs.covariates)
    found, corr, inverse = scan.multivariate_scan(g.markers, scan.Prepared(y, q, inputs.trait_names), ridge, chunk_size=chunk_size)
    columns = ["marker_id", "n_traits", "chi2", "df", "p_value", "`-log10_p`"]
    meta = _metadata("multivariate", spark, started, inputs, q, [g.n_samples, inputs.qc["genotype_columns_kept"]], device, chunk_size, sample_id_column)
    meta |= {"corr_inverse_shape": list(inverse.shape), "ridge": ridge} | g.meta
    result = MultivariateResult(found.select(*columns), meta, inputs.qc, corr.tolist())
    if output_dir is not None:
        _write(result, found.orderBy("marker_idx").select(*columns), output_dir, distributed_output, False, started)
        sinks.write_json({"phenotype_correlation": result.phenotype_correlation}, Path(output_dir) / "phenotype_correlation.json")
    return result


def run_unrelated(spark, genotype, cutoff=0.0884, output_dir=None, **linear) -> tuple[LinearResult, list[str]]:
    """A linear scan over the samples that kinship pruning keeps, on markers observed in all of them. Needs sample ids.
    ``output_dir`` also gets keep.txt (family and sample id; the sample id twice where no .fam names families) and
    unrelated_summary.json."""
    from ..operators import layout, relatedness

    options = {k: linear.pop(k) for k in ("genotype_format", "bim", "fam", "sample_file") if k in linear}
    families = _families(genotype, options)
    g = as_genotype(spark, genotype, linear.pop("marker_ids", None), **{{"genotype_format": "fmt"}.get(k, k): v for k, v in options.items()})
    given = linear.pop("sample_ids", None)
    ids = g.sample_ids if given is None else genotypes.read_ids(given) if isinstance(given, (str, Path)) else list(map(str, given))
    if ids is None:
        raise ValueError("kinship pruning requires sample IDs")
    unrelated = keep = relatedness.unrelated(relatedness.kinship_pairs(g.markers, g.n_samples, cutoff), g.n_samples, cutoff)
    for name in ("phenotype_table", "covariates_table"):
        if (t := linear.get(name)) is not None:
            df = t if isinstance(t, DataFrame) else genotypes.read_table(spark, str(t))
            col = tables.sample_id_column(df.columns, linear.get("sample_id_column", "IID"))
            samples = spark.createDataFrame([(i, ids[i]) for i in keep], "idx long, id string")
            keep = sorted(r["idx"] for r in tables.intersect_in_order(samples, (df, col)).collect())
    if not keep:
        raise ValueError("no unrelated sample is in every input")
    kept = dataclasses.replace(g, markers=layout.complete_at(g.markers, g.n_samples, keep), n_samples=len(keep), sample_ids=[ids[i] for i in keep])
    result = run_linear(spark, kept, output_dir=output_dir, **linear)
    if output_dir is not None:
        summary = {"kinship_cutoff": cutoff, "n_samples": g.n_samples, "n_unrelated": len(unrelated), "n_kept": len(keep), "n_result_rows": result.run_metadata["n_result_rows"]}
        sinks.write_artefact([f"{families.get(i, i)}\t{i}" for i in kept.sample_ids], Path(output_dir) / "keep.txt")
        sinks.write_json(summary, Path(output_dir) / "unrelated_summary.json")
    return result, kept.sample_ids


def _families(genotype, options: dict) -> dict[str, str]:
    """Family ids by sample id, where the genotype is a PLINK path."""
    if isinstance(genotype, (str, Path)) and genotypes.infer_format(str(genotype), options.get("genotype_format", "auto")) == "plink":
        return genotypes.family_ids(genotypes.plink_files(str(genotype), fam=options.get("fam"))[2])
    return {}
