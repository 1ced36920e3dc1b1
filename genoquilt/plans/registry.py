"""The registered queries over the driver's tables, and their SQL.

``embeddings`` serves as a cohort: rows are samples, array elements 0-47 markers, 48-55 traits and 56-58 covariates.
The star-schema tables serve as dosage sources and as tables to align. Results are rounded to six digits.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.statistics import correlation, standard_error, t_statistic
from ..functions.tails import chi_square_upper, negative_log10_col, student_t_two_sided
from ..operators import concordance, gram, layout, relatedness, scan, tables
from ..sources import genotypes, sinks
from . import api

MARKERS, TRAITS, COVARIATES = list(range(48)), list(range(48, 56)), [56, 57, 58]
RIDGE, TOP, LIMIT = 1e-6, 3, 0.05


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _six(c: str):
    return F.round(c, 6).alias(c)


@F.pandas_udf(T.DoubleType())
def _t_tail(t: pd.Series, n: pd.Series) -> pd.Series:
    out = np.full(len(t), np.nan)
    for k in n.unique():
        at = (n == k).to_numpy()
        out[at] = student_t_two_sided(t.to_numpy()[at], float(k) - 2)
    return pd.Series(out)


def _scan(spark, sf_dir, traits) -> DataFrame:
    """(marker, trait, n, beta, t_stat, se, p_value, nlog10_p): one pass over the samples, then a few rows a pair."""
    r = gram.correlations(read(spark, sf_dir, "embeddings"), "embedding", MARKERS, traits)
    out = r.select(F.col("i").alias("marker"), F.col("j").alias("trait"), "n", F.col("r").alias("beta")).withColumn("t_stat", t_statistic(F.col("beta"), F.col("n")))
    return out.withColumn("se", standard_error(F.col("beta"), F.col("t_stat"))).withColumn("p_value", _t_tail("t_stat", "n")).withColumn("nlog10_p", negative_log10_col(F.col("p_value")))


def linear_scan_basic(spark, sf_dir):
    return _scan(spark, sf_dir, TRAITS[:1]).select("marker", "n", *map(_six, ("beta", "t_stat", "se", "p_value", "nlog10_p")))


def linear_scan_multi_trait(spark, sf_dir):
    return _scan(spark, sf_dir, TRAITS).select("marker", "trait", "n", *map(_six, ("beta", "t_stat", "se")))


def _weights(spark, sf_dir, traits):
    """Means and projection weights of the covariate-adjusted traits; a k x k matrix reaches the driver."""
    columns = [*traits, *COVARIATES]
    mean, cov, n = gram.covariance_matrix(read(spark, sf_dir, "embeddings"), "embedding", columns)
    w = gram.residual_weights(cov, list(range(len(traits))), list(range(len(traits), len(columns))))
    return columns, mean, w, n


def linear_scan_with_covariates(spark, sf_dir):
    traits = TRAITS[:2]
    columns, _, w, _ = _weights(spark, sf_dir, traits)
    s = gram.cross_products(read(spark, sf_dir, "embeddings"), "embedding", MARKERS, columns)
    weights = spark.createDataFrame([(c, t, float(w[k, m])) for k, c in enumerate(columns) for m, t in enumerate(traits)], "j int, trait int, w double")
    part = (F.col("sxy") / F.col("n") - F.col("sx") / F.col("n") * F.col("sy") / F.col("n")) * F.col("w")
    sd = F.greatest(F.sqrt(F.col("sxx") / F.col("n") - F.pow(F.col("sx") / F.col("n"), 2)), F.lit(1e-12))
    r = s.join(F.broadcast(weights), "j").groupBy(F.col("i").alias("marker"), "trait", "n").agg((F.sum(part) / F.first(sd)).alias("beta"))
    return r.withColumn("t_stat", t_statistic(F.col("beta"), F.col("n"))).select("marker", "trait", "n", _six("beta"), _six("t_stat"))


def residualize_standardize(spark, sf_dir):
    columns, mean, w, _ = _weights(spark, sf_dir, TRAITS[:1])
    value = sum(((F.get("embedding", F.lit(c)).cast("double") - float(m)) * float(x) for c, m, x in zip(columns, mean, w[:, 0])), F.lit(0.0))
    return read(spark, sf_dir, "embeddings").select("vec_id", value.alias("y_hat")).select("vec_id", _six("y_hat"))


def genotype_standardize(spark, sf_dir):
    some = MARKERS
    mean, cov, _ = gram.covariance_matrix(read(spark, sf_dir, "embeddings"), "embedding", some)
    z = F.array(*(F.struct(F.lit(c).alias("marker"), ((F.get("embedding", F.lit(c)).cast("double") - float(m)) / max(float(v) ** 0.5, 1e-12)).alias("z")) for c, m, v in zip(some, mean, np.diag(cov))))
    return read(spark, sf_dir, "embeddings").select("vec_id", F.inline(z)).select("vec_id", "marker", _six("z"))


def p_value_threshold(spark, sf_dir):
    return _scan(spark, sf_dir, TRAITS).where(F.col("p_value") <= LIMIT).select("marker", "trait", _six("p_value"))


def _best(df: DataFrame) -> DataFrame:
    named = df.select(F.col("marker").cast("long").alias("marker_idx"), F.col("trait").alias("trait_idx"), F.col("nlog10_p").alias("-log10_p"), "t_stat")
    return scan.top_per_trait(named, TOP).select(F.col("marker_idx").alias("marker"), F.col("trait_idx").alias("trait"), F.round("-log10_p", 6).alias("nlog10_p"))


def topk_per_trait(spark, sf_dir):
    return _best(_scan(spark, sf_dir, TRAITS))


def threshold_then_topk(spark, sf_dir):
    return _best(_scan(spark, sf_dir, TRAITS).where(F.col("p_value") <= LIMIT))


def top_hit(spark, sf_dir):
    named = _scan(spark, sf_dir, TRAITS).withColumnsRenamed({"marker": "marker_idx", "trait": "trait_idx", "nlog10_p": "-log10_p"})
    return scan.top_hit(named).select(F.col("marker_idx").alias("marker"), F.col("trait_idx").alias("trait"), _six("beta"), F.round("-log10_p", 6).alias("nlog10_p"))


def _cohort(spark, sf_dir, traits) -> tuple[DataFrame, scan.Prepared]:
    """The marker-major form, with the traits on the driver as the block scan has them."""
    df = read(spark, sf_dir, "embeddings")
    rows = df.select("vec_id", F.array(*(F.get("embedding", F.lit(t)).cast("double") for t in traits)).alias("y")).orderBy("vec_id").collect()
    y, _ = scan.residualise(np.array([r["y"] for r in rows], float), None)
    return layout.markers_from_arrays(df, "vec_id", "embedding", MARKERS), scan.Prepared(y, None, [f"trait_{t}" for t in traits])


def multivariate_scan(spark, sf_dir):
    found, _, _ = scan.multivariate_scan(*_cohort(spark, sf_dir, TRAITS[:2]), RIDGE)
    return found.select(F.col("marker_idx").alias("marker"), "n_traits", "df", F.round("chi2", 6).alias("chi2"), F.round("p_value", 6).alias("p_value"))


def phenotype_correlation(spark, sf_dir):
    s = gram.cross_products(read(spark, sf_dir, "embeddings"), "embedding", TRAITS, TRAITS)
    mean = lambda c: F.col(c) / F.col("n")
    r = (mean("sxy") - mean("sx") * mean("sy")) / F.sqrt((mean("sxx") - mean("sx") * mean("sx")) * (mean("syy") - mean("sy") * mean("sy")))
    return s.select(F.col("i").alias("trait_a"), F.col("j").alias("trait_b"), F.round(r + F.when(F.col("i") == F.col("j"), RIDGE).otherwise(0.0), 6).alias("r"))


def concordance_native_vs_block(spark, sf_dir):
    native = _scan(spark, sf_dir, TRAITS[:1]).select(F.col("marker").cast("long").alias("marker_idx"), "p_value")
    block = scan.linear_scan(*_cohort(spark, sf_dir, TRAITS[:1]))
    found = concordance.agreement(native, block, "marker_idx")
    return found.select("n", *map(_six, ("pearson_r", "mean_abs_diff", "max_abs_diff")))


def _cells(spark, sf_dir) -> DataFrame:
    """(customer, brand, n): lines of each customer and brand."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    lines = lines.join(read(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return lines.groupBy(F.col("o_custkey").alias("c_custkey"), F.col("p_brand").alias("brand")).agg(F.count(F.lit(1)).alias("n"))


def dosage_matrix(spark, sf_dir):
    """How many customers have dosage 0, 1 and 2 of each brand: least(lines, 2), absent cells 0."""
    customers = read(spark, sf_dir, "customer").select("c_custkey")
    cells = customers.join(_cells(spark, sf_dir), "c_custkey")
    counts = cells.groupBy("brand").agg(F.count_if(F.col("n") == 1).alias("dosage_1"), F.count_if(F.col("n") >= 2).alias("dosage_2"))
    return counts.join(F.broadcast(customers.agg(F.count(F.lit(1)).alias("total"))), how="inner", on=F.lit(True)).select("brand", (F.col("total") - F.col("dosage_1") - F.col("dosage_2")).alias("dosage_0"), "dosage_1", "dosage_2")


def linear_scan_star(spark, sf_dir):
    """Brands as markers, customers as samples, account balance as trait: absent cells add nothing to the sums."""
    customers = read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    g = F.least("n", F.lit(2)).cast("double")
    sums = customers.join(_cells(spark, sf_dir), "c_custkey").groupBy("brand").agg(F.sum(g).alias("sx"), F.sum(g * g).alias("sxx"), F.sum(g * F.col("c_acctbal")).alias("sxy"))
    whole = customers.agg(F.count(F.lit(1)).alias("n"), F.sum("c_acctbal").alias("sy"), F.sum(F.col("c_acctbal") * F.col("c_acctbal")).alias("syy"))
    r = sums.join(F.broadcast(whole), on=F.lit(True)).withColumn("beta", correlation(*(F.col(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy"))))
    return r.withColumn("t_stat", t_statistic(F.col("beta"), F.col("n"))).select("brand", "n", _six("beta"), _six("t_stat"))


def _customers(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("idx"), F.col("c_custkey").cast("string").alias("id"))


def _orders(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("IID"), "o_orderkey", "o_totalprice")


def align_left_ordered(spark, sf_dir):
    out, _ = tables.align(_customers(spark, sf_dir), _orders(spark, sf_dir), "IID", ["o_totalprice"], order=["o_orderkey", "o_totalprice"], check=False)
    return out.select("idx", "id", "o_totalprice")


def align_missing_ids(spark, sf_dir):
    late = read(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("IID"))
    return tables.missing_ids(_customers(spark, sf_dir), late, "IID")


def dedup_keep_first(spark, sf_dir):
    order = ["l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity"]
    return tables.keep_first(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], order).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def id_intersection(spark, sf_dir):
    done = read(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return tables.intersect_in_order(_customers(spark, sf_dir), (done, "o_custkey"), (read(spark, sf_dir, "events"), "user_id"))


def filter_to_ids(spark, sf_dir):
    keep = read(spark, sf_dir, "events").select(F.col("user_id").alias("idx")).distinct().withColumn("id", F.col("idx").cast("string"))
    return tables.filter_to_ids(_orders(spark, sf_dir), keep, "IID", False, ["o_orderkey", "o_totalprice"]).select("idx", "o_orderkey", "o_totalprice")


def _with_constant(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.concat(F.col("embedding").cast("array<double>"), F.array(F.lit(1.0))).alias("x"))


def qc_zero_variance(spark, sf_dir):
    s = gram.cross_products(_with_constant(spark, sf_dir), "x", [*MARKERS, 64], [64])
    variance = F.col("sxx") / F.col("n") - F.pow(F.col("sx") / F.col("n"), 2)
    return s.select(F.col("i").alias("marker"), (variance > 1e-15).alias("kept"))


def qc_counts(spark, sf_dir):
    return qc_zero_variance(spark, sf_dir).agg(F.count(F.lit(1)).alias("columns_input"), F.count_if("kept").alias("columns_kept"), F.count_if(~F.col("kept")).alias("columns_dropped"))


def missing_check(spark, sf_dir):
    return tables.missing_counts(read(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


def complete_case(spark, sf_dir):
    worth = read(spark, sf_dir, "events").groupBy("user_id").agg(F.max("value").alias("top_value"))
    both = read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal").join(worth, F.col("c_custkey") == F.col("user_id"), "left")
    return tables.complete_cases(both, ["c_acctbal", "top_value"]).select("c_custkey", "c_acctbal", "top_value")


def tables_union_dedup(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    return tables.concat_tables(events.where("event_id % 2 = 0"), events.where("event_id % 2 = 1"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


def chi_square_tail(spark, sf_dir):
    tail = F.pandas_udf(lambda x: pd.Series(chi_square_upper(x.to_numpy(), 4)), "double")
    return read(spark, sf_dir, "part").select(F.col("p_size").cast("double").alias("chi2")).distinct().withColumn("p", tail("chi2")).select("chi2", F.round("p", 9).alias("p_value"), F.round(negative_log10_col(F.col("p")), 6).alias("nlog10_p"))


def _supplier_dosages(spark, sf_dir) -> tuple[DataFrame, int, list]:
    """Suppliers as samples, brands as markers; dosage: lines modulo 3."""
    ids = [r[0] for r in read(spark, sf_dir, "supplier").select("s_suppkey").orderBy("s_suppkey").collect()]  # sample ids: n, as for every genotype
    index = spark.createDataFrame(list(enumerate(ids)), "idx int, l_suppkey long")
    lines = read(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").join(read(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    cells = lines.groupBy("l_suppkey", "p_brand").agg((F.count(F.lit(1)) % 3).alias("d")).join(index, "l_suppkey")
    return layout.markers_from_long(cells, "idx", "p_brand", "d", len(ids)), len(ids), ids


def king_kinship_pairs(spark, sf_dir):
    markers, n, ids = _supplier_dosages(spark, sf_dir)
    index = spark.createDataFrame(list(enumerate(ids)), "idx long, id long")
    pairs = relatedness.kinship_pairs(markers, n)
    pairs = pairs.join(F.broadcast(index.toDF("i", "id_i")), "i").join(F.broadcast(index.toDF("j", "id_j")), "j")
    return pairs.select("id_i", "id_j", "n_het_i", "n_het_j", "n_hethet", "n_homopp", F.round("phi", 6).alias("phi"))


def unrelated_subset(spark, sf_dir):
    markers, n, ids = _supplier_dosages(spark, sf_dir)
    cutoff = relatedness.THRESHOLDS["second"]
    keep = relatedness.unrelated(relatedness.kinship_pairs(markers, n, cutoff), n, cutoff)
    return spark.createDataFrame([(ids[i],) for i in keep], "s_suppkey long")


def _supplier_files(spark, sf_dir) -> tuple[str, str, list[str]]:
    """The suppliers' dosages as a .npy and a .bed file in the shared folder, and the brands in their order. One file has
    one writer, so its matrix is on the driver."""
    markers, _, ids = _supplier_dosages(spark, sf_dir)
    rows = markers.orderBy("marker_id").collect()
    dosages, folder = np.array([r["g"] for r in rows], float).T.reshape(len(ids), len(rows)), sinks.shared_folder(spark)
    sinks.write_artefact(dosages, folder / "suppliers.npy")
    brands = [r["marker_id"] for r in rows]
    return str(folder / "suppliers.npy"), sinks.write_plink(dosages, brands, list(map(str, ids)), folder / "suppliers"), brands


def _dosage_counts(markers: DataFrame) -> DataFrame:
    counts = [(F.size("g") - F.size(F.array_remove("g", float(k)))).alias(f"dosage_{k}") for k in (0, 1, 2)]
    return markers.select("marker_idx", "marker_id", *counts)


def source_npy(spark, sf_dir):
    """An array file, its format inferred from its name."""
    return _dosage_counts(genotypes.open_genotype(spark, _supplier_files(spark, sf_dir)[0]).markers)


def source_plink(spark, sf_dir):
    return _dosage_counts(genotypes.open_genotype(spark, _supplier_files(spark, sf_dir)[1]).markers)


def _supplier_traits(spark, sf_dir) -> DataFrame:
    """A trait table in no order, with ids that the genotype lacks."""
    traits = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("IID"), F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation"))
    return traits.unionByName(traits.withColumn("IID", F.concat(F.lit("other"), "IID")))


def _exported(folder) -> DataFrame:
    spark = SparkSession.getActiveSession()
    return spark.read.option("sep", "\t").option("header", True).schema("marker_id string, trait string, n long, p_value double, `-log10_p` double, beta double, t_stat double, se double").csv(f"file://{folder}/results")


def api_linear_exported(spark, sf_dir):
    """``run_linear`` from a .bed and a trait table to the folder of parts that its tasks write, read back."""
    _, bed, _ = _supplier_files(spark, sf_dir)
    out = sinks.shared_folder(spark)
    api.run_linear(spark, bed, phenotype_table=_supplier_traits(spark, sf_dir), trait_columns=["balance", "nation"], compute_dtype="float64", drop_monomorphic=True, output_dir=out)
    return _exported(out).select("marker_id", "trait", "n", _six("beta"), _six("t_stat"))


def api_unrelated_exported(spark, sf_dir):
    """``run_unrelated``: the same scan after pruning relatives."""
    _, bed, _ = _supplier_files(spark, sf_dir)
    out = sinks.shared_folder(spark)
    api.run_unrelated(spark, bed, relatedness.THRESHOLDS["second"], out, phenotype_table=_supplier_traits(spark, sf_dir), trait_columns=["balance", "nation"], compute_dtype="float64", drop_monomorphic=True)
    return _exported(out).select("marker_id", "trait", "n", _six("beta"), _six("t_stat"))


def api_multivariate(spark, sf_dir):
    """``run_multivariate`` from a marker table and a trait table."""
    df = read(spark, sf_dir, "embeddings")
    ids = [str(r[0]) for r in df.select("vec_id").orderBy("vec_id").collect()]  # sample ids, as for every genotype
    traits = df.select(F.col("vec_id").cast("string").alias("IID"), *(F.get("embedding", F.lit(t)).cast("double").alias(f"trait_{t}") for t in TRAITS[:2]))
    markers = layout.markers_from_arrays(df, "vec_id", "embedding", MARKERS)
    found = api.run_multivariate(spark, markers, phenotype_table=traits, sample_ids=ids, ridge=RIDGE).table
    return found.select("marker_id", "n_traits", "df", _six("chi2"), _six("p_value"))


_NAMES = [
    linear_scan_basic, linear_scan_multi_trait, linear_scan_with_covariates, residualize_standardize, genotype_standardize, p_value_threshold, topk_per_trait, threshold_then_topk, top_hit,
    multivariate_scan, phenotype_correlation, concordance_native_vs_block, dosage_matrix, linear_scan_star, align_left_ordered, align_missing_ids, dedup_keep_first, id_intersection, filter_to_ids,
    qc_zero_variance, qc_counts, missing_check, complete_case, tables_union_dedup, chi_square_tail, king_kinship_pairs, unrelated_subset, source_npy, source_plink,
    api_linear_exported, api_unrelated_exported, api_multivariate,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _NAMES}


# -- SQL ------------------------------------------------------------------------------------------------
_CELLS = "cells AS (SELECT vec_id, unnest(range(0, 64)) AS k, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"
_PAIRS = """pairs AS (
  SELECT g.k AS marker, y.k AS trait, count(*) AS n, (avg(g.x * y.x) - avg(g.x) * avg(y.x)) / (stddev_pop(g.x) * stddev_pop(y.x)) AS beta
  FROM cells g JOIN cells y USING (vec_id) WHERE g.k < 48 AND y.k BETWEEN 48 AND {last} GROUP BY 1, 2),
tested AS (SELECT *, beta * sqrt((n - 2) / (1 - beta * beta)) AS t_stat FROM pairs)"""
#: 1 - I_y(1/2, df/2), y = t^2 / (df + t^2), by its hypergeometric series: exact to about 1e-12 at these |t|.
_TAIL = """CASE WHEN t_stat = 0 THEN 1.0 ELSE 1 - list_sum(list_transform(range(0, 400), lambda j: exp(
  lgamma((n - 2) / 2 + 0.5 + j) - lgamma((n - 2) / 2) - lgamma(1.5 + j) + (0.5 + j) * ln(t_stat * t_stat / (n - 2 + t_stat * t_stat)) + (n - 2) / 2 * ln((n - 2) / (n - 2 + t_stat * t_stat))))) END"""


def _tested(last: int) -> str:
    return f"WITH {_CELLS}, {_PAIRS.format(last=last)}, scanned AS (SELECT *, abs(beta) / abs(t_stat) AS se, {_TAIL} AS p FROM tested)"


def _steps(extra: str) -> str:
    """The trait without its covariates, one covariate after the other."""
    return f"""WITH s0 AS (SELECT vec_id, embedding[49]::DOUBLE AS y, embedding[50]::DOUBLE AS z, embedding[57]::DOUBLE AS a, embedding[58]::DOUBLE AS b, embedding[59]::DOUBLE AS c FROM embeddings),
s1 AS (SELECT vec_id, y - avg(y) OVER () AS y, z - avg(z) OVER () AS z, a - avg(a) OVER () AS a, b - avg(b) OVER () AS b, c - avg(c) OVER () AS c FROM s0),
s2 AS (SELECT vec_id, y - a * (sum(a * y) OVER () / sum(a * a) OVER ()) AS y, z - a * (sum(a * z) OVER () / sum(a * a) OVER ()) AS z, b - a * (sum(a * b) OVER () / sum(a * a) OVER ()) AS b, c - a * (sum(a * c) OVER () / sum(a * a) OVER ()) AS c FROM s1),
s3 AS (SELECT vec_id, y - b * (sum(b * y) OVER () / sum(b * b) OVER ()) AS y, z - b * (sum(b * z) OVER () / sum(b * b) OVER ()) AS z, c - b * (sum(b * c) OVER () / sum(b * b) OVER ()) AS c FROM s2),
s4 AS (SELECT vec_id, y - c * (sum(c * y) OVER () / sum(c * c) OVER ()) AS y, z - c * (sum(c * z) OVER () / sum(c * c) OVER ()) AS z FROM s3),
s5 AS (SELECT vec_id, y / stddev_pop(y) OVER () AS y, z / stddev_pop(z) OVER () AS z FROM s4){extra}"""


_BRANDS = "cells AS (SELECT o_custkey AS c_custkey, p_brand AS brand, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"


#: Dosages d and counts k of pairs of suppliers.
_KINSHIP = """brands AS (SELECT DISTINCT p_brand AS b FROM part JOIN lineitem ON l_partkey = p_partkey),
d AS (SELECT s_suppkey AS s, b, coalesce(n, 0) % 3 AS g FROM supplier CROSS JOIN brands LEFT JOIN (SELECT l_suppkey, p_brand, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) ON l_suppkey = s_suppkey AND p_brand = b),
k AS (SELECT x.s AS id_i, y.s AS id_j, count(*) FILTER (x.g = 1) AS n_het_i, count(*) FILTER (y.g = 1) AS n_het_j, count(*) FILTER (x.g = 1 AND y.g = 1) AS n_hethet, count(*) FILTER (abs(x.g - y.g) = 2) AS n_homopp
  FROM d x JOIN d y ON x.b = y.b AND x.s < y.s GROUP BY 1, 2)"""
#: While related pairs are left, the supplier in most of them goes, of equals the last.
_PRUNED = """related AS (
  SELECT id_i, id_j FROM k WHERE least(n_het_i, n_het_j) > 0
  AND (n_hethet - 2 * n_homopp) / (2 * least(n_het_i, n_het_j)) + 0.5 - (n_het_i + n_het_j) / (4 * least(n_het_i, n_het_j)) > 0.0884),
links AS (SELECT id_i AS a, id_j AS b FROM related UNION ALL SELECT id_j, id_i FROM related),
pruning AS (
  SELECT CAST([] AS BIGINT[]) AS gone, 0 AS steps
  UNION ALL
  SELECT list_append(gone, (SELECT arg_max(a, (c, a)) FROM (
    SELECT a, count(*) AS c FROM links WHERE NOT list_contains(pruning.gone, a) AND NOT list_contains(pruning.gone, b) GROUP BY a))), steps + 1
  FROM pruning WHERE EXISTS (SELECT 1 FROM links WHERE NOT list_contains(pruning.gone, a) AND NOT list_contains(pruning.gone, b))),
kept AS (SELECT s_suppkey FROM supplier WHERE NOT list_contains((SELECT arg_max(gone, steps) FROM pruning), s_suppkey))"""
#: Brands against two traits of the kept suppliers; brands without variance are left out.
_KEPT_SCAN = """traits AS (
  SELECT s_suppkey AS s, 'balance' AS trait, CAST(s_acctbal AS DOUBLE) AS y FROM supplier UNION ALL SELECT s_suppkey, 'nation', CAST(s_nationkey AS DOUBLE) FROM supplier),
r AS (
  SELECT b AS marker_id, trait, count(*) AS n, (avg(g * y) - avg(g) * avg(y)) / (stddev_pop(g) * stddev_pop(y)) AS beta
  FROM d JOIN traits USING (s) WHERE s IN (SELECT s_suppkey FROM kept) GROUP BY 1, 2 HAVING stddev_pop(g) > 0)
SELECT marker_id, trait, n, round(beta, 6) AS beta, round(beta * sqrt((n - 2) / (1 - beta * beta)), 6) AS t_stat FROM r"""
_SUPPLIERS = f"""WITH {_KINSHIP}, counted AS (
  SELECT row_number() OVER (ORDER BY b) - 1 AS marker_idx, b, CAST(count(*) FILTER (g = 0) AS INTEGER) AS dosage_0,
    CAST(count(*) FILTER (g = 1) AS INTEGER) AS dosage_1, CAST(count(*) FILTER (g = 2) AS INTEGER) AS dosage_2 FROM d GROUP BY b)
"""


def _joint(marker: str) -> str:
    """The joint test of two traits: the inverse of their correlation matrix is written out."""
    return f"""{_tested(49)}, c AS (SELECT corr(a.x, b.x) AS r FROM cells a JOIN cells b USING (vec_id) WHERE a.k = 48 AND b.k = 49),
z AS (SELECT marker, max(t_stat) FILTER (trait = 48) AS u, max(t_stat) FILTER (trait = 49) AS v FROM scanned GROUP BY 1),
q AS (SELECT marker, ((1 + {RIDGE}) * (u * u + v * v) - 2 * r * u * v) / ((1 + {RIDGE}) * (1 + {RIDGE}) - r * r) AS chi2 FROM z CROSS JOIN c)
SELECT {marker}, CAST(2 AS INTEGER) AS n_traits, CAST(2 AS INTEGER) AS df, round(chi2, 6) AS chi2, round(exp(-chi2 / 2), 6) AS p_value FROM q"""


def oracle_sql() -> dict[str, str]:
    top = "row_number() OVER (PARTITION BY trait ORDER BY p, abs(t_stat) DESC, marker)"
    return {
        "linear_scan_basic": f"{_tested(48)} SELECT CAST(marker AS INTEGER) AS marker, n, round(beta, 6) AS beta, round(t_stat, 6) AS t_stat, round(se, 6) AS se, round(p, 6) AS p_value, round(-log10(p), 6) AS nlog10_p FROM scanned",
        "linear_scan_multi_trait": f"{_tested(55)} SELECT CAST(marker AS INTEGER) AS marker, CAST(trait AS INTEGER) AS trait, n, round(beta, 6) AS beta, round(t_stat, 6) AS t_stat, round(se, 6) AS se FROM scanned",
        "linear_scan_with_covariates": _steps(f""", {_CELLS}, traits AS (SELECT vec_id, 48 AS trait, y FROM s5 UNION ALL SELECT vec_id, 49, z FROM s5),
r AS (SELECT CAST(k AS INTEGER) AS marker, trait, count(*) AS n, avg(x * y) / stddev_pop(x) AS beta FROM cells JOIN traits USING (vec_id) WHERE k < 48 GROUP BY 1, 2)
SELECT marker, trait, n, round(beta, 6) AS beta, round(beta * sqrt((n - 2) / (1 - beta * beta)), 6) AS t_stat FROM r"""),
        "residualize_standardize": _steps(" SELECT vec_id, round(y, 6) AS y_hat FROM s5"),
        "genotype_standardize": f"WITH {_CELLS} SELECT vec_id, CAST(k AS INTEGER) AS marker, round((x - avg(x) OVER (PARTITION BY k)) / stddev_pop(x) OVER (PARTITION BY k), 6) AS z FROM cells WHERE k < 48",
        "p_value_threshold": f"{_tested(55)} SELECT CAST(marker AS INTEGER) AS marker, CAST(trait AS INTEGER) AS trait, round(p, 6) AS p_value FROM scanned WHERE p <= {LIMIT}",
        "topk_per_trait": f"{_tested(55)} SELECT marker, CAST(trait AS INTEGER) AS trait, round(-log10(p), 6) AS nlog10_p FROM scanned QUALIFY {top} <= {TOP}",
        "threshold_then_topk": f"{_tested(55)} SELECT marker, CAST(trait AS INTEGER) AS trait, round(-log10(p), 6) AS nlog10_p FROM scanned WHERE p <= {LIMIT} QUALIFY {top} <= {TOP}",
        "top_hit": f"{_tested(55)} SELECT CAST(marker AS INTEGER) AS marker, CAST(trait AS INTEGER) AS trait, round(beta, 6) AS beta, round(-log10(p), 6) AS nlog10_p FROM scanned ORDER BY p, marker, trait LIMIT 1",
        "multivariate_scan": _joint("marker"),
        "phenotype_correlation": f"WITH {_CELLS} SELECT CAST(a.k AS INTEGER) AS trait_a, CAST(b.k AS INTEGER) AS trait_b, round(corr(a.x, b.x) + CASE WHEN a.k = b.k THEN {RIDGE} ELSE 0 END, 6) AS r FROM cells a JOIN cells b USING (vec_id) WHERE a.k BETWEEN 48 AND 55 AND b.k BETWEEN 48 AND 55 GROUP BY a.k, b.k",
        "concordance_native_vs_block": f"""{_tested(48)}, again AS (
  SELECT g.k AS marker, count(*) AS n, corr(g.x, y.x) AS r FROM cells g JOIN cells y USING (vec_id) WHERE g.k < 48 AND y.k = 48 GROUP BY 1),
tested_again AS (SELECT marker, n, r * sqrt((n - 2) / (1 - r * r)) AS t_stat FROM again), other AS (SELECT marker, {_TAIL} AS p FROM tested_again),
both_p AS (SELECT -log10(scanned.p) AS a, -log10(other.p) AS b FROM scanned JOIN other USING (marker))
SELECT count(*) AS n, round(corr(a, b), 6) AS pearson_r, round(avg(abs(a - b)), 6) AS mean_abs_diff, round(max(abs(a - b)), 6) AS max_abs_diff FROM both_p""",
        "dosage_matrix": f"WITH {_BRANDS} SELECT brand, (SELECT count(*) FROM customer) - count(*) AS dosage_0, count(*) FILTER (n = 1) AS dosage_1, count(*) FILTER (n >= 2) AS dosage_2 FROM cells JOIN customer USING (c_custkey) GROUP BY 1",
        "linear_scan_star": f"""WITH {_BRANDS}, grid AS (SELECT b.brand, c.c_custkey, c.c_acctbal AS y, CAST(least(coalesce(n, 0), 2) AS DOUBLE) AS g FROM customer c CROSS JOIN (SELECT DISTINCT brand FROM cells) b LEFT JOIN cells USING (c_custkey, brand)),
r AS (SELECT brand, count(*) AS n, (avg(g * y) - avg(g) * avg(y)) / (stddev_pop(g) * stddev_pop(y)) AS beta FROM grid GROUP BY 1)
SELECT brand, n, round(beta, 6) AS beta, round(beta * sqrt((n - 2) / (1 - beta * beta)), 6) AS t_stat FROM r""",
        "align_left_ordered": "SELECT c_custkey AS idx, CAST(c_custkey AS VARCHAR) AS id, o_totalprice FROM customer LEFT JOIN (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, o_totalprice) = 1) ON c_custkey = o_custkey",
        "align_missing_ids": "SELECT c_custkey AS idx, CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')",
        "dedup_keep_first": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity) = 1",
        "id_intersection": "SELECT c_custkey AS idx, CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AND c_custkey IN (SELECT user_id FROM events)",
        "filter_to_ids": "SELECT o_custkey AS idx, o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT user_id FROM events) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, o_totalprice) = 1",
        "qc_zero_variance": f"WITH {_CELLS} SELECT CAST(k AS INTEGER) AS marker, stddev_pop(x) > 0 AS kept FROM cells WHERE k < 48 GROUP BY k UNION ALL SELECT CAST(64 AS INTEGER), false",
        "qc_counts": f"""WITH {_CELLS}, spread AS (SELECT k, stddev_pop(x) > 0 AS kept FROM cells WHERE k < 48 GROUP BY k UNION ALL SELECT 64, stddev_pop(1.0) > 0 FROM embeddings)
SELECT count(*) AS columns_input, count(*) FILTER (kept) AS columns_kept, count(*) FILTER (NOT kept) AS columns_dropped FROM spread""",
        "missing_check": "SELECT " + ", ".join(f"count(*) FILTER ({c} IS NULL OR isnan({c})) AS {c}" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")) + " FROM lineitem",
        "complete_case": "SELECT c_custkey, c_acctbal, max(value) AS top_value FROM customer JOIN events ON c_custkey = user_id WHERE c_acctbal IS NOT NULL GROUP BY 1, 2 HAVING max(value) IS NOT NULL",
        "tables_union_dedup": "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id % 2, ts, event_id) = 1",
        "chi_square_tail": "SELECT DISTINCT CAST(p_size AS DOUBLE) AS chi2, round(exp(-p_size / 2) * (1 + p_size / 2), 9) AS p_value, round(-log10(exp(-p_size / 2) * (1 + p_size / 2)), 6) AS nlog10_p FROM part",
        "king_kinship_pairs": f"""WITH {_KINSHIP}
SELECT *, CASE WHEN least(n_het_i, n_het_j) > 0 THEN round((n_hethet - 2 * n_homopp) / (2 * least(n_het_i, n_het_j)) + 0.5 - (n_het_i + n_het_j) / (4 * least(n_het_i, n_het_j)), 6) END AS phi FROM k""",
        "unrelated_subset": f"WITH RECURSIVE {_KINSHIP}, {_PRUNED} SELECT s_suppkey FROM kept",
        "source_npy": _SUPPLIERS + "SELECT marker_idx, 'marker_' || marker_idx AS marker_id, dosage_0, dosage_1, dosage_2 FROM counted",
        "source_plink": _SUPPLIERS + "SELECT marker_idx, b AS marker_id, dosage_0, dosage_1, dosage_2 FROM counted",
        "api_linear_exported": f"WITH {_KINSHIP}, kept AS (SELECT s_suppkey FROM supplier), {_KEPT_SCAN}",
        "api_unrelated_exported": f"WITH RECURSIVE {_KINSHIP}, {_PRUNED}, {_KEPT_SCAN}",
        "api_multivariate": _joint("'marker_' || marker AS marker_id"),
    }
