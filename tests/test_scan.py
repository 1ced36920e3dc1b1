"""Scans, preparation and tails against numpy and published golden values."""

import gzip
import json
import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from genoquilt import run_linear, run_multivariate, toy_dataset
from genoquilt.functions import tails
from genoquilt.operators import concordance, gram, layout, relatedness, scan, tables
from genoquilt.plans import cli, fixtures
from genoquilt.plans.api import run_unrelated
from genoquilt.sources import genotypes, sinks
from genoquilt.streaming.markers import stream_linear_scan


def test_tails():
    assert tails.student_t_two_sided(12.40754325204671, 62)[0] == pytest.approx(1.880010459522755e-18, rel=1e-12)
    assert tails.student_t_two_sided([0.0, np.inf, np.nan], 5)[:2].tolist() == [1.0, 0.0]
    assert tails.student_t_two_sided(1.0, 1)[0] == pytest.approx(0.5, rel=1e-14) and tails.student_t_two_sided(1e-3, 2)[0] == pytest.approx(1 - 1e-3 / np.sqrt(2 + 1e-6), rel=1e-12)
    assert np.isnan(tails.student_t_two_sided(1.0, 0)[0])
    assert tails.chi_square_upper(155.29555326819616, 3)[0] == pytest.approx(1.8979671486528213e-33, rel=1e-12)
    assert tails.chi_square_upper([0.0, 2.0], 2).tolist() == pytest.approx([1.0, np.exp(-1)])
    assert tails.negative_log10([0.0, 1.0])[0] == pytest.approx(307.652655568588, rel=1e-12)


def test_tails_at_large_degrees_of_freedom():
    """Against the closed forms of whole degrees of freedom, and against the expansion by the normal tail."""
    t = np.array([1e-3, 0.5, 1.0, 1.7, 1.74, 3.0, 8.0, 30.0])
    assert tails.student_t_two_sided(t, 2) == pytest.approx(2 / ((2 + t * t) * (1 + t / np.sqrt(2 + t * t))), rel=1e-12)
    for df in (4094, 20_000):
        for x in (0.3, 1.7, 2.5, 6.0):
            steps = np.linspace(x, x + 12, 400_001)  # Simpson's rule on the density
            density = np.exp(-(df + 1) / 2 * np.log1p(steps**2 / df)) * tails._half_gamma_ratio(df / 2) / np.sqrt(np.pi * df)
            area = (density[0] + density[-1] + 4 * density[1::2].sum() + 2 * density[2:-1:2].sum()) * (steps[1] - steps[0]) / 3
            assert tails.student_t_two_sided(x, df)[0] == pytest.approx(2 * area, rel=1e-11)
    for p in (0.9, 0.05, 5e-8, 1e-200):
        c = tails.critical_t(p, 500)
        assert tails.student_t_two_sided(c, 500)[0] == pytest.approx(p, rel=1e-8) and tails.student_t_two_sided(c, 500)[0] >= p
    assert tails.chi_square_upper([1.0, 4.0, 30.0], 1) == pytest.approx([math.erfc(math.sqrt(x / 2)) for x in (1.0, 4.0, 30.0)], rel=1e-12)
    assert tails.chi_square_upper([0.0, np.inf, np.nan], 3)[:2].tolist() == [1.0, 0.0]


def brute(g, y, c):
    y = y - y.mean(0)
    if c is not None:
        c = c - c.mean(0)
        y = y - c @ np.linalg.lstsq(c, y, rcond=None)[0]
    y = y / y.std(0)
    z = (g - g.mean(0)) / g.std(0)
    r = z.T @ y / len(y)
    return r, r * np.sqrt((len(y) - 2) / (1 - r * r))


def test_toy_linear_and_multivariate_goldens(spark, tmp_path):
    toy = fixtures.toy_cohort()
    common = dict(phenotype=toy["phenotype"], covariates=toy["covariates"], marker_ids=toy["marker_ids"], sample_ids=toy["sample_ids"], distributed_output=False)
    out = run_linear(spark, toy["genotype"], output_dir=tmp_path / "linear", **common)
    rows = out.table.collect()
    assert len(rows) == 36 and out.table.columns == ["marker_id", "trait", "n", "p_value", "-log10_p", "beta", "t_stat", "se"]
    r, t = brute(toy["genotype"], toy["phenotype"], toy["covariates"])
    for row in rows:
        i, j = int(row["marker_id"][-3:]), int(row["trait"][-1])
        assert row["beta"] == pytest.approx(r[i, j], rel=1e-9) and row["t_stat"] == pytest.approx(t[i, j], rel=1e-9) and row["se"] == pytest.approx(abs(r[i, j] / t[i, j]))
    best = max(rows, key=lambda x: x["-log10_p"])
    assert (best["marker_id"], best["trait"]) == ("rsToy002", "trait_0") and best["t_stat"] == pytest.approx(12.40754325204671, rel=1e-10) and best["p_value"] == pytest.approx(1.880010459522755e-18, rel=1e-9)
    with gzip.open(tmp_path / "linear/results.tsv.gz", "rt") as f:
        lines = f.read().splitlines()
    assert len(lines) == 37 and lines[1].startswith("rsToy000\ttrait_0\t64\t")
    meta = json.loads((tmp_path / "linear/run.json").read_text())
    assert meta["n_result_rows"] == 36 and meta["genotype_shape"] == [64, 12] and meta["q_matrix_shape"] == [64, 4] and json.loads((tmp_path / "linear/qc.json").read_text())["genotype_columns_kept"] == 12
    multi = run_multivariate(spark, toy["genotype"], output_dir=tmp_path / "multi", **common)
    top = max(multi.table.collect(), key=lambda x: x["-log10_p"])
    assert top["marker_id"] == "rsToy002" and top["chi2"] == pytest.approx(155.29555326819616, rel=1e-9) and top["p_value"] == pytest.approx(1.8979671486528213e-33, rel=1e-8)
    assert multi.phenotype_correlation[0][0] == pytest.approx(1 + 1e-6) and (tmp_path / "multi/phenotype_correlation.json").exists()


def test_thresholds_limits_and_drops(spark, tmp_path):
    toy = fixtures.toy_cohort()
    g = np.column_stack([np.ones(64), toy["genotype"]])
    y = np.column_stack([toy["phenotype"], np.ones(64)])
    every = run_linear(spark, g, y).table.collect()
    assert len(every) == 36 and {r["marker_id"] for r in every} == {f"marker_{i}" for i in range(1, 13)} and {r["trait"] for r in every} == {"trait_0", "trait_1", "trait_2"}
    assert run_linear(spark, g, y).qc_summary["dropped_phenotype_columns"] == 1
    kept = run_linear(spark, g, y, drop_monomorphic=False).table.where("marker_id = 'marker_0'").collect()
    assert len(kept) == 3 and all(r["p_value"] == 1 and r["t_stat"] == 0 and np.isnan(r["se"]) for r in kept)
    few = run_linear(spark, g, y, p_value_threshold=1e-4, topk_per_trait=1, output_dir=tmp_path)
    assert few.table.count() == 3 and few.run_metadata["n_result_rows"] == 3
    assert run_linear(spark, g, y, p_value_threshold=1e-300, output_dir=tmp_path / "none").run_metadata["n_result_rows"] == 0
    same = run_linear(spark, np.column_stack([toy["genotype"][:, 2]] * 4), toy["phenotype"], topk_per_trait=2).table.collect()
    assert len(same) == 6 and {r["marker_id"] for r in same} == {"marker_0", "marker_1"}
    parts = spark.read.csv(str(tmp_path / "results"), sep="\t", header=True)
    assert parts.count() == 3 and parts.columns == few.table.columns and not (tmp_path / "results.tsv.gz").exists()
    assert run_linear(spark, g, y, chunk_size=3, topk_per_trait=2).table.count() == 6
    f32 = run_linear(spark, g, y, compute_dtype="float32").table.agg(F.max("-log10_p")).first()[0]
    assert f32 == pytest.approx(max(r["-log10_p"] for r in every), rel=1e-4)
    one = run_multivariate(spark, g, y[:, 0]).table.count()
    assert one == 12
    for bad in (dict(topk_per_trait=0), dict(p_value_threshold=0), dict(compute_dtype="int8"), dict(marker_ids=["a"]), dict(covariates=np.ones((3, 1)))):
        with pytest.raises(ValueError):
            run_linear(spark, g, y, **bad)
    with pytest.raises(ValueError, match="missing"):
        run_linear(spark, np.where(g == 1, np.nan, g), y)
    with pytest.raises(ValueError, match="zero variance"):
        run_linear(spark, g, np.ones(64))
    with pytest.raises(ValueError):
        run_linear(spark, g[:2], y[:2])


def test_gram_path_equals_block_path(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 9))
    x[:, 8] = 2 * x[:, 7]  # dependent covariates
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "s long, e array<double>").repartition(3)
    mean, cov, n = gram.covariance_matrix(df, "e", list(range(9)))
    assert n == 200 and np.allclose(mean, x.mean(0)) and np.allclose(cov, np.cov(x.T, ddof=0))
    w = gram.residual_weights(cov, [5, 6], [7, 8])
    y, _ = scan.residualise(x[:, 5:7], x[:, 7:8])
    assert np.allclose((x - mean) @ w, y)
    with pytest.warns(UserWarning, match="span 1 dimensions"):
        dependent, basis = scan.residualise(x[:, 5:7], x[:, 7:9])
    assert np.allclose(dependent, y) and basis.shape == (200, 1)
    found = {(r["marker_idx"], r["trait_idx"]): r["beta"] for r in scan.linear_scan(layout.markers_from_arrays(df, "s", "e", [0, 1, 2]), scan.Prepared(y, None, [])).collect()}
    assert np.allclose([[found[i, j] for j in range(2)] for i in range(3)], (cov[:3] @ w) / x[:, :3].std(0)[:, None])


def test_many_traits_scan_in_passes(spark, monkeypatch):
    toy = fixtures.toy_cohort()
    monkeypatch.setattr(scan, "BROADCAST_BYTES", 64 * 8 * 2)
    monkeypatch.setattr(scan, "BLOCK_BYTES", 64 * 8 * 5)
    assert run_linear(spark, toy["genotype"], toy["phenotype"], topk_per_trait=2).table.count() == 6


def as_matrix(markers):
    return np.array([r["g"] for r in markers.orderBy("marker_idx").collect()]).T


def test_sources(spark, tmp_path):
    toy = fixtures.toy_cohort()
    g = toy["genotype"]
    np.save(tmp_path / "g.npy", g)
    npy = genotypes.open_genotype(spark, str(tmp_path / "g.npy"))
    assert npy.n_samples == 64 and np.array_equal(as_matrix(npy.markers), g)
    codes = {2: 0, 1: 2, 0: 3}
    body = b"".join(bytes(sum(codes[int(x)] << 2 * k for k, x in enumerate(g[a : a + 4, m])) for a in range(0, 64, 4)) for m in range(12))
    (tmp_path / "c.bed").write_bytes(b"\x6c\x1b\x01" + body)
    (tmp_path / "c.bim").write_text("".join(f"1 rs{m} 0 {m} A G\n" for m in range(12)))
    (tmp_path / "c.fam").write_text("".join(f"f s{i} 0 0 0 -9\n" for i in range(64)))
    bed = genotypes.open_genotype(spark, str(tmp_path / "c"))
    assert bed.sample_ids[:2] == ["s0", "s1"] and np.array_equal(as_matrix(bed.markers), g) and bed.markers.orderBy("marker_idx").first()["marker_id"] == "rs0"
    other = spark.read.format("plink_bed").option("count", "second").load(str(tmp_path / "c.bed"))
    assert np.array_equal(as_matrix(other), 2 - g)
    head = "FID IID PAT MAT SEX PHENOTYPE " + " ".join(f"rs{m}_A" for m in range(12))
    (tmp_path / "d.raw").write_text("\n".join([head] + [f"f s{i} 0 0 0 -9 " + " ".join(str(int(x)) for x in g[i]) for i in range(64)]) + "\n")
    raw = genotypes.from_raw(spark, str(tmp_path / "d.raw"))
    assert raw.sample_ids == [f"s{i}" for i in range(64)] and np.array_equal(as_matrix(raw.markers), g) and raw.markers.orderBy("marker_idx").first()["marker_id"] == "rs0_A"
    raw.markers.write.parquet(str(tmp_path / "m.parquet"))
    assert genotypes.open_genotype(spark, str(tmp_path / "m.parquet"), "parquet").n_samples == 64
    with pytest.raises(ValueError):
        genotypes.infer_format(str(tmp_path / "x.txt"))
    with pytest.raises(ValueError):
        genotypes.open_genotype(spark, "a.bgen")
    (tmp_path / "a.bgen").write_bytes(b"")
    (tmp_path / "a.sample").write_text("")
    with pytest.raises(RuntimeError):
        genotypes.from_bgen(spark, str(tmp_path / "a.bgen"), str(tmp_path / "a.sample"), str(tmp_path / "no_plink2"), str(tmp_path / "cache"))
    tool = tmp_path / "plink2"  # a stand-in that writes a .raw and counts its calls
    tool.write_text(f'#!/bin/sh\necho x >> {tmp_path}/calls\nwhile [ "$1" != --out ]; do shift; done\ncp {tmp_path}/d.raw "$2.raw"\n')
    tool.chmod(0o755)
    for _ in range(2):  # the second time from the cache
        bgen = genotypes.open_genotype(spark, str(tmp_path / "a.bgen"), sample_file=str(tmp_path / "a.sample"), plink2=str(tool), cache_dir=str(tmp_path / "cache"))
        assert bgen.disk_backed and bgen.sample_ids == raw.sample_ids and np.array_equal(as_matrix(bgen.markers), g)
    assert (tmp_path / "calls").read_text() == "x\n"
    assert genotypes.family_ids(str(tmp_path / "c.fam"))["s3"] == "f"
    (tmp_path / "x.glm.linear").write_text("#CHROM\tID\tTEST\tT_STAT\tP\n1\trs0\tADD\t1.5\t0.1\n1\trs0\tCOV\t9\t0.9\n1\trs1\tADD\tNA\tNA\n1\trs2\tADD\t2\t0.01\n")
    glm = genotypes.read_glm(spark, str(tmp_path / "x.glm.linear"))
    mine = spark.createDataFrame([("rs0", 0.1), ("rs1", 0.5), ("rs2", 0.001), ("rs9", 0.5)], "marker_id string, p_value double")
    got = concordance.agreement(mine, glm).first()
    assert got["n"] == 2 and got["max_abs_diff"] == pytest.approx(1.0) and got["mean_abs_diff"] == pytest.approx(0.5)


def test_tables_align(spark, tmp_path):
    (tmp_path / "p.tsv").write_text("FID\tIID\ta\tb\nx\t002\t1\t2\nx\t001\t3\t4\nx\t001\t9\t9\nx\t003\t5\t6\n")
    table = genotypes.read_table(spark, str(tmp_path / "p.tsv"))
    samples = spark.createDataFrame([(0, "001"), (1, "002")], "idx long, id string")
    out, names = tables.align(samples, table)
    assert names == ["a", "b"] and [tuple(r) for r in out.orderBy("idx").collect()] == [(0, "001", 3.0, 4.0), (1, "002", 1.0, 2.0)]
    with pytest.raises(ValueError, match="missing 1 samples"):
        tables.align(spark.createDataFrame([(0, "9")], "idx long, id string"), table)
    with pytest.raises(ValueError, match="requested columns"):
        tables.align(samples, table, wanted=["z"])
    with pytest.raises(ValueError, match="sample ID"):
        tables.align(samples, table.withColumnRenamed("IID", "who"))
    assert tables.sample_id_column(["sample_id"], "IID") == "sample_id"
    keep = spark.createDataFrame([(0, "002"), (1, "001")], "idx long, id string")
    assert [r["IID"] for r in tables.filter_to_ids(table, keep).orderBy("idx").collect()] == ["002", "001"]
    assert tables.complete_cases(table.withColumn("a", F.when(F.col("a") != "9", F.col("a"))), ["a", "b"]).count() == 3
    g = np.array([[0, 1], [1, 0], [2, 1], [1, 2]], float)
    ids = ["003", "002", "001", "004"]
    with pytest.raises(ValueError):
        run_linear(spark, g, phenotype_table=table, sample_ids=ids)
    got = run_linear(spark, g[:3], phenotype_table=str(tmp_path / "p.tsv"), sample_ids=ids[:3], trait_columns=["b"])
    assert got.run_metadata["trait_columns"] == ["b"] and got.table.count() == 2
    with pytest.raises(ValueError, match="sample IDs"):
        run_linear(spark, g, phenotype_table=table)


def test_plink_writer_round_trip(spark, tmp_path):
    for n in (1, 4, 7):
        g = np.random.default_rng(n).integers(0, 4, (n, 5)).astype(float)
        g[g == 3] = np.nan
        bed = sinks.write_plink(g, [f"m{k}" for k in range(5)], [f"s{k}" for k in range(n)], tmp_path / f"w{n}")
        back = genotypes.open_genotype(spark, bed)
        assert back.sample_ids == [f"s{k}" for k in range(n)] and np.array_equal(as_matrix(back.markers), g, equal_nan=True)


def test_kinship_and_unrelated(spark):
    rng = np.random.default_rng(1)
    g = rng.integers(0, 3, (20, 300)).astype(float)
    g[7], g[9] = g[3], g[3]
    g[5, ::17] = np.nan
    markers = genotypes.from_array(spark, g).markers.repartition(3)
    pairs = relatedness.kinship_pairs(markers, 20)
    for r in pairs.collect():
        a, b = g[r["i"]], g[r["j"]]
        ok = ~np.isnan(a) & ~np.isnan(b)
        hi, hj = (a[ok] == 1).sum(), (b[ok] == 1).sum()
        phi = ((a[ok] == 1) & (b[ok] == 1)).sum() - 2 * (np.abs(a[ok] - b[ok]) == 2).sum()
        assert r["phi"] == pytest.approx(phi / (2 * min(hi, hj)) + 0.5 - (hi + hj) / (4 * min(hi, hj)))
    whole = sorted(map(tuple, pairs.collect()))
    assert len(whole) == 190
    for tile in (7, 19, 20):  # tiles that do and do not divide the samples
        assert sorted(map(tuple, relatedness.kinship_pairs(markers, 20, tile=tile).collect())) == whole
    keep = relatedness.unrelated(pairs, 20, 0.354)
    assert len({3, 7, 9} & set(keep)) == 1 and len(keep) == 18
    out, ids = run_unrelated(spark, genotypes.from_array(spark, g), sample_ids=[f"s{i}" for i in range(20)], cutoff=0.354, phenotype_table=spark.createDataFrame([(f"s{i}", float(i % 5)) for i in range(20)], "IID string, t double"))
    assert len(ids) == 18 and out.run_metadata["genotype_shape"][0] == 18


def test_kinship_shuffles_dosages_not_pairs(spark):
    g = np.random.default_rng(2).choice([0.0, 1.0, 2.0, 0.5, np.nan], (23, 40))
    markers = genotypes.from_array(spark, g).markers.repartition(3)
    pairs = relatedness.kinship_pairs(markers, 23, tile=5)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Union" not in plan and plan.count("MapInArrow") == 2
    rows = pairs.collect()
    assert len({(r["i"], r["j"]) for r in rows}) == len(rows) == 23 * 22 // 2
    assert relatedness.kinship_pairs(markers, 23, 0.01, 5).count() == sum(r["phi"] is not None and r["phi"] > 0.01 for r in rows)
    for r in rows:
        a, b = g[r["i"]], g[r["j"]]
        ok = ~np.isnan(a) & ~np.isnan(b)
        assert (r["n_het_i"], r["n_het_j"]) == ((a[ok] == 1).sum(), (b[ok] == 1).sum())
        assert (r["n_hethet"], r["n_homopp"]) == (((a == 1) & (b == 1)).sum(), (np.abs(a[ok] - b[ok]) == 2).sum())


def test_unrelated_equals_pruning_one_by_one(spark):
    rng, n = np.random.default_rng(3), 60
    links = {(int(min(p)), int(max(p))) for p in rng.integers(0, n, (150, 2)) if p[0] != p[1]}
    left, gone = set(links), set()
    while left:
        degree = [sum(s in p for p in left) for s in range(n)]
        worst = max(range(n), key=lambda s: (degree[s], s))
        gone, left = gone | {worst}, {p for p in left if worst not in p}
    rows = [(i, j, 0.5) for i, j in links] + [(i, j, 0.5) for i, j in sorted(links)[:9]] + [(0, 1, None), (1, 2, 0.0)]
    pairs = spark.createDataFrame(rows, "i long, j long, phi double")
    assert relatedness.unrelated(pairs, n, 0.1) == [s for s in range(n) if s not in gone]
    assert relatedness.unrelated(pairs.where("false"), 3, 0.1) == [0, 1, 2] and relatedness.unrelated(pairs.where("false"), 0) == []


def test_chosen_samples(spark):
    g = np.array([[0, 1, np.nan], [1, np.nan, 2], [2, 0, 1], [1, 1, 1.0]])
    markers = genotypes.from_array(spark, g).markers
    got = {r["marker_idx"]: r["g"] for r in layout.complete_at(markers, 4, [1, 3]).collect()}
    assert got == {0: [1.0, 1.0], 2: [2.0, 1.0]}
    plan = layout.complete_at(markers, 4, [0] * 10_000)._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 5_000  # a literal a sample stood in the plan


def test_marker_quality_is_linear_in_the_samples(spark):
    n = 20_000
    g = np.stack([np.arange(n) % 3, np.ones(n), np.arange(n) % 2]).T.astype(float)
    began = time.time()
    assert scan.marker_quality(genotypes.from_array(spark, g).markers, n) == {"input": 3, "kept": 2}
    assert time.time() - began < 60  # the mean was found anew for each dosage: minutes
    began, y = time.time(), np.random.default_rng(0).normal(size=(n, 2))
    assert run_multivariate(spark, g, y).qc_summary["genotype_columns_kept"] == 2 and time.time() - began < 60
    table = lambda rows: spark.createDataFrame([(r,) for r in rows], "g array<double>")
    for rows, what in (([[0.0, 1.0], [1.0]], "1 markers do not have 2 dosages"), ([[0.0, 1.0], [1.0, None]], "missing"), ([[0.0, float("nan")]], "missing"), ([None, [0.0, 1.0]], "missing")):
        with pytest.raises(ValueError, match=what):
            scan.marker_quality(table(rows), 2)
    assert scan.marker_quality(table([]), 2) == {"input": 0, "kept": 0}


def test_streaming_equals_batch(spark, tmp_path):
    toy = fixtures.toy_cohort()
    y, _ = scan.residualise(toy["phenotype"], None)
    markers = genotypes.from_array(spark, toy["genotype"]).markers
    for part in (0, 1):
        markers.where(F.col("marker_idx") % 2 == part).write.mode("append").parquet(str(tmp_path / "in"))
        stream_linear_scan(spark, str(tmp_path / "in"), scan.Prepared(y, None, []), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    columns = ["marker_idx", "trait_idx", "beta", "p_value"]
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select(*columns).collect()))
    want = sorted(map(tuple, scan.linear_scan(markers, scan.Prepared(y, None, [])).select(*columns).collect()))
    assert len(got) == 36 and [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2:] for g in got], [w[2:] for w in want])


def test_cli(spark, tmp_path):
    assert cli.main(["demo", "--output-dir", str(tmp_path / "demo")], spark) == 0
    summary = json.loads((tmp_path / "demo/run_summary.json").read_text())
    assert summary["linear_rows"] == 36 and summary["multi_rows"] == 12 and summary["linear_top_hit"]["marker_id"] == "rsToy002"
    toy = fixtures.toy_cohort()
    np.save(tmp_path / "g.npy", toy["genotype"])
    np.save(tmp_path / "c.npy", toy["covariates"])
    (tmp_path / "ids.txt").write_text("\n".join(toy["sample_ids"]) + "\n")
    (tmp_path / "p.csv").write_text("FID,IID,u,v\n" + "".join(f"f,{i},{a},{b}\n" for i, (a, b, _) in zip(toy["sample_ids"], toy["phenotype"])))
    common = ["--genotype", str(tmp_path / "g.npy"), "--phenotype-table", str(tmp_path / "p.csv"), "--covariates", str(tmp_path / "c.npy"), "--sample-ids", str(tmp_path / "ids.txt"), "--trait-columns", "u, v"]
    for command in ("prep", "linear", "multi"):
        assert cli.main([command, *common, "--output-dir", str(tmp_path / command)], spark) == 0
    assert cli.main(["linear", *common, "--one-file", "--output-dir", str(tmp_path / "one")], spark) == 0 and (tmp_path / "one/results.tsv.gz").exists()
    assert cli.main(["unrelated", *common, "--cutoff", "0.4", "--output-dir", str(tmp_path / "un")], spark) == 0
    summary = json.loads((tmp_path / "un/unrelated_summary.json").read_text())
    keep = [line.split("\t") for line in (tmp_path / "un/keep.txt").read_text().splitlines()]
    assert summary["n_kept"] == len(keep) <= 64 and all(a == b for a, b in keep)
    paths = toy_dataset(tmp_path / "toy")
    assert np.array_equal(np.load(paths["genotype"]), toy["genotype"]) and toy_dataset(tmp_path / "toy") == paths
    assert tables.prefixed_columns(["a", "PC1", "PC2", "PC3"], "PC", 2) == ["PC1", "PC2"]
    assert [r["id"] for r in tables.first_rows(spark.range(9), [F.desc("id")], 2).collect()] == [8, 7]
    assert {p.name for p in (tmp_path / "prep").iterdir()} == {"phenotype_processed.npy", "covariate_q.npy", "covariates_aligned.npy", "samples.tsv", "qc.json", "prep.json"}
    assert json.loads((tmp_path / "linear/run.json").read_text())["n_result_rows"] == 24 and json.loads((tmp_path / "multi/run.json").read_text())["trait_columns"] == ["u", "v"]
