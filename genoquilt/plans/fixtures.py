"""A generated toy cohort: 64 samples, 12 markers, three traits, four covariates."""

from __future__ import annotations

from pathlib import Path

import numpy as np

from ..sources.sinks import write_artefact


def toy_cohort(seed: int = 42, n: int = 64, m: int = 12) -> dict:
    """Trait 0 follows marker 2, trait 1 marker 7, trait 2 markers 10 and 7; covariates act on them too. The draws (and
    so the published golden values) are fixed by the seed and their order: covariates, dosages, noise."""
    rng = np.random.default_rng(seed)
    covariates = rng.normal(size=(n, 4))
    dosages = rng.integers(0, 3, size=(n, m)).astype(float)
    effects, confounding = np.zeros((m, 3)), np.zeros((4, 3))
    effects[2, 0], effects[7, 1], effects[10, 2], effects[7, 2] = 1.2, -0.8, 0.9, 0.4
    confounding[0, 0], confounding[1, 1], confounding[2, 2] = -0.5, 0.7, -0.4
    traits = dosages @ effects + covariates @ confounding + rng.normal(scale=0.5, size=(n, 3))
    return {"genotype": dosages, "phenotype": traits, "covariates": covariates, "marker_ids": [f"rsToy{i:03d}" for i in range(m)], "sample_ids": [f"sample_{i:03d}" for i in range(n)]}


def toy_dataset(folder: str | Path) -> dict[str, str]:
    """Writes the toy cohort to ``folder`` unless it is there; name -> path of its .npy arrays and id lists."""
    paths = {}
    for name, value in toy_cohort().items():
        path = Path(folder) / (f"{name}.npy" if isinstance(value, np.ndarray) else f"{name}.txt")
        if not path.exists():
            write_artefact(value, path)
        paths[name] = str(path)
    return paths
