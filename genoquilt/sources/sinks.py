"""Result sinks."""

from __future__ import annotations

import csv
import gzip
import json
import tempfile
import uuid
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def write_rows(df: DataFrame, path: str) -> int:
    """Distributed: a folder of gzipped tab-separated parts with headers; returns the number of rows, counted as they
    are written."""
    rows = Observation()
    df.observe(rows, F.count(F.lit(1)).alias("n")).write.option("sep", "\t").option("header", True).option("compression", "gzip").mode("overwrite").csv(path)
    return rows.get["n"]


def export_rows(df: DataFrame, path: str | Path, allow_empty: bool = True) -> int:
    """One gzipped tab-separated file, streamed through the driver partition by partition; returns its number of rows."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    n = 0
    with gzip.open(path, "wt", newline="") as f:
        out = csv.writer(f, delimiter="\t")
        out.writerow(df.columns)
        for row in df.toLocalIterator():
            out.writerow(row)
            n += 1
    if not n and not allow_empty:
        Path(path).unlink()
        raise ValueError("refusing to write an empty result table")
    return n


def write_json(value, path: str | Path) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(value, indent=2, sort_keys=True) + "\n")


def write_artefact(value, path: str | Path) -> None:
    """An array as .npy, a list as lines, anything else as JSON."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    if isinstance(value, np.ndarray):
        np.save(path, value)
    elif isinstance(value, list):
        Path(path).write_text("".join(f"{x}\n" for x in value))
    else:
        write_json(value, path)


def shared_folder(spark: SparkSession) -> Path:
    """A new folder that the driver and all tasks can open as files, within ``spark.checkpoint.dir``. Where that is unset and
    Spark runs in this process alone, a temporary one; on several hosts an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        return Path(tempfile.mkdtemp(prefix="genoquilt-files-"))
    scheme, colon, path = found.partition(":")
    if colon and scheme != "file":
        raise ValueError(f"{found} cannot be opened as a folder of files")
    folder = Path("/" + (path if colon else found).lstrip("/")) / "genoquilt" / f"files-{uuid.uuid4().hex}"
    folder.mkdir(parents=True)
    return folder


def write_plink(dosages: np.ndarray, marker_ids: list[str], sample_ids: list[str], stem: str | Path) -> str:
    """Writes a samples x markers array of 0, 1, 2 and NaN as ``stem``.bed, .bim and .fam (SNP-major PLINK 1; dosages count
    the first allele); returns the path of the .bed. Families are named like their samples."""
    n, m = dosages.shape
    codes = np.select([dosages == 2, dosages == 1, dosages == 0], [0, 2, 3], 1).astype(np.uint8)
    padded = np.zeros((-(-n // 4) * 4, m), np.uint8)
    padded[:n] = codes
    packed = (padded.reshape(-1, 4, m) << np.array([0, 2, 4, 6], np.uint8)[None, :, None]).sum(1, dtype=np.uint8)
    Path(f"{stem}.bed").write_bytes(b"\x6c\x1b\x01" + packed.T.tobytes())
    Path(f"{stem}.bim").write_text("".join(f"1\t{marker}\t0\t{k + 1}\tA\tC\n" for k, marker in enumerate(marker_ids)))
    Path(f"{stem}.fam").write_text("".join(f"{s}\t{s}\t0\t0\t0\t-9\n" for s in sample_ids))
    return f"{stem}.bed"
