"""Between sample-major and marker-major layouts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import blocks_of


def markers_from_arrays(df: DataFrame, id_col: str, array_col: str, columns: list[int]) -> DataFrame:
    """Marker-major table of some columns of an array column; dosages in order of ``id_col``. One shuffle of
    (marker, sample, dosage) cells."""
    cells = df.select(F.col(id_col).alias("s"), F.posexplode(F.transform(F.array(*map(F.lit, columns)), lambda c: F.get(array_col, c).cast("double"))).alias("at", "x"))
    rows = cells.groupBy("at").agg(F.transform(F.array_sort(F.collect_list(F.struct("s", "x"))), lambda z: z["x"]).alias("g"))
    names = F.array(*(F.lit(int(c)) for c in columns))
    return rows.select(F.col("at").cast("long").alias("marker_idx"), F.concat(F.lit("marker_"), F.element_at(names, F.col("at") + 1)).alias("marker_id"), "g")


def markers_from_long(df: DataFrame, sample_idx: str, marker: str, dosage: str, n_samples: int) -> DataFrame:
    """Marker-major table of a sparse long one (sample index, marker, dosage); absent cells are 0, of a repeated cell one
    value counts. Markers are numbered by a hash of their name. A task fills one batch of markers at a time."""
    cells = df.select(F.col(marker).cast("string").alias("marker_id"), F.col(sample_idx).cast("int").alias("s"), F.col(dosage).cast("double").alias("x"))
    rows = cells.groupBy("marker_id").agg(F.collect_list("s").alias("s"), F.collect_list("x").alias("x"))

    def fill(batches):
        for batch in batches:
            at, value = batch.column("s"), batch.column("x")
            dense = np.zeros((batch.num_rows, n_samples))
            counts = np.diff(at.offsets.to_numpy())
            dense[np.repeat(np.arange(batch.num_rows), counts), at.flatten().to_numpy()] = value.flatten().to_numpy()
            offsets = pa.array(np.arange(0, dense.size + 1, n_samples, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("marker_id"), pa.ListArray.from_arrays(offsets, pa.array(dense.ravel()))], names=["marker_id", "g"])

    return rows.mapInArrow(fill, "marker_id string, g array<double>").select(F.xxhash64("marker_id").alias("marker_idx"), "marker_id", "g")


def complete_at(markers: DataFrame, n: int, keep: list[int]) -> DataFrame:
    """A marker-major table of n samples with the samples ``keep`` alone; markers that are missing in one of them are left out."""
    shared = markers.sparkSession.sparkContext.broadcast(np.array(keep, np.int64))

    def run(batches):
        for batch in batches:
            for part, g in blocks_of(batch, n):
                chosen = g[:, shared.value]
                whole = ~np.isnan(chosen).any(1)
                chosen, rows = chosen[whole], part.filter(pa.array(whole))
                offsets = pa.array(np.arange(len(chosen) + 1, dtype=np.int32) * np.int32(len(shared.value)))
                yield pa.RecordBatch.from_arrays([rows.column("marker_idx"), rows.column("marker_id"), pa.ListArray.from_arrays(offsets, pa.array(chosen.ravel()))], names=["marker_idx", "marker_id", "g"])

    return markers.select("marker_idx", "marker_id", "g").mapInArrow(run, "marker_idx long, marker_id string, g array<double>")
