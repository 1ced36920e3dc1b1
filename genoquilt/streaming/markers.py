"""Scans over a growing folder of marker files: each micro-batch of a file stream is scanned and appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.scan import Prepared, linear_scan

SCHEMA = "marker_idx long, marker_id string, g array<double>"


def stream_linear_scan(spark: SparkSession, source: str, prepared: Prepared, sink: str, checkpoint: str, p_value_threshold: float | None = None, available_now: bool = True) -> StreamingQuery:
    """Scans Parquet marker files that arrive in ``source`` and appends the rows to ``sink``. Thresholds act at once;
    limits per trait need all markers and belong on the sink's table. A batch that is run again overwrites its own
    folder, so each file's rows stand once."""

    def scan(batch: DataFrame, number: int) -> None:
        linear_scan(batch, prepared, p_value_threshold=p_value_threshold).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    writer = spark.readStream.schema(SCHEMA).parquet(source).writeStream.foreachBatch(scan).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
