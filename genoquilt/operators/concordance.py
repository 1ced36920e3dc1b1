"""How well two scans of the same markers agree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tails import negative_log10_col


def agreement(first: DataFrame, second: DataFrame, key: str = "marker_id", p_value: str = "p_value") -> DataFrame:
    """One row (n, pearson_r, mean_abs_diff, max_abs_diff) of -log10 p over the markers that both tables have with a p
    value; of a repeated marker each pair of rows counts. Without common markers n is 0 and the rest null."""
    a, b = (t.where(F.col(p_value).isNotNull()).select(F.col(key).alias("key"), negative_log10_col(F.col(p_value)).alias(n)) for t, n in ((first, "a"), (second, "b")))
    gap = F.abs(F.col("a") - F.col("b"))
    return a.join(b, "key").agg(F.count(F.lit(1)).alias("n"), F.corr("a", "b").alias("pearson_r"), F.avg(gap).alias("mean_abs_diff"), F.max(gap).alias("max_abs_diff"))
