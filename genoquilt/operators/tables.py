"""Tables keyed by sample: alignment, keep-first de-duplication, intersections, missing values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FALLBACK_IDS = ("sampleid", "sample_id", "ID", "id")


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def keep_first(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The first row of each key by ``order``. Spark plans it as a window group limit: one row a key and task is shuffled."""
    n = unused(df, "n")
    return df.withColumn(n, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(n) == 1).drop(n)


def sample_id_column(columns: list[str], wanted: str = "IID") -> str:
    for name in (wanted, *FALLBACK_IDS):
        if name in columns:
            return name
    raise ValueError(f"no sample ID column: looked for {wanted} and {', '.join(FALLBACK_IDS)}")


def value_columns(columns: list[str], id_col: str, wanted: list[str] | None = None) -> list[str]:
    found = [c for c in columns if c not in {"FID", "fid", id_col}] if wanted is None else list(wanted)
    if absent := [c for c in found if c not in columns]:
        raise ValueError(f"missing requested columns: {absent}")
    return found


def align(samples: DataFrame, table: DataFrame, id_col: str = "IID", wanted: list[str] | None = None, order: list | None = None, check: bool = True) -> tuple[DataFrame, list[str]]:
    """(idx, id, values...): the table's values for each of ``samples`` (idx, id), the first row of an id counts and
    rows of other ids are ignored. With ``check``, samples without a row raise."""
    key = sample_id_column(table.columns, id_col)
    names = value_columns(table.columns, key, wanted)
    chosen = table.select(F.col(key).cast("string").alias("_id"), *(F.col(c).cast("double").alias(c) for c in names), *([] if order else [F.monotonically_increasing_id().alias("_at")]), *([F.struct(*order).alias("_at")] if order else []))
    first = keep_first(chosen, ["_id"], ["_at"]).drop("_at")
    if check and (n := samples.join(first, samples["id"] == first["_id"], "left_anti").count()):
        raise ValueError(f"the table is missing {n} samples present in the genotype input")
    return samples.join(first, samples["id"] == first["_id"], "left").drop("_id"), names


def missing_ids(samples: DataFrame, table: DataFrame, id_col: str) -> DataFrame:
    return samples.join(table.select(F.col(id_col).cast("string").alias("_id")), F.col("id") == F.col("_id"), "left_anti")


def intersect_in_order(samples: DataFrame, *tables: tuple[DataFrame, str]) -> DataFrame:
    """The samples (idx, id) that every table holds; idx keeps the first one's order."""
    for table, col in tables:
        ids = table.select(F.col(col).cast("string").alias("_id")).distinct()
        samples = samples.join(ids, samples["id"] == ids["_id"], "left_semi")
    return samples


def filter_to_ids(table: DataFrame, keep: DataFrame, id_col: str = "IID", require_all: bool = True, order: list | None = None) -> DataFrame:
    """The table's first row for each of ``keep`` (idx, id), with idx; ``require_all`` raises for ids without one."""
    at = unused(table, "at")
    found = keep_first(table.withColumn(at, F.struct(*order) if order else F.monotonically_increasing_id()), [id_col], [at]).drop(at)
    if require_all and (n := missing_ids(keep, table, id_col).count()):
        raise ValueError(f"{n} requested samples are not in the table")
    return keep.join(found, keep["id"] == found[id_col].cast("string")).drop("id")


def concat_tables(first: DataFrame, second: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Both tables' rows; of a key the first table's come first, then by ``order``."""
    t = unused(first, "t")
    both = first.withColumn(t, F.lit(0)).unionByName(second.withColumn(t, F.lit(1)))
    return keep_first(both, keys, [t, *order]).drop(t)


def is_missing(c: Column) -> Column:
    return c.isNull() | F.isnan(c)


def missing_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: how many values of each column are null or NaN."""
    return df.agg(*(F.coalesce(F.count_if(is_missing(F.col(c).cast("double"))), F.lit(0)).alias(c) for c in columns))


def assert_complete(df: DataFrame, columns: list[str], what: str) -> None:
    if any(missing_counts(df, columns).first()):
        raise ValueError(f"{what} contains missing values; complete matrices are required")


def complete_cases(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.where(~F.greatest(*(is_missing(F.col(c).cast("double")) for c in columns), F.lit(False)))


def prefixed_columns(columns: list[str], prefix: str, count: int | None = None) -> list[str]:
    """The columns whose name starts with ``prefix``, in order; the first ``count`` of them if given."""
    found = [c for c in columns if c.startswith(prefix)]
    return found if count is None else found[:count]


def first_rows(df: DataFrame, order: list[str | Column], count: int) -> DataFrame:
    """The first ``count`` rows by ``order``; each task keeps no more than that."""
    return df.orderBy(*order).limit(count)
