"""What the operators share: the shared folder, lineage cuts, and row plumbing."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of rows that a task holds before they go to its file, as a row group.
GROUP_BYTES = 8 << 20
#: Narrow rows of one task where partitions are merged.
TASK_ROWS = 250_000
#: What Arrow and Spark write to Parquet alike, by itself and in arrays and structs.
_PLAIN = (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.BinaryType)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where that is unset and Spark runs in this process
    alone (tests), one of our own; on several hosts an error, as a local folder would not be shared."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="genoquilt-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame, name: str, run: Callable | None = None, schema: str | None = None, by_spark: bool = False) -> DataFrame:
    """Writes ``df``, or what ``df.mapInArrow(run, schema)`` gives, as Parquet in the shared folder and reads it back: later
    stages neither recompute it nor lose it with an executor. ``forget`` deletes it.

    Where the folder is mounted, Python workers write the parts: Spark would start two processes of ``chmod`` for each, and
    until such a process runs its own program it shows all of the executor's memory a second time. Elsewhere, for other types
    and with ``by_spark``, Spark writes. Python in the last stage of ``df`` would hold a second worker for each core beside the
    one that writes; ``run`` does not.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/genoquilt/{name}-{uuid.uuid4().hex}"
    kind = T.StructType.fromDDL(schema) if schema else df.schema
    folder = None if by_spark or not _plain(kind) else _mounted(spark, path)
    if folder is None:
        (df.mapInArrow(run, schema) if run else df).write.parquet(path)
    else:
        os.makedirs(folder)
        # one name a task that succeeded; what other attempts wrote keeps its underscore, so nobody reads it
        for part in df.mapInArrow(_parts(folder, run), "part string").collect():
            os.rename(f"{folder}/_{part[0]}", f"{folder}/{part[0]}")
    out = spark.read.schema(kind).parquet(path)
    out._cut_at = path
    return out


def _plain(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return len(kind) > 0 and all(_plain(f.dataType) for f in kind)
    return _plain(kind.elementType) if isinstance(kind, T.ArrayType) else isinstance(kind, _PLAIN) or type(kind) is T.StringType


def _mounted(spark: SparkSession, path: str) -> str | None:
    """``path`` in the file system of this machine; None if it is in another one."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return hadoop.toUri().getPath() if store.getUri().getScheme() == "file" and hadoop.isAbsolute() else None


def _parts(folder: str, run: Callable | None):
    """For ``mapInArrow``: writes a task's rows, or what ``run`` makes of them, to a file of its own, and gives the file's name."""

    def write(batches):
        import pyarrow.parquet as pq

        part, out, held = f"part-{uuid.uuid4().hex}.parquet", None, []
        for batch in run(batches) if run else batches:
            if batch.num_rows:
                if run:  # a copy: a column that run hands on would keep all that came with it
                    batch = batch.take(pa.array(range(batch.num_rows)))
                batch = pa.RecordBatch.from_arrays(batch.columns, names=batch.schema.names)  # all columns nullable
                out = out or pq.ParquetWriter(f"{folder}/_{part}", batch.schema)
                held.append(batch)
                if sum(b.nbytes for b in held) >= GROUP_BYTES:
                    out.write_table(pa.Table.from_batches(held))
                    held = []
        if out:
            if held:
                out.write_table(pa.Table.from_batches(held))
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([part])], names=["part"])
        held = batch = None
        trim()

    return write


def forget(*tables: DataFrame) -> None:
    """Deletes tables that ``cut`` wrote, once nothing that is still to run reads them."""
    for df in tables:
        if path := getattr(df, "_cut_at", None):
            hadoop = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(hadoop, True)


# -- memory of Python workers ------------------------------------------------------------------------
class Bounded(dict):
    """A dictionary that takes entries until they weigh ``limit`` bytes by ``weigh(key, value)``. It fills once and then
    stays, as frequent keys come early, until its operator's turn in this worker ends (see ``hold``)."""

    def __init__(self, limit: int, weigh: Callable):
        self.room, self.weigh = limit, weigh

    def keep(self, key, value) -> None:
        if self.room > 0:
            self.room -= self.weigh(key, value)
            self[key] = value


class Remembered(Bounded):
    """key -> compute(key), remembered as far as there is room."""

    def __init__(self, compute: Callable, limit: int, weigh: Callable):
        super().__init__(limit, weigh)
        self.compute = compute

    def __missing__(self, key):
        value = self.compute(key)
        self.keep(key, value)
        return value


_held: dict[str, Callable[[], None]] = {}


def hold(owner: str, drop: Callable[[], None]) -> None:
    """Says that ``owner`` holds memory in this Python worker from now on, and that ``drop`` frees it. Spark reuses workers for
    all stages, so what other operators hold is freed first: a worker has one operator's caches at a time."""
    others = [name for name in _held if name != owner]
    for name in others:
        _held.pop(name)()
    _held[owner] = drop
    if others:
        trim()


def trim() -> None:
    """Gives freed memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL(None).malloc_trim(0)


def merged(df: DataFrame, rows: int) -> DataFrame:
    """``df``, which holds at most about ``rows`` narrow rows, in no more partitions than are of use: of TASK_ROWS rows, and
    two a core. Tables between steps are small, and a task for each shuffle partition costs more than its rows."""
    return df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)))


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def is_finite_vector(v: Column) -> Column:
    """True for an array that is not null, not empty and has no null, NaN or infinite component."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & ~bad, F.lit(False))


def arrow_rows(make: Callable[[], Callable[[dict[str, list]], dict[str, Iterable]]], schema: pa.Schema, rows: int = 2048):
    """A function for ``mapInArrow``: ``make()`` runs once a task and returns what maps the columns of up to
    ``rows`` rows (as Python lists) to the columns of the result. Bounds the Python objects alive at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                out = apply(batch.slice(at, rows).to_pydict())
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)

    return run
