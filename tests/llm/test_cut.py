"""Tables between steps: what is written and by whom."""

import datetime
import os
import subprocess
import sys
from pathlib import Path

import pyarrow as pa
import pytest

from genoquilt.llm import common

ROOT = Path(__file__).resolve().parents[2]
KEEP_ONE = """
from pyspark.sql import SparkSession
from genoquilt.llm import neardup

spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "3").getOrCreate()
text = "a b c d e f g h i j k l m n o p q r s t"
docs = spark.createDataFrame([(i, text + (" u" if i % 2 else "") if i < 6 else f"{i} other words {i * i} and {i} more") for i in range(9)], "doc_id long, text string")
print("KEPT", sorted(r[0] for r in neardup.keep_one(docs).collect()))
"""


def test_near_duplicates_starts_no_processes(tmp_path):
    """Each process that an executor starts shows all of the executor's memory a second time until it runs its own program."""
    (tmp_path / "bin").mkdir()
    chmod = tmp_path / "bin/chmod"
    chmod.write_text(f'#!/bin/sh\necho "$*" >> {tmp_path}/calls\nexec /bin/chmod "$@"\n')
    chmod.chmod(0o755)
    env = os.environ | {"PATH": f"{tmp_path}/bin:{os.environ['PATH']}", "PYTHONPATH": str(ROOT), "TMPDIR": str(tmp_path)}
    ran = subprocess.run([sys.executable, "-c", KEEP_ONE], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "KEPT [0, 6, 7, 8]" in ran.stdout, ran.stderr[-2000:]
    calls = (tmp_path / "calls").read_text() if (tmp_path / "calls").exists() else ""
    assert "part-" not in calls and "attempt_" not in calls


SCHEMA = "id long, small int, x double, f float, yes boolean, raw binary, text string, s struct<a:long,b:string>, l array<struct<c:long>>"


def test_cut_keeps_rows_and_types(spark):
    rows = [(i, i % 3, i / 7, float(i), i % 2 == 0, bytes([i % 256]) * i, "é" * i, (i, str(i)), [(i,), (None,)]) for i in range(50)]
    rows += [(None,) * 9, (1, 2, float("inf"), -0.0, None, b"", "", (None, None), []), *rows[:3]]
    df = spark.createDataFrame(rows, SCHEMA)
    for table in (df, df.repartition(7), df.limit(0)):
        got = common.cut(table, "t")
        assert got.schema == df.schema and sorted(map(str, got.collect())) == sorted(map(str, table.collect()))
        common.forget(got)


def test_cut_of_other_types(spark):
    rows = [(1, datetime.date(1500, 1, 2), datetime.datetime(2020, 1, 2, 3, 4, 5, 6), {"a": 1}), (None, None, None, None)]
    df = spark.createDataFrame(rows, "id long, day date, at timestamp, m map<string,int>")
    got = common.cut(df, "t")
    assert got.schema == df.schema and sorted(map(str, got.collect())) == sorted(map(str, df.collect()))


def test_cut_reads_one_file_a_task(spark, monkeypatch):
    """Row groups are bounded, what a failed attempt leaves is not read, and an error of a task is raised."""
    monkeypatch.setattr(common, "GROUP_BYTES", 64)

    def twice(batches):
        for b in batches:
            yield b
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64())], names=["id"])

    got = common.cut(spark.range(100, numPartitions=3), "t", twice, "id long")
    assert sorted(r[0] for r in got.collect()) == [-1] * 3 + list(range(100))
    folder = Path(got._cut_at.removeprefix("file:"))
    assert len(list(folder.iterdir())) == 3 and all(f.name.startswith("part-") for f in folder.iterdir())
    (folder / "_part-dead.parquet").write_bytes(next(folder.iterdir()).read_bytes())
    assert spark.read.parquet(got._cut_at).count() == 103

    def fail(batches):
        yield from batches
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        common.cut(spark.range(10), "t", fail, "id long")
