"""The folder that all executors share, for written tables, checkpoints and columns mapped into memory."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []

#: Rows that one task sorts or counts; tasks grow in number with a table, not in size.
ROWS_PER_TASK = 1_000_000


def shared_root(spark: SparkSession) -> str:
    """Value of ``spark.checkpoint.dir``.

    Only a local master may leave it unset; then a temporary folder of this
    process is made, set as the checkpoint folder and removed at exit.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="gristmill-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(_own[0])
    return _own[0]


def new_folder(spark: SparkSession, purpose: str) -> str:
    """URI of a fresh folder below the shared root; it isn't created."""
    return f"{shared_root(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def mounted(uri: str) -> str:
    """Path of a shared folder that workers open as files (for memory maps)."""
    parsed = urlparse(uri)
    if parsed.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped files need a mounted shared folder, not {uri}")
    return parsed.path


def written(df: DataFrame, purpose: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: the lineage ends there."""
    spark = df.sparkSession
    path = new_folder(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_once(path: str, data: bytes | memoryview) -> None:
    """Write a file under a name of its own, then rename: a repeated task leaves the same file."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        f.write(data)
    os.replace(part, path)


def tasks_for(rows: int) -> int:
    """Number of tasks of ROWS_PER_TASK each."""
    return max(1, -(-rows // ROWS_PER_TASK))


def is_mounted(spark: SparkSession) -> bool:
    """Whether the shared folder is one that workers can open files in."""
    return urlparse(shared_root(spark)).scheme in ("", "file")


def put(path: str, at: int, values: np.ndarray) -> None:
    """Write values of 8 bytes at their place in a flat file; a repeated task writes the same."""
    fd = os.open(path, os.O_WRONLY)
    try:
        data, at = memoryview(np.ascontiguousarray(values)).cast("B"), at * 8
        while len(data):
            done = os.pwrite(fd, data, at)
            data, at = data[done:], at + done
    finally:
        os.close(fd)


def flat_file(path: str, rows: int) -> str:
    """A new flat file for so many values of 8 bytes."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.truncate(rows * 8)
    return path


def flat_columns(df: DataFrame, keys: Sequence[str], rows: int, purpose: str) -> tuple[list[str], int]:
    """(paths, rows): df's bigint columns as flat files that workers map into memory, in the order of keys.

    rows is about the number of df's rows. Ranges of keys are sorted side by
    side and written at their places in the files; only the ranges' sizes meet.
    """
    spark, names = df.sparkSession, df.columns
    ordered = df.repartitionByRange(tasks_for(rows), *keys).sortWithinPartitions(*keys).withColumn("_m", F.monotonically_increasing_id())
    ordered = written(ordered, purpose)
    sizes = {r["part"]: r["count"] for r in ordered.groupBy(F.shiftright("_m", 33).alias("part")).count().collect()}  # one row a task
    ends = np.cumsum([0, *(sizes.get(k, 0) for k in range(max(sizes, default=0) + 1))])
    total = int(ends[-1])
    folder = mounted(new_folder(spark, f"{purpose}-flat"))
    paths = [flat_file(f"{folder}/{k}", total) for k in range(len(names))]

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.column(len(names)).to_numpy()
            at = ends[m >> 33] + (m & ((1 << 33) - 1))
            cuts = [0, *(np.flatnonzero(np.diff(at) != 1) + 1).tolist(), len(m)] if len(m) else [0]
            for lo, hi in zip(cuts, cuts[1:]):
                for path, column in zip(paths, batch.columns):
                    put(path, int(at[lo]), column.to_numpy()[lo:hi])
        yield pa.RecordBatch.from_arrays([pa.array([1])], names=["done"])

    ordered.mapInArrow(fill, "done bigint").agg(F.sum("done")).collect()
    return paths, total


def mapped(path: str, kind=np.int64) -> np.ndarray:
    """A flat file's values, read when they are looked at."""
    return np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)  # an empty file can't be mapped
