"""What the operators share: the folder that all machines see, written tables, and text buffers."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT = "spark.checkpoint.dir"
BLANKS = (0x20, *range(0x09, 0x0E))
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    It is the cluster's ``spark.checkpoint.dir``; only where that is unset and there is one machine alone (a local master, as in tests)
    is a temporary folder made and set. On a cluster other machines could not read it, so the setting is asked for.
    """
    where = spark.sparkContext.getConf().get(CHECKPOINT) or spark.conf.get(CHECKPOINT, None)
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError(f"set {CHECKPOINT} to a folder that all machines see")
        where = "file://" + tempfile.mkdtemp(prefix="quernel-shared-")
        spark.conf.set(CHECKPOINT, where)
    return where.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/quernel/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, paths: list[str] | None = None) -> DataFrame:
    """Write a table to the shared folder and read it again: later jobs neither recompute it nor lose it.

    ``paths`` takes the table's path, for a caller that removes it when nothing reads it any more.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    if paths is not None:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, limit: int) -> DataFrame:
    """The table, marked for broadcasting if it has been counted to be of ``limit`` rows at most; else as it is, so that a join shuffles."""
    return F.broadcast(df) if df.count() <= limit else df


def files_for(spark: SparkSession, rows: int, each: int) -> int:
    """How many files hold so many rows, ``each`` in a file or so: two a core at least, so that all cores work."""
    return max(2 * spark.sparkContext.defaultParallelism, -(-rows // each))


def task(function, *args, **kwargs):
    """A function of batches for mapInArrow. Only its arguments travel; the function is imported by the worker."""

    def run(batches):
        try:
            yield from function(batches, *args, **kwargs)
        finally:
            release()

    return run


def release() -> None:
    """Give memory that is free inside this process back to the machine: workers live on after their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


_HELD: dict[str, tuple] = {}


def holds(owner: str, *caches) -> None:
    """Tell that an operator begins, whose caches these are; the caches of the operators before it are emptied."""
    for other in [k for k in _HELD if k != owner]:
        for cache in _HELD.pop(other):
            cache.clear()
    _HELD[owner] = caches


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete paths of the shared folder, whatever store it is in, and empty the list."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    paths.clear()


def words_of(text) -> F.Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a string column; null gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and where each row begins and ends. Null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def batches_of(batch: pa.RecordBatch, column: str, limit: int):
    """Slices of a batch whose column holds about ``limit`` bytes each, one row at least."""
    _, ends = utf8(batch.column(column))
    first = 0
    while first < len(batch):
        last = int(np.searchsorted(ends, ends[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), len(batch))
        yield batch.slice(first, last - first)
        first = last
