"""Helpers of the operators: tables, the shared folder, hash filters."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from modiste.session import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: rows that go to Python at once while a table is stored: texts and sets of a few KB each make batches of a few MB
BATCH_ROWS = 1500


@contextlib.contextmanager
def small_batches(spark: SparkSession):
    """Within it, what runs sends Python BATCH_ROWS rows at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stored(df: DataFrame, what: str, compression: str = "snappy") -> DataFrame:
    """`df`, written as Parquet below the cluster's shared folder and read again: the lineage ends there, any executor can read
    it, and Spark knows its true size. The folder goes when the session's JVM ends. While it is written, batches for Python are small."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/llm-{what}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.option("compression", compression).parquet(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Remove stored tables that nothing reads any more: what was made of them is stored itself."""
    for df in tables:
        files = df.inputFiles()
        if files:
            at = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            if not at.getName().startswith("llm-"):
                raise ValueError(f"{at.getName()} isn't a stored table")
            at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def unused(df: DataFrame, *names: str):
    """Column names like these that `df` doesn't have: a list, or the name if it is one."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out if len(out) > 1 else out[0]


@functools.lru_cache(1)
def trim():
    """The C library's function that returns freed memory to the system, or one that does nothing."""
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def give_back() -> None:
    """Return what a worker has freed, so that workers that stay don't keep the most they ever held."""
    pa.default_memory_pool().release_unused()
    trim()(0)


def in_runs(f, limit: int = 6 << 20):
    """A function of Arrow arrays, called for runs of rows of about `limit` bytes each, so that what it holds doesn't follow the batch size."""

    @functools.wraps(f)
    def run(*columns):
        n, size = len(columns[0]), sum(c.nbytes for c in columns)
        step = max(1, int(n * limit / max(size, 1)))
        out = f(*columns) if step >= n else pa.concat_arrays([f(*(c.slice(at, step) for c in columns)) for at in range(0, n, step)])
        give_back()
        return out

    return run


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of steps whose results are stored: it does so once their plans are collected as garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def listed(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list array from flat values and one length per row."""
    ends = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, kind))


def sliced(batches, limit: int = 4 << 20):
    """Record batches cut into runs of rows of about `limit` bytes, so that what a step holds doesn't follow the batch size."""
    for batch in batches:
        step = max(1, int(batch.num_rows * limit / max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
        if batch.nbytes > 1 << 20:
            give_back()
