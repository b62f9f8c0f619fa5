"""Intermediate tables in the folder that all executors share, which cut the lineage and survive lost executors."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

ARROW_ROWS, READER_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"
#: Rows that a Python worker gets, and a Parquet reader makes, at a time.  10,000 texts, Spark's own figure, are some 33 MB, which
#: an executor holds several times over: on its heap, outside of it, and in the worker.
BATCH_ROWS = 1000
#: Tasks for each core where rows are spread.
TASKS = 2
_mine: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset a local folder, if the master is local too."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="cinnabar-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _clean() -> None:
    for spark, path in _mine:
        try:
            _delete(spark, path)
        except Exception:  # the session may be gone already
            return


atexit.register(_clean)


def materialize(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """df, written as Parquet (with these options) and read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cinnabar-{name}-{uuid.uuid4().hex}"
    df.write.options(**(options or {})).parquet(path)
    _mine.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._cinnabar_path = path  # type: ignore[attr-defined]
    return out


def spread(rows: DataFrame, *by: str) -> DataFrame:
    """rows dealt to all cores by these columns, for Python: a small file of many rows is else read, and worked on, by few tasks."""
    return rows.repartition(TASKS * rows.sparkSession.sparkContext.defaultParallelism, *by)


def append(spark: SparkSession, parts: Iterable[DataFrame], schema: T.StructType, name: str) -> DataFrame:
    """The rows of some tables, each written before the next is asked for, read back as one."""
    path = f"{shared_dir(spark)}/cinnabar-{name}-{uuid.uuid4().hex}"
    _mine.append((spark, path))
    spark.createDataFrame([], schema).write.parquet(path)
    for df in parts:
        df.write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


@contextmanager
def settings(spark: SparkSession, **some: int) -> Iterator[None]:
    """Other numbers of rows in batches, as arrow and reader, for what runs inside."""
    names = {"arrow": ARROW_ROWS, "reader": READER_ROWS}
    before = {names[k]: spark.conf.get(names[k]) for k in some}
    try:
        for k, rows in some.items():
            spark.conf.set(names[k], str(rows))
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def small_batches(spark: SparkSession) -> None:
    """From here on batches of this session have at most BATCH_ROWS rows; it isn't undone, as plans run after they are returned."""
    for name in (ARROW_ROWS, READER_ROWS):
        if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
            spark.conf.set(name, str(BATCH_ROWS))


def give_back() -> None:
    """Freed memory of a worker that lives on goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def discard(df: DataFrame) -> None:
    """Delete a table of materialize() that nothing reads any more."""
    path = getattr(df, "_cinnabar_path", None)
    if path:
        _delete(df.sparkSession, path)
        _mine[:] = [(s, p) for s, p in _mine if p != path]
