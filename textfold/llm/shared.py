"""Helpers the operators share: scratch tables in the shared folder and input checks."""

from __future__ import annotations

import ctypes
import gc
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import table_path


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder that ``spark.checkpoint.dir`` names (visible to every executor)."""
    return table_path(spark, f"{name}-{uuid.uuid4().hex}")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends here, and the
    files outlive any executor."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


TEXT_ROWS = 1000


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches hold at most ``TEXT_ROWS`` rows: a row is a whole text, so the usual 10,000 rows
    would be tens of MB, several times over, in each task."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(df.sparkSession.conf.get(key))
    if now <= 0 or now > TEXT_ROWS:
        df.sparkSession.conf.set(key, str(TEXT_ROWS))
    return df


_caches: list[dict] = []


def worker_cache() -> dict:
    """A dict that a Python worker keeps from task to task, until another operator's tasks drop it."""
    _caches.append({})
    return _caches[-1]


def free_memory() -> None:
    """What was freed goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def drop_caches() -> None:
    """Called in a task that needs the memory: other operators' caches go, and what was freed goes back to the system."""
    for cache in _caches:
        cache.clear()
    gc.collect()
    free_memory()
