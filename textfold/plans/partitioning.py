"""Input parallelism.

A large cluster reads thousands of file splits, but a table written as one
row group arrives as a single partition, and every per-row CPU step after it
(tokenising, hashing, chunking) would then run in one task. ``spread`` adds a
hash repartition on a unique key only when the scan has fewer partitions than
the cluster can run at once; otherwise the plan is left untouched.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..session import table_path


def spread(df: DataFrame, keys: Sequence[str], min_partitions: int | None = None) -> DataFrame:
    """Hash-repartition on ``keys`` (unique, so no hot partition) if the input is under-split."""
    sc = df.sparkSession.sparkContext
    target = min_partitions or 2 * sc.defaultParallelism
    if df.rdd.getNumPartitions() >= sc.defaultParallelism:
        return df
    return df.repartition(target, *keys)


TEXT_ROWS, TEXT_BYTES = 1000, 16 << 20


def text_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches hold at most ``TEXT_ROWS`` rows and about ``TEXT_BYTES``: a row is a whole text's
    tokens, so the usual 10,000 rows would be a hundred MB, several times over, in each task."""
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", TEXT_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", TEXT_BYTES)):
        now = conf.get(key)
        if not now.isdigit() or not 0 < int(now) <= most:
            conf.set(key, str(most))
    return df


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """``df`` written to the shared folder as a table of buckets of ``key``: joins on ``key`` read it as it lies and shuffle only the other side."""
    spark = df.sparkSession
    n, table = int(spark.conf.get("spark.sql.shuffle.partitions")), f"{name}_{uuid.uuid4().hex}"
    df.repartition(n, key).write.bucketBy(n, key).option("path", table_path(spark, table)).option("compression", "zstd").saveAsTable(table)
    return spark.table(table)
