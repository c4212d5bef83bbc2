"""Jobs of several steps that can be called again after they ended early.

A job's folder is named by a digest of its plan (its parameters) and of its inputs' rows. Each step is a table there, committed by a pointer file when it
is whole (``sources.once``); the pointers are the manifest of finished steps. Called again, a job reads what is there and makes the rest; with
other rows or parameters it is another job.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.once import build_once, committed_names


def rows_digest(df: DataFrame) -> list[str]:
    """Count and two order-independent sums of the rows' 64-bit hashes: equal for equal tables, however they are split. One aggregate."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    r = df.select(h.alias("h")).agg(F.count(F.lit(1)), F.sum(F.col("h").cast("decimal(38,0)")), F.bit_xor("h")).first()
    return [str(x) for x in r] + [df.schema.simpleString()]


class Steps:
    """Steps of one job below ``folder``."""

    def __init__(self, spark: SparkSession, folder: str, plan: dict, inputs: dict[str, DataFrame]):
        told = {"plan": plan, "inputs": {n: rows_digest(d) for n, d in inputs.items()}}
        self.spark = spark
        self.path = f"{folder}/{hashlib.sha256(json.dumps(told, sort_keys=True).encode()).hexdigest()[:32]}"

    def table(self, step: str, build: Callable[[], DataFrame]) -> DataFrame:
        """The step's table, built if it isn't there."""
        return build_once(self.spark, build, f"{self.path}/{step}")

    def finished(self) -> list[str]:
        """The manifest: names of the steps that are there."""
        return committed_names(self.spark, self.path)
