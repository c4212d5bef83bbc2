"""Deterministic, engine-portable pseudo-randomness.

A row's random draw is a pure function of the seed and its key, never of the
partitioning, so re-running a task after an executor loss gives the same rows.
``md5`` hex and the first 8 hex digits as an unsigned 32-bit integer are the
same in Spark and in DuckDB, which lets the SQL oracle restate every draw.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

TWO32 = 1 << 32


def hash_key(*parts) -> Column:
    """``md5(p1 || '|' || p2 || ...)`` as a lowercase hex string."""
    cols = [F.lit(p) if not isinstance(p, Column) else p for p in parts]
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]))


def uniform32(*parts) -> Column:
    """Unsigned 32-bit integer in [0, 2^32) from the first 8 hex digits of ``hash_key``.

    Compare against integer thresholds (``u < p * 2^32``) so both engines agree exactly.
    """
    return F.conv(F.substring(hash_key(*parts), 1, 8), 16, 10).cast("bigint")
