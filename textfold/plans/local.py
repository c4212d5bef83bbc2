"""Bring a provably small result (a fitted model, a vocabulary) back as a local relation.

Like a fitted Spark ML model, the artefact lives on the driver and is shipped to
tasks by broadcast. The size bound is checked, never assumed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


class TooLargeForLocal(ValueError):
    pass


def to_local(df: DataFrame, max_rows: int) -> DataFrame:
    """Collect at most ``max_rows`` rows and rebuild them as a local DataFrame; raise beyond it."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise TooLargeForLocal(f"expected at most {max_rows} rows")
    return df.sparkSession.createDataFrame(rows, schema=df.schema)
