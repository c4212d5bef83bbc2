"""A9 and A10 with files of bounded size: how many rows each (fold, model) has decides how many files it gets.

``partitionBy`` alone writes one file per task and folder, so thousands of tasks and a few folds make tens of thousands of small
files. Here groups are counted first (a row per group), each gets ``ceil(rows / rows_per_file)`` files, and a row's rank in its group, by a hash of
its key, says in which file it is. A task writes consecutive files, up to ``FILES_PER_TASK``, and begins a new one after so many rows: no file is
written by two tasks, none is larger than asked for, and what tasks tell the driver does not grow with the files.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..plans.local import to_local
from ..plans.ordering import _null_safe_join, hash_rank

MAX_GROUPS = 100_000
FILL = 0.9  # of the rows asked for at most, a file gets so many
FILES_PER_TASK, ROWS_PER_TASK = 1000, 1_000_000


def file_table(df: DataFrame, by: Sequence[str], rows_per_file: int) -> DataFrame:
    """``by``, n_files, first_file: how many files each group gets, numbered from 0 over all groups; a local table."""
    counts = to_local(df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")), MAX_GROUPS)
    rows, first = [], 0
    for r in sorted(counts.collect(), key=lambda r: tuple((r[c] is not None, r[c]) for c in by)):
        n = max(1, -(-r["n"] // max(1, int(rows_per_file * FILL))))
        rows.append((*[r[c] for c in by], n, first))
        first += n
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)
    return df.sparkSession.createDataFrame(rows, f"{kinds}, n_files bigint, first_file bigint")


def write_sized(df: DataFrame, path: str, by: Sequence[str], key: str | Sequence[str] = "row_id", rows_per_file: int = 1_000_000,
                mode: str = "overwrite") -> None:
    """Parquet folders by ``by``, each of as many files of about ``rows_per_file`` rows as it needs. ``key`` tells rows apart."""
    files = file_table(df, by, rows_per_file)
    total = files.agg(F.sum("n_files")).first()[0]
    if not total:  # no rows: an empty table with the columns
        return df.write.mode(mode).partitionBy(*by).parquet(path)
    keys = [key] if isinstance(key, str) else list(key)
    per_file = max(1, int(rows_per_file * FILL))
    together = min(FILES_PER_TASK, max(1, ROWS_PER_TASK // per_file), -(-int(total) // df.sparkSession.sparkContext.defaultParallelism))
    ranked = hash_rank(df.withColumn("__h", F.md5(F.to_json(F.struct(*keys)))), "__h", tiebreak="__h", by=by, out="__at", groups_bound=files.count())
    dealt = _null_safe_join(ranked, files, by, broadcast_right=True)
    dealt = dealt.withColumn("__file", F.col("first_file") + F.floor(F.col("__at") / per_file)).withColumn("__task", F.floor(F.col("__file") / together).cast("int"))
    dealt = dealt.repartitionById(-(-int(total) // together), "__task").sortWithinPartitions(*by, "__file")
    dealt = dealt.drop("__h", "__at", "__task", "__file", "n_files", "first_file")
    dealt.write.mode(mode).option("maxRecordsPerFile", per_file).partitionBy(*by).parquet(path)
