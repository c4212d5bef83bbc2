"""Batch assignment and length-bucketed block shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.hashing import hash_key
from ..plans.ordering import hash_rank, range_buckets, range_rank
from .folds import row_count


def assign_batches(df: DataFrame, order_key: str, bs: int, key: str = "row_id",
                   digits: int | None = None) -> DataFrame:
    """``position`` in the order of an md5 key and ``batch = position div bs`` (last batch short)."""
    d = hash_rank(df, order_key, tiebreak=key, out="position", digits=digits)
    return d.withColumn("batch", F.floor(F.col("position") / bs).cast("bigint"))


def block_shuffle(df: DataFrame, bs: int, length_col: str, order_key: str, key: str = "row_id",
                  sort_bs_num: int | None = None, shuffle: bool = True, seed: int = 42,
                  digits: int | None = None) -> DataFrame:
    """Length-bucketed batches.

    Rows are taken in the order of ``order_key`` (an md5 hex key). The last
    ``n mod bs`` rows form the tail. The rest is cut into blocks of
    ``sort_bs_num * bs`` rows (one block if ``None``); inside a block rows are
    sorted by length descending (stable), then cut into batches of ``bs``.
    Batches are reordered by ``md5(seed|batch)`` when ``shuffle``; the tail goes last.
    Adds ``batch`` (final batch number), ``position`` (final 0-based position).
    """
    n = row_count(df)
    d = hash_rank(df, order_key, tiebreak=key, out="__r", digits=digits)
    n_full = n - (n % F.lit(bs))
    d = d.withColumn("__tail", F.col("__r") >= n_full)
    body = d.filter(~F.col("__tail"))
    if sort_bs_num is None:
        # One block over all rows: a distributed range sort, never one window partition.
        # Split points come from the base table; ties in length are cut by the shuffled position.
        neg = -F.col(length_col).cast("bigint")
        splits = range_buckets(df.select(neg.alias("__neg")), ["__neg", "__r"], second_range=(0.0, float(df.count())))
        body = range_rank(body.withColumn("__neg", neg), ["__neg", "__r"], out="__g", splits=splits).drop("__neg")
    else:
        blk = sort_bs_num * bs  # a block is bounded, so a window per block is cheap
        body = body.withColumn("__blk", F.floor(F.col("__r") / blk))
        w = Window.partitionBy("__blk").orderBy(F.desc(length_col), F.asc("__r"))
        body = body.withColumn("__g", F.col("__blk") * blk + F.row_number().over(w) - 1).drop("__blk")
    body = body.withColumn("__b", F.floor(F.col("__g") / bs))
    if shuffle:
        batches = body.select("__b").distinct().withColumn("__bk", hash_key(F.lit(seed), F.col("__b")))
        batches = hash_rank(batches.withColumn("__bs", F.col("__b").cast("string")), "__bk", tiebreak="__bs",
                            out="__bo", digits=digits).select("__b", "__bo")
        body = body.join(batches, "__b")
    else:
        body = body.withColumn("__bo", F.col("__b"))
    body = body.withColumn("batch", F.col("__bo").cast("bigint")).withColumn(
        "position", (F.col("__bo") * bs + F.col("__g") % bs).cast("bigint"))
    tail = (d.filter(F.col("__tail"))
             .withColumn("batch", F.floor(n_full / bs).cast("bigint"))
             .withColumn("position", F.col("__r").cast("bigint")))
    cols = [c for c in df.columns] + ["batch", "position"]
    return body.select(*cols).unionByName(tail.select(*cols))
