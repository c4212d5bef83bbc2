"""Exact global positions and prefix sums without an unpartitioned window.

A ``row_number()`` or running ``sum`` over a whole table (or over a few strata)
runs in one task. Here the order is cut into *buckets* that are monotone in the
sort order:

* for an md5 hex key, the first ``digits`` hex characters (16**digits uniform
  buckets, so even a stratum holding most rows is spread over many tasks);
* for any numeric order column, quantile split points computed once and fixed
  into the plan as literals (``Bucketizer``-style binary search, JVM side).

Per-bucket totals form a small table (groups x buckets rows); an exclusive
running sum over that table gives each bucket's offset, which is joined back
(broadcast, its size is bounded by construction) and added to a window that is
partitioned by ``(group, bucket)``. The result is identical to the plain global
window, whatever the bucket boundaries are.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

# Broadcast the bucket-offset table only while it is provably small.
MAX_BROADCAST_BUCKET_ROWS = 4_000_000


# Target size of the bucket-offset table (groups x 16**digits rows, broadcast).
BUCKET_TABLE_BUDGET = 1 << 20


def digits_for_groups(groups_bound: int | None, cap: int = 4) -> int:
    """Most hex digits (2..cap) whose bucket table, groups x 16**digits, stays within the budget.

    One group gets 65,536 buckets, two to sixteen groups 65,536 each, 64 Sturges bins
    4,096 each: at 1e11 rows a window partition then holds about 1.5 M rows, and the
    broadcast offset table stays near a million rows. Unknown group counts get 3.
    """
    if groups_bound is None:
        return 3
    d = 2
    while d < cap and groups_bound * 16 ** (d + 1) <= BUCKET_TABLE_BUDGET:
        d += 1
    return d


def _null_safe_join(left: DataFrame, right: DataFrame, cols: Sequence[str], broadcast_right: bool) -> DataFrame:
    r = right
    renamed = {c: f"__r_{c}" for c in cols}
    for c, rc in renamed.items():
        r = r.withColumnRenamed(c, rc)
    if broadcast_right:
        r = F.broadcast(r)
    cond = None
    for c, rc in renamed.items():
        e = left[c].eqNullSafe(r[rc])
        cond = e if cond is None else cond & e
    return left.join(r, cond, "inner").drop(*renamed.values())


def ordered_prefix(df: DataFrame, bucket: Column, order: Sequence[Column], by: Sequence[str] = (),
                   weight: Column | None = None, out: str = "_pos", groups_bound: int | None = 1,
                   buckets_bound: int = 16 ** 3) -> DataFrame:
    """Add ``out`` = exclusive running total of ``weight`` (default 1, i.e. the 0-based rank)
    in the order ``order`` within each group ``by``.

    ``bucket`` must be monotone in ``order`` (a bucket never interleaves with another).
    ``groups_bound`` is the caller's proven bound on the number of distinct ``by`` values;
    when it is ``None`` the offset join is left to AQE's runtime size check.
    """
    by = list(by)
    w_expr = F.lit(1).cast("bigint") if weight is None else weight.cast("bigint")
    d = df.withColumn("__bkt", bucket).withColumn("__w", w_expr)
    totals = d.groupBy(*by, "__bkt").agg(F.sum("__w").alias("__tot"))
    # The bucket table is small (groups x buckets), so this window is cheap.
    wb = Window.partitionBy(*by).orderBy("__bkt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "__bkt", F.coalesce(F.sum("__tot").over(wb), F.lit(0)).cast("bigint").alias("__off"))
    small = groups_bound is not None and groups_bound * buckets_bound <= MAX_BROADCAST_BUCKET_ROWS
    d = _null_safe_join(d, offsets, [*by, "__bkt"], broadcast_right=small)
    wr = Window.partitionBy(*by, "__bkt").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn(out, (F.col("__off") + F.sum("__w").over(wr) - F.col("__w")).cast("bigint"))
    return d.drop("__bkt", "__w", "__off")


def hash_rank(df: DataFrame, key: str, tiebreak: str = "row_id", by: Sequence[str] = (),
              out: str = "_rank", digits: int | None = None, groups_bound: int | None = 1,
              weight: Column | None = None) -> DataFrame:
    """0-based position in the order ``(key, tiebreak)`` within ``by``; ``key`` is an md5 hex string.

    ``digits`` (bucket = first ``digits`` hex characters) defaults to ``digits_for_groups``.
    """
    digits = digits or digits_for_groups(groups_bound)
    return ordered_prefix(df, F.substring(F.col(key), 1, digits), [F.col(key), F.col(tiebreak)], by,
                          weight=weight, out=out, groups_bound=groups_bound, buckets_bound=16 ** digits)


def with_range_bucket(df: DataFrame, col: str, splits: Sequence[float], out: str = "__rb") -> DataFrame:
    """Add ``out`` = number of split points <= ``col`` (binary search in the JVM via ``Bucketizer``)."""
    if not splits:
        return df.withColumn(out, F.lit(0))
    from pyspark.ml.feature import Bucketizer

    tmp = out + "_in"
    b = Bucketizer(splits=[-math.inf, *splits, math.inf], inputCol=tmp, outputCol=out + "_d", handleInvalid="keep")
    d = b.transform(df.withColumn(tmp, F.col(col).cast("double")))
    return d.withColumn(out, F.col(out + "_d").cast("int")).drop(tmp, out + "_d")


ROWS_PER_BUCKET = 1_000_000


def range_buckets(base: DataFrame, order: Sequence[str], n_buckets: int | None = None,
                  second_range: tuple[float, float] | None = None) -> tuple[list[float], dict[float, list[float]]]:
    """Split points for ``range_rank``, computed once on ``base``: quantiles of the first order column and, for a value that
    fills several quantiles (a large tie), split points of the second column among its rows.

    ``n_buckets`` follows from the number of rows. ``second_range`` says that the second column is spread evenly over a range,
    whatever the first one is (a shuffled position); without it, its quantiles among the tied rows are taken.
    """
    if n_buckets is None:
        n_buckets = max(16, math.ceil(base.count() / ROWS_PER_BUCKET))
    qs = [float(q) for q in base.approxQuantile(order[0], [i / n_buckets for i in range(1, n_buckets)], 0.2 / n_buckets) if q is not None]
    ties: dict[float, list[float]] = {}
    for v in set(qs):
        m = qs.count(v)
        if m > 1 and len(order) > 1:
            if second_range is not None:
                lo, hi = second_range
                ties[v] = [lo + (hi - lo) * i / (m + 1) for i in range(1, m + 1)]
            else:
                rows = base.filter(F.col(order[0]).cast("double") == v)
                ties[v] = sorted(set(rows.approxQuantile(order[1], [i / (m + 1) for i in range(1, m + 1)], 0.2 / (m + 1))))
    return sorted(set(qs)), ties


def range_rank(df: DataFrame, order: Sequence[str], out: str = "_rank", by: Sequence[str] = (),
               n_buckets: int | None = None, weight: Column | None = None, groups_bound: int | None = 1,
               splits: tuple[list[float], dict[float, list[float]]] | None = None) -> DataFrame:
    """Exclusive running total (default: 0-based rank) in the order of numeric columns ``order``.

    Buckets are ranges of the first column; a large tie in it is cut by the second column (``range_buckets``), so no bucket
    holds more than its share whatever the values are.
    """
    points, ties = splits or range_buckets(df, order, n_buckets)
    d = with_range_bucket(df, order[0], points, out="__rb")
    if ties:
        first, second = F.col(order[0]).cast("double"), F.col(order[1]).cast("double")
        most = max(map(len, ties.values())) + 2
        part = F.lit(most - 1)  # rows above a tied value in its bucket come after its parts
        for v, cuts in ties.items():
            part = F.when(first == v, sum(((second >= c).cast("int") for c in cuts), F.lit(0))).otherwise(part)
        d = d.withColumn("__rb", F.col("__rb") * most + part)
        size = (len(points) + 1) * most
    else:
        size = len(points) + 1
    res = ordered_prefix(d, F.col("__rb"), [F.col(c) for c in order], by,
                         weight=weight, out=out, groups_bound=groups_bound, buckets_bound=size)
    return res.drop("__rb")
