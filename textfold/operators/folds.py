"""Seeded shuffles, target binning and exact stratified k-fold assignment.

Folds are a pure function of ``(seed, row_id, stratum)``: the shuffle key is
``md5(seed|row_id)``, so the same folds come back after a re-run, a repartition
or an executor loss. The allocation is the published stratified k-fold rule
without shuffling: classes numbered by first appearance in shuffled order, rows
laid out class by class, position ``j`` of that layout counted for fold
``j mod k``, and within a class the first rows go to fold 0, the next to fold 1...
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.hashing import hash_key
from ..plans.ordering import _null_safe_join, hash_rank


def shuffle_key(df: DataFrame, seed: int, key: str = "row_id", out: str = "shuffle_key") -> DataFrame:
    """Add the seeded shuffle key ``md5(seed|key)``; ordering by it is the shuffle."""
    return df.withColumn(out, hash_key(F.lit(seed), F.col(key)))


def shuffle_positions(df: DataFrame, seed: int, key: str = "row_id", out: str = "position",
                      digits: int | None = None) -> DataFrame:
    """E1 with explicit 0-based positions in the shuffled order (no single-task window)."""
    d = shuffle_key(df, seed, key, "__sk")
    return hash_rank(d, "__sk", tiebreak=key, out=out, digits=digits).drop("__sk")


def epoch_order(df: DataFrame, seed: int, epoch: int, key: str = "row_id", out: str = "position",
                digits: int | None = None) -> DataFrame:
    """Per-epoch reshuffle; the key is ``md5(seed|epoch|row_id)``."""
    d = df.withColumn("__ek", hash_key(F.lit(seed), F.lit(epoch), F.col(key)))
    return hash_rank(d, "__ek", tiebreak=key, out=out, digits=digits).drop("__ek")


def row_count(df: DataFrame) -> Column:
    """Number of rows as a lazy scalar subquery (evaluated once per query)."""
    return df.select(F.count(F.lit(1))).scalar()


def sturges_bins(df: DataFrame) -> Column:
    """``floor(1 + log2 n)``, i.e. the bit length of ``n``, as a scalar subquery."""
    n = row_count(df)
    return F.length(F.bin(n)).cast("int")


def cut(df: DataFrame, col: str, bins, out: str = "bin") -> DataFrame:
    """Equal-width, right-closed bins over ``[min, max]`` (first edge open to include min).

    ``bins`` is an int or a scalar Column. A constant column has all rows in bin
    ``ceil(bins/2) - 1``, where the value falls when the range is widened around it.
    """
    k = F.lit(bins) if isinstance(bins, int) else bins
    both = df.select(F.struct(F.min(col).cast("double").alias("mn"), F.max(col).cast("double").alias("mx")).alias("s")).scalar()
    mn, mx = both["mn"], both["mx"]
    x = F.col(col).cast("double")
    b = F.when(mx == mn, F.ceil(k / F.lit(2.0)) - 1).otherwise(
        F.greatest(F.ceil((x - mn) * k / (mx - mn)) - 1, F.lit(0)))
    return df.withColumn(out, F.when(x.isNull(), None).otherwise(b).cast("int"))


def _fold_bounds(cls: DataFrame, k: int) -> DataFrame:
    """Per class: cumulative upper bounds of in-class rank for folds 0..k-1.

    ``q(c, i)`` = number of layout positions ``j`` in ``[s, s+n)`` with ``j mod k = i``
    = ``floor((s+n-1-i)/k) - floor((s-1-i)/k)``.
    """
    s, n = F.col("__s"), F.col("__n")
    cums, acc = [], None
    for i in range(k):
        q = F.floor((s + n - 1 - i) / F.lit(k)) - F.floor((s - 1 - i) / F.lit(k))
        acc = q if acc is None else acc + q
        cums.append(acc)
    largest = F.max("__n").over(Window.partitionBy())  # over the tiny class table
    bounds = F.when(largest < k, F.raise_error(F.lit(
        f"n_splits={k} cannot be greater than the number of members in each class."))
    ).otherwise(F.array(*cums))
    return cls.withColumn("__his", bounds)


def assign_folds(df: DataFrame, strata: str, k: int = 5, seed: int = 42, key: str = "row_id",
                 out: str = "kfold", classes_bound: int | None = None, digits: int | None = None) -> DataFrame:
    """Exact stratified k-fold assignment.

    ``classes_bound`` is a proven bound on the number of strata (e.g. Sturges bins);
    with ``None`` the class table join is sized by AQE at run time.
    Every row keeps its columns and gains ``out`` (int).
    """
    keyed = df.withColumn("__k", hash_key(F.lit(seed), F.col(key)))
    # First appearance in shuffled order = smallest key; a 60-bit integer prefix keeps
    # this a hash aggregate (a string min would sort every row).
    first = F.conv(F.substring("__k", 1, 15), 16, 10).cast("bigint")
    cls = keyed.groupBy(strata).agg(F.count(F.lit(1)).alias("__n"), F.min(first).alias("__first"))
    wcls = Window.orderBy("__first").rowsBetween(Window.unboundedPreceding, -1)
    cls = cls.withColumn("__s", F.coalesce(F.sum("__n").over(wcls), F.lit(0)))
    cls = _fold_bounds(cls, k).select(strata, "__his")
    ranked = hash_rank(keyed, "__k", tiebreak=key, by=[strata], out="__r", digits=digits,
                       groups_bound=classes_bound)
    small = classes_bound is not None and classes_bound <= 100_000
    joined = _null_safe_join(ranked, cls, [strata], broadcast_right=small)
    fold = F.size(F.filter(F.col("__his"), lambda h: h <= F.col("__r")))
    return joined.withColumn(out, fold.cast("int")).drop("__k", "__r", "__his")


def assign_folds_regression(df: DataFrame, target: str, k: int = 5, seed: int = 42,
                            key: str = "row_id", out: str = "kfold") -> DataFrame:
    """strata = Sturges-many equal-width bins of ``target`` (at most 64 strata)."""
    binned = cut(df, target, sturges_bins(df), out="__bin")
    return assign_folds(binned, "__bin", k=k, seed=seed, key=key, out=out, classes_bound=64).drop("__bin")


def fold_split(df: DataFrame, fold: int, part: str, fold_col: str = "kfold") -> DataFrame:
    """Training rows (``kfold <> fold``) or validation rows (``kfold = fold``)."""
    if part not in ("train", "val"):
        raise ValueError("part must be 'train' or 'val'")
    cond = F.col(fold_col) != fold if part == "train" else F.col(fold_col) == fold
    return df.filter(cond)


def all_folds(df: DataFrame, k: int = 5, fold_col: str = "kfold") -> DataFrame:
    """E6 for every fold at once: each row once per fold, tagged ``fold`` and ``part``."""
    d = df.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return d.withColumn("part", F.when(F.col(fold_col) == F.col("fold"), "val").otherwise("train"))


def fold_range(df: DataFrame, start: int, fold_col: str = "kfold") -> DataFrame:
    """Only folds >= start (a partition filter when the table is partitioned by fold)."""
    return df.filter(F.col(fold_col) >= start)
