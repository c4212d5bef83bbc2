"""I1 exactly: ridge regression of every fold from one pass, by normal equations.

With x a row's features after a leading 1 and y its target, the matrix of all products of (x, y) holds all that a least-squares fit needs. A
task sums its rows' products per fold, a block of rows at a time; the partial matrices are added in two levels, row by row of the
matrix, so that no task adds more than about the square root of their number. Fold f's training matrix is the total minus its own, hence the
data is read once for all folds and copied for none. The systems are solved one fold a task, and out-of-fold predictions need one row of
weights per fold. For integer features and targets the sums are exact (below 2**53), whatever the order of the rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

# The matrices of a task take folds x features squared x 8 bytes; weights of all folds are sent to every task.
MAX_FEATURES = 2000
BLOCK_ROWS = 4096


def _blocks(batch: pa.RecordBatch, d: int):
    for a in range(0, batch.num_rows, BLOCK_ROWS):
        part = batch.slice(a, BLOCK_ROWS)
        x = part["x"]
        if x.null_count or len(x.flatten()) != d * len(x):
            raise ValueError(f"every row needs {d} features")
        flat = x.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
        y = part["y"].to_numpy(zero_copy_only=False)
        yield part["fold"].to_numpy(zero_copy_only=False), np.column_stack((np.ones(len(y)), flat, y))


def _partial(d: int, k: int):
    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for fold, z in _blocks(batch, d):
                for f in np.unique(fold).tolist():
                    rows = z[fold == f]
                    total[f] = total.get(f, 0) + rows.T @ rows
        folds = [f for f in total for _ in range(d + 2)]
        index = [i for _ in total for i in range(d + 2)]
        values = [row for m in total.values() for row in m]
        yield pa.RecordBatch.from_arrays([pa.array(folds, pa.int32()), pa.array(index, pa.int32()), pa.array(values, pa.list_(pa.float64()))],
                                         ["fold", "i", "v"])
    return run


def _add(df: DataFrame, *by: str) -> DataFrame:
    """Sums of the arrays ``v`` of each group, place by place."""
    def run(table: pa.Table) -> pa.Table:
        n = len(table["v"][0])
        total = table["v"].combine_chunks().flatten().to_numpy().reshape(-1, n).sum(axis=0)
        return pa.table([*[table[c].slice(0, 1) for c in by], pa.array([total], pa.list_(pa.float64()))], names=[*by, "v"])
    kinds = dict(df.dtypes)
    return df.select(*by, "v").groupBy(*by).applyInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in by) + ", v array<double>")


def products(rows: DataFrame, features: Column, target: Column, n_features: int, k: int, fold_col: str = "kfold",
             most_partials: int | None = None) -> DataFrame:
    """``(fold, i, v)``: row i of fold's matrix of products of (1, features, target), over the rows of the fold itself."""
    if n_features > MAX_FEATURES:
        raise ValueError(f"at most {MAX_FEATURES} features")
    d = rows.select(F.col(fold_col).cast("int").alias("fold"), features.cast("array<double>").alias("x"), target.cast("double").alias("y"))
    # A task's partial matrices don't grow with its rows, so no more tasks than the cluster runs in a few waves.
    most = most_partials or 4 * rows.sparkSession.sparkContext.defaultParallelism
    d = d.coalesce(most)
    parts = d.mapInArrow(_partial(n_features, k), "fold int, i int, v array<double>")
    group = F.pmod(F.spark_partition_id(), F.lit(max(1, math.isqrt(most))))
    return _add(_add(parts.withColumn("g", group), "fold", "i", "g"), "fold", "i")


def _solve(d: int, penalty: float):
    def run(table: pa.Table) -> pa.Table:
        m = np.zeros((d + 2, d + 2))
        m[table["i"].to_numpy()] = np.array(table["v"].to_pylist())
        ridge = np.full(d + 1, penalty)
        ridge[0] = 0.0  # the constant isn't shrunk
        w = np.linalg.solve(m[:-1, :-1] + np.diag(ridge), m[:-1, -1])
        return pa.table({"w_fold": pa.array([table["f"][0].as_py()], pa.int32()), "w": pa.array([w], pa.list_(pa.float64()))})
    return run


def fit_ridge(rows: DataFrame, features: Column, target: Column, n_features: int, k: int, penalty: float = 1.0, fold_col: str = "kfold") -> DataFrame:
    """``(w_fold, w)``: the constant and the features' weights of fold's model, fitted on the rows outside the fold. k rows."""
    own = products(rows, features, target, n_features, k, fold_col)
    # Total minus own: every fold's rows count for the models of all other folds.
    to = F.explode(F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda f: f != F.col("fold"))).alias("f")
    return _add(own.select(to, "i", "v"), "f", "i").groupBy("f").applyInArrow(_solve(n_features, penalty), "w_fold int, w array<double>")


def predict_ridge(rows: DataFrame, features: Column, models: DataFrame, fold_col: str = "kfold", out: str = "prediction") -> DataFrame:
    """Each row by the model of its own fold, which hasn't seen it."""
    d = rows.join(F.broadcast(models), F.col(fold_col) == F.col("w_fold"))
    x = F.concat(F.array(F.lit(1.0)), features.cast("array<double>"))
    score = F.aggregate(F.zip_with(x, F.col("w"), lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
    return d.withColumn(out, score).drop("w_fold", "w")
