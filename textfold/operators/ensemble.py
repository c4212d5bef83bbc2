"""Fold labels, final labels, pseudo-label averaging, votes and agreements.

Input predictions are long: ``row_id, model, fold, logit``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.numeric import decide, sigmoid


def to_wide(pred: DataFrame, models: Sequence[str], key: str = "row_id", by: Sequence[str] = ("fold",)) -> DataFrame:
    """One column per model (the model list is given, so no extra pass to find it)."""
    return pred.groupBy(key, *by).pivot("model", list(models)).agg(F.max("logit"))


def fold_labels(pred: DataFrame, key: str = "row_id", weights: DataFrame | None = None) -> DataFrame:
    """Per (row, fold), mean over models, or ``sum(w * logit)`` with a ``(model, w)`` table."""
    if weights is None:
        return pred.groupBy(key, "fold").agg(F.avg("logit").alias("target"))
    j = pred.join(F.broadcast(weights.select("model", "w")), "model")
    return j.groupBy(key, "fold").agg(F.sum(F.col("w") * F.col("logit")).alias("target"))


def final_labels(pred: DataFrame, key: str = "row_id", weights: DataFrame | None = None) -> DataFrame:
    """Mean over folds per model, then mean (or weighted sum) over models."""
    per_model = pred.groupBy(key, "model").agg(F.avg("logit").alias("m"))
    if weights is None:
        return per_model.groupBy(key).agg(F.avg("m").alias("target"))
    j = per_model.join(F.broadcast(weights.select("model", "w")), "model")
    return j.groupBy(key).agg(F.sum(F.col("w") * F.col("m")).alias("target"))


def attach_labels(src: DataFrame, labels: DataFrame, key: str = "row_id") -> DataFrame:
    """All source columns plus ``target``, one copy per fold (a key join, not positional)."""
    return src.join(labels.select(key, "fold", "target"), key)


def average_pseudo(labels: DataFrame, n_folds: int = 5, key: str = "row_id") -> DataFrame:
    """``(t0 + ... + t{k-1}) / k`` per row; null if any fold's label is null or missing."""
    s = labels.groupBy(key).agg(F.count("target").alias("__nn"), F.count(F.lit(1)).alias("__n"),
                                F.sum("target").alias("__s"))
    ok = (F.col("__nn") == n_folds) & (F.col("__n") == n_folds)
    return s.select(key, F.when(ok, F.col("__s") / F.lit(float(n_folds))).alias("target"))


def vote(pred: DataFrame, key: str = "row_id") -> DataFrame:
    """Per row, majority vote of hard decisions (a tie gives 0), soft vote of
    mean sigmoid, the mean probability, and whether all models agree."""
    d = pred.withColumn("__d", decide(F.col("logit")))
    return d.groupBy(key).agg(
        (F.avg("__d") > 0.5).cast("int").alias("vote"),
        (F.avg(sigmoid(F.col("logit"))) > 0.5).cast("int").alias("soft_vote"),
        F.avg(sigmoid(F.col("logit"))).alias("mean_prob"),
        (F.min("__d") == F.max("__d")).cast("int").alias("unanimous"),
        F.count(F.lit(1)).alias("n_models"))


def unanimity(pred: DataFrame, key: str = "row_id") -> DataFrame:
    """Number of rows on which all predictions agree, and the total."""
    v = vote(pred, key)
    return v.agg(F.sum("unanimous").alias("n_unanimous"), F.count(F.lit(1)).alias("n_rows"))


def agreement(a: DataFrame, b: DataFrame, col_a: str = "vote", col_b: str = "soft_vote",
              key: str = "row_id") -> DataFrame:
    """How many rows two decision columns agree on, and the total."""
    j = a.select(key, F.col(col_a).alias("__a")).join(b.select(key, F.col(col_b).alias("__b")), key)
    return j.agg(F.sum((F.col("__a") == F.col("__b")).cast("int")).alias("n_equal"),
                 F.count(F.lit(1)).alias("n_rows"))


def agreement_by_length(a: DataFrame, b: DataFrame, lengths: DataFrame, col: str = "vote",
                        edge: int = 32, key: str = "row_id") -> DataFrame:
    """Agreement of two decision runs per length bucket (``<=edge`` / ``>edge``)."""
    from .filters import length_bucket

    j = (a.select(key, F.col(col).alias("__a")).join(b.select(key, F.col(col).alias("__b")), key)
          .join(lengths.select(key, "n_tokens"), key))
    return (j.groupBy(length_bucket(F.col("n_tokens"), [edge]).alias("bucket"))
             .agg(F.sum((F.col("__a") == F.col("__b")).cast("int")).alias("n_equal"),
                  F.count(F.lit(1)).alias("n_rows")))


def route_by_length(short: DataFrame, long: DataFrame, lengths: DataFrame, col: str = "vote",
                    edge: int = 32, key: str = "row_id") -> DataFrame:
    """Rows up to ``edge`` tokens take the short model's answer, longer rows the long model's."""
    j = (lengths.select(key, "n_tokens").join(short.select(key, F.col(col).alias("__s")), key)
                .join(long.select(key, F.col(col).alias("__l")), key))
    return j.select(key, F.when(F.col("n_tokens") <= edge, F.col("__s")).otherwise(F.col("__l")).alias(col))
