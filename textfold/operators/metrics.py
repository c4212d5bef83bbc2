"""Evaluation metrics (H1-H7)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import bce_with_logits, decide
from .batching import assign_batches


def rmse(df: DataFrame, pred: str, target: str, by: Sequence[str] = ()) -> DataFrame:
    """H1: ``sqrt(mean((y - p)^2))`` (and the MSE) per group."""
    sq = F.pow(F.col(target) - F.col(pred), 2)
    return df.groupBy(*by).agg(F.avg(sq).alias("mse"), F.sqrt(F.avg(sq)).alias("rmse"))


def batch_rmse(df: DataFrame, pred: str, target: str, bs: int, order_key: str, key: str = "row_id",
               by: Sequence[str] = ()) -> DataFrame:
    """H2: ``sqrt(mean over batches of the batch's sum of squared errors)`` (differs from H1)."""
    b = assign_batches(df, order_key, bs, key=key) if not by else _batches_by(df, order_key, bs, key, by)
    per = b.groupBy(*by, "batch").agg(F.sum(F.pow(F.col(target) - F.col(pred), 2)).alias("__sse"))
    return per.groupBy(*by).agg(F.sqrt(F.avg("__sse")).alias("batch_rmse"))


def _batches_by(df, order_key, bs, key, by):
    from ..plans.ordering import hash_rank

    d = hash_rank(df, order_key, tiebreak=key, by=by, out="position", groups_bound=None)
    return d.withColumn("batch", F.floor(F.col("position") / bs))


def bce(df: DataFrame, logit: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """H3: mean binary cross-entropy with logits."""
    return df.groupBy(*by).agg(F.avg(bce_with_logits(F.col(logit), F.col(label).cast("double"))).alias("bce"))


def batch_bce(df: DataFrame, logit: str, label: str, bs: int, order_key: str, key: str = "row_id",
              by: Sequence[str] = ()) -> DataFrame:
    """H4: each row carries its batch's BCE *sum*; ``sqrt`` of the mean over rows."""
    b = assign_batches(df, order_key, bs, key=key) if not by else _batches_by(df, order_key, bs, key, by)
    b = b.withColumn("__l", bce_with_logits(F.col(logit), F.col(label).cast("double")))
    per = b.groupBy(*by, "batch").agg(F.sum("__l").alias("__s"), F.count(F.lit(1)).alias("__n"))
    return per.groupBy(*by).agg(F.sqrt(F.sum(F.col("__s") * F.col("__n")) / F.sum("__n")).alias("batch_bce"))


def oof_rows(pred: DataFrame, truth: DataFrame, label: str = "label", key: str = "row_id",
             fold_col: str = "kfold") -> DataFrame:
    """Keep each row's prediction from the model of its own (held-out) fold, with its label."""
    t = truth.select(key, fold_col, label)
    return pred.join(t, [key]).filter(F.col("fold") == F.col(fold_col)).drop(fold_col)


def oof_accuracy(pred: DataFrame, truth: DataFrame, label: str = "label", key: str = "row_id",
                 fold_col: str = "kfold", by: Sequence[str] = ("model",)) -> DataFrame:
    """H5: out-of-fold accuracy per fold: each row scored by the model of its own fold."""
    return accuracy(oof_rows(pred, truth, label, key, fold_col), label, by)


def accuracy(oof: DataFrame, label: str = "label", by: Sequence[str] = ("model",)) -> DataFrame:
    """H5 on predictions that are out-of-fold already (``scoring.score_own_fold``)."""
    hit = (decide(F.col("logit")) == F.col(label).cast("int")).cast("int")
    return oof.groupBy(*by, "fold").agg(F.avg(hit).alias("accuracy"), F.count(F.lit(1)).alias("n_rows"))


def cv_summary(scores: DataFrame, metric: str, fold_col: str = "fold", by: Sequence[str] = ()) -> DataFrame:
    """H6: mean of fold scores, with the scores in fold order."""
    return scores.groupBy(*by).agg(F.avg(metric).alias(f"mean_{metric}"),
                      F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(fold_col, metric))),
                                               lambda s: F.format_string("%.6f", s[metric])), ",").alias("per_fold"),
                      F.count(F.lit(1)).alias("n_folds"))


def _checkpoint_rule(rule: str, centre: int, radius: int, acc_steps: int) -> Column:
    s = F.col("step")
    if rule == "a":
        return (s >= centre - radius) & (s <= centre + radius) & (((s + 1) % acc_steps) == 0)
    if rule == "b":
        return (F.col("epoch") > 0) & (((s + 1) % (100 * acc_steps)) == 0)
    if rule == "c":
        return (s >= centre - radius) & (((s + 1) % 1000) == 0)
    if rule == "d":
        return ((s + 1) % (100 * acc_steps)) == 0
    raise ValueError(f"unknown rule {rule!r}")


def best_checkpoint(log: DataFrame, rule: str, centre: int = 0, radius: int = 0, acc_steps: int = 1,
                    metric: str = "metric") -> DataFrame:
    """H7: best validation row per fold, strict improvement (the earliest wins a tie).

    Rules: ``a`` step in [centre - radius, centre + radius] at an accumulation boundary, min metric;
    ``b`` epoch > 0 on every ``100 * acc_steps``-th step, min; ``c`` step >= centre - radius on every
    1000th step, max (accuracy); ``d`` every ``100 * acc_steps``-th step, min.
    """
    return best_checkpoints(log, {rule: metric}, centre, radius, acc_steps).select("fold", "epoch", "step", F.col("metric").alias(metric))


def best_checkpoints(log: DataFrame, rules: dict[str, str], centre: int = 0, radius: int = 0, acc_steps: int = 1) -> DataFrame:
    """H7 by several rules, each with its metric's column, from one pass over the log: ``rule, fold, epoch, step, metric``.
    A fold in which no row meets a rule has no row for it."""
    best = []
    for rule, metric in rules.items():
        m = -F.col(metric) if rule == "c" else F.col(metric)
        row = F.struct(m.alias("k"), F.col("epoch"), F.col("step"), F.col(metric).alias("v"))
        best.append(F.min(F.when(_checkpoint_rule(rule, centre, radius, acc_steps), row)).alias(f"best_{rule}"))
    per = log.groupBy("fold").agg(*best)
    each = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"best_{r}").alias("b")) for r in rules])
    return per.select("fold", F.explode(each).alias("x")).filter("x.b IS NOT NULL").select(
        F.col("x.rule").alias("rule"), "fold", "x.b.epoch", "x.b.step", F.col("x.b.v").alias("metric"))
