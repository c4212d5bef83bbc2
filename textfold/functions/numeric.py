"""Numeric column helpers shared by ensembles and metrics."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def decide(logit: Column, threshold: float = 0.0) -> Column:
    """Hard 0/1 decision ``logit > threshold``."""
    return (logit > F.lit(threshold)).cast("int")


def bce_with_logits(logit: Column, label: Column) -> Column:
    """Numerically stable binary cross-entropy on logits."""
    return F.greatest(logit, F.lit(0.0)) - logit * label + F.log1p(F.exp(-F.abs(logit)))
