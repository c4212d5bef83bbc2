"""Fold modelling and pseudo-label cycles (I1-I4), re-aimed on Spark.

I1 fits one Spark ML pipeline per fold on ``kfold <> f`` over a single written and cached
feature table and predicts the held-out fold. I2/I3 chain teacher scoring (G1),
fold labels (G4/G9), the mix with out-of-fold training rows (D4) and a student
fit. I4 runs a plan of cycles with a Parquet table between cycles, written under
the shared checkpoint folder so a lost executor never loses a finished cycle.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..session import table_path
from . import ensemble, scoring


def fit_folds(df: DataFrame, tokens_col: str, label: str, k: int = 5, task: str = "classification",
              key: str = "row_id", fold_col: str = "kfold", num_features: int = 1 << 16,
              max_iter: int = 20, reg: float = 0.01) -> DataFrame:
    """HashingTF + IDF + logistic/linear regression, one fit per fold, out-of-fold predictions.

    Returns ``row_id, fold, logit`` (``prediction`` for regression) for every row, scored by the
    model that did not see it.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, IDF
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import LinearRegression

    base = df.select(key, fold_col, F.col(label).cast("double").alias("__y"), tokens_col)
    tf = HashingTF(inputCol=tokens_col, outputCol="__tf", numFeatures=num_features).transform(base).select(key, fold_col, "__y", "__tf")
    # Written by fold: the rows are made once, and a fold's predictions read its own rows only.
    path = table_path(df.sparkSession, f"fold-features-{uuid.uuid4().hex}")
    tf.write.partitionBy(fold_col).parquet(path)
    features = df.sparkSession.read.schema(tf.schema).parquet(path)
    tf = features.persist()
    out = None
    for f in range(k):
        train = tf.filter(F.col(fold_col) != f)
        if task == "classification":
            est = LogisticRegression(featuresCol="__x", labelCol="__y", maxIter=max_iter, regParam=reg)
        else:
            est = LinearRegression(featuresCol="__x", labelCol="__y", maxIter=max_iter, regParam=reg)
        model = Pipeline(stages=[IDF(inputCol="__tf", outputCol="__x"), est]).fit(train)
        pred = model.transform(features.filter(F.col(fold_col) == f))
        if task == "classification":
            score = vector_to_array("rawPrediction")[1]
        else:
            score = F.col("prediction")
        p = pred.select(key, F.lit(f).alias("fold"), score.alias("logit"))
        out = p if out is None else out.unionByName(p)
    # The fits are done; the predictions read the features as they were written.
    tf.unpersist()
    return out


def _milli(preds: DataFrame) -> DataFrame:
    """Use the exact integer logits for pseudo-label decisions: averages of integer-valued
    doubles keep an exact zero at zero, so a tie never flips with the summation order."""
    return preds.withColumn("logit", F.col("logit_milli").cast("double"))


def _bound(vocab: DataFrame, weights: DataFrame) -> int:
    """Most rows of a weight table: one per token, and the bias, of each (model, fold)."""
    return (vocab.count() + 1) * weights.select("model", "fold").distinct().count()


def _student(train_rows: DataFrame, tokens_col: str, vocab: DataFrame, model: str) -> DataFrame:
    """Fit token weights on all given rows (one 'fold' that holds out nothing)."""
    t = train_rows.withColumn("__kf", F.lit(-1))
    w = scoring.fit_token_weights(t, tokens_col, "label", vocab, k=1, models=(model,), fold_col="__kf")
    return w


def _students(pseudo: DataFrame, train: DataFrame, tokens_col: str, vocab: DataFrame, k: int, times: int, model: str) -> DataFrame:
    """A student per fold f of the rows of ``pseudo`` whose ``signs`` has 0 or 1 at place f and ``times`` copies (D4) of the training
    rows outside fold f, from one pass over each: rows with equal signs, or of one fold and label, are counted together."""
    own = scoring.class_token_stats(pseudo.withColumn("__kf", F.lit(-1)), tokens_col, "signs", vocab, "__kf")
    known = scoring.class_token_stats(train, tokens_col, "label", vocab, "kfold")

    def adds(m: str, y: int, f: int, stats: str):
        if stats == "own":
            return F.when(F.substring("signs", f + 1, 1) == str(y), F.col(m)).otherwise(F.lit(0))
        return F.when((F.col("label") == y) & (F.col("kfold") != f), F.col(m) * times).otherwise(F.lit(0))
    names = [(m, y, f) for m in "cd" for y in (0, 1) for f in range(k)]
    each = [s.select("token", *[adds(m, y, f, kind).cast("bigint").alias(f"{m}{y}_{f}") for m, y, f in names]) for s, kind in ((own, "own"), (known, "train"))]
    sums = each[0].unionByName(each[1]).groupBy("token").agg(*[F.sum(f"{m}{y}_{f}").alias(f"{m}{y}_{f}") for m, y, f in names])
    return scoring.weights_of_sums(sums, vocab, k, (model,))


def pseudo_cycle(train: DataFrame, extra: DataFrame, teacher_weights: DataFrame, vocab: DataFrame,
                 tokens_col: str = "toks", k: int = 5, times: int = 3, model: str = "nb",
                 key: str = "row_id") -> DataFrame:
    """Fold-isolated pseudo-labelling.

    Teacher fold f labels the extra rows; student f trains on those labels plus
    ``times`` copies of the training rows outside fold f, and is validated on fold f.
    Pseudo labels are hard decisions of the teacher's fold-f logit. Returns the
    student weights (``model, fold, token, w``) for every fold.

    All folds' students come from one pass: an extra row carries one sign per fold, and copies are counted, not made.
    """
    preds = _milli(scoring.score_linear(extra, tokens_col, teacher_weights, key, weights_bound=_bound(vocab, teacher_weights)))
    labels = ensemble.fold_labels(preds, key)
    sign = (F.col("target") > 0).cast("int")
    signs = [F.coalesce(F.max(F.when(F.col("fold") == f, sign)).cast("string"), F.lit("-")) for f in range(k)]
    pseudo = extra.select(key, tokens_col).join(labels.groupBy(key).agg(F.concat(*signs).alias("signs")), key)
    return _students(pseudo, train, tokens_col, vocab, k, times, model)


def pseudo_single(train: DataFrame, extra: DataFrame, teacher_weights: DataFrame, vocab: DataFrame,
                  tokens_col: str = "toks", k: int = 5, model: str = "nb", key: str = "row_id") -> DataFrame:
    """One student on the *average* of the k teachers' labels (G9), then reused for every fold.

    Reproduces the reference's cycle 2-3 behaviour, where fold isolation is lost
    (every teacher saw every training row but its own fold). Returns weights per fold.
    """
    preds = _milli(scoring.score_linear(extra, tokens_col, teacher_weights, key, weights_bound=_bound(vocab, teacher_weights)))
    avg = ensemble.average_pseudo(ensemble.fold_labels(preds, key), n_folds=k)
    pseudo = (extra.select(key, tokens_col).join(avg.filter(F.col("target").isNotNull()), key)
                   .withColumn("label", (F.col("target") > 0).cast("int")).select(key, tokens_col, "label"))
    w = _student(pseudo, tokens_col, vocab, model)
    # the same bounded weight table for every fold
    return w.drop("fold").withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))


def run_cycles(plan: Sequence[str], train: DataFrame, extra: DataFrame, teacher_weights: DataFrame,
               vocab: DataFrame, tokens_col: str = "toks", k: int = 5, path: str | None = None) -> DataFrame:
    """I4: run ``plan`` (e.g. ``['fold_wise', 'averaged', 'averaged']``); each cycle's students
    teach the next. Weights are written as Parquet between cycles when ``path`` is given."""
    spark = train.sparkSession
    w = teacher_weights
    for i, step in enumerate(plan):
        if step == "fold_wise":
            w = pseudo_cycle(train, extra, w, vocab, tokens_col, k)
        elif step == "averaged":
            w = pseudo_single(train, extra, w, vocab, tokens_col, k)
        else:
            raise ValueError(f"unknown cycle {step!r}")
        if path:
            w.write.mode("overwrite").parquet(f"{path}/cycle={i}")
            w = spark.read.parquet(f"{path}/cycle={i}")
    return w
