"""Batch scoring of every row by every (model, fold) in one pass.

Predictions are *long*: ``row_id, model, fold, logit``. The linear scorer
aggregates tokens per row first (``row_id, token, tf``), joins the weight table
(bounded by vocabulary x models x folds, so it may be broadcast) and sums per
``(row_id, model, fold)``; partial aggregation runs before the shuffle. Weights
are fixed-point integers (milli-units), so a row's logit is an exact integer sum
whatever the summation order.

A row's tokens are together already: weights and vocabularies of a checked size go to
the tasks, and a row's sums (or a batch's counts) are made where its tokens are, so no
token occurrence is joined or shuffled. Larger ones are joined, with the same results.

Token-weight models are fitted per fold on ``kfold <> f`` without copying the
data k times: statistics are gathered once per ``(kfold, class, token)``; the
fold-f training statistic is the total minus fold f's own share.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..plans.partitioning import text_batches
from ..session import table_path

BIAS_TOKEN = "\u0000bias"
SCALE = 1000  # fixed-point scale of weights and logits
# Largest weight table (rows) and vocabulary that are sent to the tasks.
MAX_LOCAL_WEIGHTS = 2_000_000
MAX_LOCAL_VOCAB = 100_000


def _token_numbers(tokens: pa.Array, known: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of each known token of a batch's rows its row and its number in ``known``; every distinct token is looked up once."""
    n = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = tokens.flatten().dictionary_encode()
    number = pc.index_in(flat.dictionary.cast(known.type), value_set=known).take(flat.indices)
    at = pc.fill_null(number, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(n)), n)
    return row[at >= 0], at[at >= 0]


def _local_weights(weights: DataFrame, bound: int | None) -> tuple[pa.Array, list[tuple], np.ndarray, dict[tuple, int]] | None:
    """Tokens, (model, fold) pairs, their weights (a row per pair) and biases of a weight table that the tasks may have, else None."""
    if bound is None or bound > MAX_LOCAL_WEIGHTS:
        return None
    t = weights.select("model", "fold", "token", F.col("w").cast("bigint").alias("w")).filter("token IS NOT NULL").limit(MAX_LOCAL_WEIGHTS + 1).toArrow()
    if t.num_rows > MAX_LOCAL_WEIGHTS:
        return None
    models, folds, w = t["model"].to_pylist(), t["fold"].to_pylist(), pc.fill_null(t["w"], 0).to_numpy()
    pairs = sorted(set(zip(models, folds)))
    of = {p: i for i, p in enumerate(pairs)}
    pair = np.fromiter(map(of.__getitem__, zip(models, folds)), np.int64, len(models))
    tokens = t["token"].combine_chunks().dictionary_encode()
    known, at = tokens.dictionary, tokens.indices.to_numpy(zero_copy_only=False)
    table = np.zeros((len(pairs), len(known)), np.int64)
    np.add.at(table, (pair, at), w)
    bias = {}
    found = pc.index_in(pa.scalar(BIAS_TOKEN, known.type), value_set=known).as_py()
    if found is not None:
        bias = {pairs[i]: int(table[i, found]) for i in sorted(set(pair[at == found].tolist()))}
        table[:, found] = 0
    return known, pairs, table, bias


def _sums_in_place(rows: DataFrame, tokens_col: str, keep: Sequence[str], local, binary: Sequence[bool]) -> DataFrame:
    """``keep`` and ``w0, w1, ...``: each row's sum per pair, without bias; a ``binary`` pair counts a row's distinct tokens."""
    known, pairs, table, _ = local
    sent = rows.sparkSession.sparkContext.broadcast((known, table))
    names, flags = [f"w{i}" for i in range(len(pairs))], list(binary)

    def run(batches):
        known, table = sent.value
        for batch in batches:
            row, at = _token_numbers(batch[tokens_col], known)
            code, times = np.unique(row * len(known) + at, return_counts=True)
            row, at = code // max(1, len(known)), code % max(1, len(known))
            ends = np.searchsorted(row, np.arange(batch.num_rows + 1))
            out = []
            for w, once in zip(table, flags):
                total = np.concatenate(([0], np.cumsum(w[at] if once else w[at] * times)))[ends]
                out.append(pa.array(np.diff(total), pa.int64()))
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in keep], *out], [*keep, *names])

    kinds = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep]
    return text_batches(rows.select(*keep, tokens_col)).mapInArrow(run, ", ".join([*kinds, *(f"{n} bigint" for n in names)]))


def score_linear(rows: DataFrame, tokens_col: str, weights: DataFrame, key: str = "row_id",
                 binary: bool = False, weights_bound: int | None = None) -> DataFrame:
    """G1: ``logit = sum over the row's tokens of w / SCALE`` for every (model, fold) in
    ``weights(model, fold, token, w)``; ``binary`` counts each distinct token once.

    With a bound of at most ``MAX_LOCAL_WEIGHTS`` rows, and a bias for every (model, fold), a row's sums are made in place and one row of them
    is shuffled. Else each row's token array gets the bias pseudo-token appended, is exploded and
    joined with the weight table, and partial aggregation sums per ``(row, model, fold)`` before the shuffle.
    ``logit_milli`` keeps the exact integer.
    """
    local = _local_weights(weights, weights_bound)
    if local is not None and local[1] and len(local[3]) == len(local[1]):
        pairs, bias = local[1], local[3]
        s = _sums_in_place(rows, tokens_col, [key], local, [binary] * len(pairs))
        s = s.groupBy(key).agg(*[F.sum(F.col(f"w{i}") + bias[p]).alias(f"w{i}") for i, p in enumerate(pairs)])
        each = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(f).cast("int").alias("fold"), F.col(f"w{i}").alias("logit_milli"))
                         for i, (m, f) in enumerate(pairs)])
        return s.select(key, F.explode(each).alias("x")).select(key, "x.*").withColumn("logit", F.col("logit_milli") / F.lit(float(SCALE)))
    toks = F.concat(F.coalesce(F.col(tokens_col), F.array().cast("array<string>")), F.array(F.lit(BIAS_TOKEN)))
    if binary:
        toks = F.array_distinct(toks)
    w = weights.select("model", "fold", "token", "w")
    if weights_bound is not None and weights_bound <= 20_000_000:
        w = F.broadcast(w)
    e = rows.select(key, F.explode_outer(toks).alias("token"))  # outer: no inferred re-tokenising filter
    s = e.join(w, "token").groupBy(key, "model", "fold").agg(F.sum("w").alias("logit_milli"))
    return s.withColumn("logit", F.col("logit_milli") / F.lit(float(SCALE)))


def _one_row_per_token(weights: DataFrame) -> tuple[DataFrame, list[tuple], dict[tuple, int]]:
    """Weights with one column per (model, fold) and one row per token; the (model, fold) pairs; the bias of each.
    The pairs are few by construction (models x folds)."""
    bias = {(r["model"], r["fold"]): r["w"] for r in weights.filter(F.col("token") == BIAS_TOKEN).select("model", "fold", "w").collect()}
    pairs = sorted({(r["model"], r["fold"]) for r in weights.select("model", "fold").distinct().collect()})
    cols = [F.sum(F.when((F.col("model") == m) & (F.col("fold") == f), F.col("w"))).alias(f"w{i}") for i, (m, f) in enumerate(pairs)]
    wide = weights.filter(F.col("token") != BIAS_TOKEN).groupBy("token").agg(*cols)
    return wide, pairs, {p: int(bias.get(p, 0)) for p in pairs}


def _entries(rows: DataFrame, tokens_col: str, keep: Sequence[str], any_binary: bool) -> DataFrame:
    """One entry per token occurrence and, tagged ``binary``, one per distinct token. A row without tokens keeps one, empty."""
    toks = F.coalesce(F.col(tokens_col), F.array().cast("array<string>"))
    tagged = lambda a, flag: F.transform(a, lambda t: F.struct(t.alias("token"), F.lit(flag).alias("binary")))
    entries = F.concat(tagged(toks, False), tagged(F.array_distinct(toks), True)) if any_binary else tagged(toks, False)
    return rows.select(*keep, F.explode_outer(entries).alias("e")).select(*keep, "e.token", "e.binary")


def score_models(rows: DataFrame, tokens_col: str, weights: DataFrame, binary_models=(),
                 key: str = "row_id", weights_bound: int | None = None) -> DataFrame:
    """G1 for several models in one pass: count models see every occurrence, ``binary_models`` each distinct token once.

    A row's sums are one row of the shuffle, and ``(model, fold)`` become rows at the very end, where the bias is added. Weights of at most
    ``MAX_LOCAL_WEIGHTS`` rows are sent to the tasks; beyond, an occurrence meets one weight row with the weights of all models and folds.
    """
    binary = set(binary_models)
    local = _local_weights(weights, weights_bound)
    if local is not None:
        pairs, bias = local[1], {p: local[3].get(p, 0) for p in local[1]}
        e = _sums_in_place(rows, tokens_col, [key], local, [m in binary for m, _ in pairs])
        sums = [F.sum(f"w{i}").alias(f"w{i}") for i in range(len(pairs))]
    else:
        wide, pairs, bias = _one_row_per_token(weights)
        if weights_bound is not None and weights_bound <= 20_000_000:
            wide = F.broadcast(wide)
        e = _entries(rows, tokens_col, [key], bool(binary)).join(wide, "token", "left")
        sums = [F.sum(F.when(F.col("binary") == (m in binary), F.col(f"w{i}"))).alias(f"w{i}") for i, (m, _) in enumerate(pairs)]
    each = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(f).cast("int").alias("fold"),
                              (F.coalesce(F.col(f"w{i}"), F.lit(0)) + bias[m, f]).cast("bigint").alias("logit_milli"))
                     for i, (m, f) in enumerate(pairs)])
    s = e.groupBy(key).agg(*sums).select(key, F.explode(each).alias("x")).select(key, "x.*")
    return s.withColumn("logit", F.col("logit_milli") / F.lit(float(SCALE)))


def score_own_fold(rows: DataFrame, tokens_col: str, weights: DataFrame, binary_models=(), key: str = "row_id",
                   fold_col: str = "kfold", keep: Sequence[str] = (), weights_bound: int | None = None) -> DataFrame:
    """G1 for out-of-fold metrics: each row by every model, of its own fold (``fold_col``) only. Returns key, model, fold,
    ``keep`` and the logit."""
    binary = set(binary_models)
    local = _local_weights(weights, weights_bound)
    wide, pairs, bias = (None, local[1], local[3]) if local is not None else _one_row_per_token(weights)
    models, k = sorted({m for m, _ in pairs}), max(f for _, f in pairs) + 1
    number = {p: i for i, p in enumerate(pairs)}
    none = F.lit(None).cast("bigint")
    by_fold = [F.array(*[F.col(f"w{number[m, f]}") if (m, f) in number else none for f in range(k)]).alias(m) for m in models]
    if local is not None:
        e = _sums_in_place(rows, tokens_col, [key, fold_col, *keep], local, [m in binary for m, _ in pairs])
        e = e.select(key, fold_col, *keep, *by_fold)
        sums = [F.sum(F.get(F.col(m), F.col(fold_col))).alias(m) for m in models]
    else:
        arrays = wide.select("token", *by_fold)
        if weights_bound is not None and weights_bound <= 20_000_000:
            arrays = F.broadcast(arrays)
        e = _entries(rows, tokens_col, [key, fold_col, *keep], bool(binary)).join(arrays, "token", "left")
        sums = [F.sum(F.when(F.col("binary") == (m in binary), F.get(F.col(m), F.col(fold_col)))).alias(m) for m in models]
    own = F.array(*[F.struct(F.lit(m).alias("model"), (F.coalesce(F.col(m), F.lit(0)) + F.get(F.array(
        *[F.lit(bias.get((m, f), 0)) for f in range(k)]), F.col(fold_col))).cast("bigint").alias("logit_milli")) for m in models])
    s = e.groupBy(key, fold_col, *keep).agg(*sums).filter((F.col(fold_col) >= 0) & (F.col(fold_col) < k))
    s = s.select(key, F.col(fold_col).alias("fold"), *keep, F.explode(own).alias("x")).select(key, "x.model", "fold", *keep, "x.logit_milli")
    return s.withColumn("logit", F.col("logit_milli") / F.lit(float(SCALE)))


def drop_padding(pred: DataFrame, key: str = "row_id") -> DataFrame:
    """One prediction per (row, model, fold). A sampler's padding repeats a row with the same value; two different
    values for one key raise instead of one of them being lost."""
    two = F.min("logit") != F.max("logit")
    one = F.when(two, F.raise_error(F.lit("two different predictions for one row, model and fold")).cast("double"))
    return pred.groupBy(key, "model", "fold").agg(one.otherwise(F.min("logit")).alias("logit"))


def completeness(pred: DataFrame, rows: DataFrame, n_folds: int, key: str = "row_id") -> DataFrame:
    """One row per model with the predictions there are, those there should be (rows x folds), and how many
    (row, fold) are missing or repeated."""
    per = pred.groupBy("model", key, "fold").agg(F.count(F.lit(1)).alias("n"))
    expected = rows.agg(F.count(F.lit(1)).alias("n")).scalar() * n_folds
    return per.groupBy("model").agg(F.sum("n").alias("n_predictions"), F.count(F.lit(1)).alias("n_keys"),
                                    F.sum(F.when(F.col("n") > 1, 1).otherwise(0)).alias("n_repeated")).select(
        "model", "n_predictions", expected.cast("bigint").alias("n_expected"),
        (expected - F.col("n_keys")).cast("bigint").alias("n_missing"), F.col("n_repeated").cast("bigint").alias("n_repeated"))


def model_family(path: Column) -> Column:
    """Model family from a model path."""
    # The two family names recognised in model paths.
    return (F.when(F.instr(path, "deberta") > 0, F.lit("deberta"))
             .when(F.instr(path, "roberta") > 0, F.lit("roberta"))
             .otherwise(F.lit("other")))


def class_token_stats(train: DataFrame, tokens_col: str, label: str, vocab: DataFrame,
                      fold_col: str = "kfold") -> DataFrame:
    """Sufficient statistics for every fold at once, in one pass and one shuffle:
    ``(kfold, label, token, c, d)`` = token occurrences and documents containing it.

    A vocabulary of at most ``MAX_LOCAL_VOCAB`` tokens is sent to the tasks, which count a batch's rows at once and pass on one row per
    (kfold, label, token) of the batch; the document marker is ``(bias, 0, 1)``. With a larger one each row emits one tagged entry per
    occurrence ``(token, 1, 0)``, one per distinct token ``(token, 0, 1)`` and the marker, from a single explode.
    """
    tokens = vocab.select("token").limit(MAX_LOCAL_VOCAB + 1).toArrow()["token"].combine_chunks()
    if len(tokens) <= MAX_LOCAL_VOCAB:
        return _stats_in_place(train, tokens_col, label, tokens, fold_col).groupBy(fold_col, label, "token").agg(F.sum("c").alias("c"), F.sum("d").alias("d"))
    toks = F.coalesce(F.col(tokens_col), F.array().cast("array<string>"))
    entries = F.concat(
        F.transform(toks, lambda t: F.struct(t.alias("token"), F.lit(1).alias("c"), F.lit(0).alias("d"))),
        F.transform(F.array_distinct(toks), lambda t: F.struct(t.alias("token"), F.lit(0).alias("c"), F.lit(1).alias("d"))),
        F.array(F.struct(F.lit(BIAS_TOKEN).alias("token"), F.lit(0).alias("c"), F.lit(1).alias("d"))))
    e = train.select(fold_col, label, F.explode_outer(entries).alias("e")).select(fold_col, label, "e.*")
    known = vocab.select("token").unionByName(vocab.sparkSession.createDataFrame([(BIAS_TOKEN,)], "token string"))
    both = e.join(F.broadcast(known), "token")
    return both.groupBy(fold_col, label, "token").agg(F.sum("c").alias("c"), F.sum("d").alias("d"))


def _stats_in_place(train: DataFrame, tokens_col: str, label: str, tokens: pa.Array, fold_col: str) -> DataFrame:
    sent = train.sparkSession.sparkContext.broadcast(tokens)

    def run(batches):
        known = sent.value
        names, marker = pa.concat_arrays([known, pa.array([BIAS_TOKEN], known.type)]), len(known)
        for batch in batches:
            number: dict[tuple, int] = {}
            group = np.array([number.setdefault(p, len(number)) for p in zip(batch[fold_col].to_pylist(), batch[label].to_pylist())], np.int64)
            if not len(group):
                continue
            row, at = _token_numbers(batch[tokens_col], known)
            code, times = np.unique(row * (marker + 1) + at, return_counts=True)  # a row's distinct tokens
            all_rows = np.arange(batch.num_rows)
            row, at = np.concatenate((code // (marker + 1), all_rows)), np.concatenate((code % (marker + 1), np.full(batch.num_rows, marker)))
            times = np.concatenate((times, np.zeros(batch.num_rows, np.int64)))
            size = len(number) * (marker + 1)
            at = group[row] * (marker + 1) + at
            d, c = np.bincount(at, minlength=size), np.bincount(at, times, minlength=size).astype(np.int64)
            there = np.flatnonzero(d)
            first = pa.array(np.unique(group, return_index=True)[1][there // (marker + 1)])
            yield pa.RecordBatch.from_arrays([batch[fold_col].take(first), batch[label].take(first), names.take(pa.array(there % (marker + 1))),
                                              pa.array(c[there], pa.int64()), pa.array(d[there], pa.int64())], [fold_col, label, "token", "c", "d"])

    kinds = [f"`{c}` {train.schema[c].dataType.simpleString()}" for c in (fold_col, label)]
    return text_batches(train.select(fold_col, label, tokens_col)).mapInArrow(run, ", ".join([*kinds, "token string, c bigint, d bigint"]))


def fit_token_weights(train: DataFrame, tokens_col: str, label: str, vocab: DataFrame, k: int = 5,
                      models=("nb", "presence"), fold_col: str = "kfold") -> DataFrame:
    """I1 (re-aimed): per-fold log-ratio token weights for a 0/1 label, fitted on ``kfold <> f``; returns ``model, fold, token, w``.

    ``nb``: multinomial naive Bayes with add-one smoothing over the vocabulary,
    ``w = ln((c1+1)/(N1+V)) - ln((c0+1)/(N0+V))``. ``presence``: document frequencies,
    ``w = ln((d1+1)/(n1+2)) - ln((d0+1)/(n0+2))``. Bias ``ln(n1/n0)`` (training documents).
    Weights are rounded (half away from zero) to integer milli-units.

    One pass gathers the statistics, one row per token holds those of all folds' training rows, and the logarithms are taken there; only the
    totals (4 x k numbers) reach the driver. The token table is written to the shared folder, where its lineage ends.
    """
    unknown = [m for m in models if m not in ("nb", "presence")]
    if unknown:
        raise ValueError(f"unknown model {unknown[0]!r}")
    stats = class_token_stats(train, tokens_col, label, vocab, fold_col)
    # Rows outside folds 0..k-1 are never held out.
    sums = [F.coalesce(F.sum(F.when((F.col(label) == y) & ~F.col(fold_col).eqNullSafe(F.lit(f)), F.col(m))), F.lit(0)).alias(f"{m}{y}_{f}")
            for m in "cd" for y in (0, 1) for f in range(k)]
    return weights_of_sums(stats.groupBy("token").agg(*sums), vocab, k, models)


def weights_of_sums(sums: DataFrame, vocab: DataFrame, k: int, models: Sequence[str]) -> DataFrame:
    """The weights of ``fit_token_weights`` from ``token, c0_f, c1_f, d0_f, d1_f``: occurrences and documents by class of each fold's training rows."""
    spark = sums.sparkSession
    names = [f"{m}{y}_{f}" for m in "cd" for y in (0, 1) for f in range(k)]
    path = table_path(spark, f"token-stats-{uuid.uuid4().hex}")
    sums.write.parquet(path)
    per = spark.read.parquet(path)
    is_bias = F.col("token") == BIAS_TOKEN
    total = per.agg(*[F.sum(F.when(~is_bias, F.col(c))).alias(c) for c in names if c[0] == "c"],
                    *[F.sum(F.when(is_bias, F.col(c))).alias(c) for c in names if c[0] == "d"]).first()
    if any(not total[f"d{y}_{f}"] for y in (0, 1) for f in range(k)):
        raise ValueError("every fold's training rows must contain both classes (0 and 1)")
    n_vocab = vocab.count()
    n = {c: total[c] or 0 for c in names}

    def ratio(m: str, f: int, more: tuple[int, int]) -> Column:
        one, zero = (F.log((F.coalesce(F.col(f"{m}{y}_{f}"), F.lit(0)) + 1) / F.lit(n[f"{m}{y}_{f}"] + more[y])) for y in (1, 0))
        return F.round((one - zero) * SCALE).cast("bigint")

    each = [F.struct(F.lit(model).alias("model"), F.lit(f).alias("fold"),
                     (ratio("c", f, (n_vocab, n_vocab)) if model == "nb" else ratio("d", f, (2, 2))).alias("w")) for model in models for f in range(k)]
    weights = vocab.select("token").join(per.filter(~is_bias), "token", "left").select("token", F.explode(F.array(*each)).alias("x"))
    bias = [F.struct(F.lit(model).alias("model"), F.lit(f).alias("fold"),
                     F.round(F.log(F.lit(n[f"d1_{f}"]) / F.lit(n[f"d0_{f}"])) * SCALE).cast("bigint").alias("w")) for model in models for f in range(k)]
    one = spark.range(1).select(F.lit(BIAS_TOKEN).alias("token"), F.explode(F.array(*bias)).alias("x"))
    return weights.unionByName(one).select("x.model", "x.fold", "token", "x.w")
