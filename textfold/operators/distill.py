"""Pseudo-label cycles with continuous targets (I1-I4 on the regression line), in closed form.

The re-aimed regressor of a fold is a table of token values: the mean target, in thousandths and rounded down, of
the training rows that hold the token, copies counted. A row is predicted by the mean value of its known tokens and of
one value for all rows. A model is ``tokens(token, v array)`` with one array entry per fold and ``base``, the array of
the values for all rows. All targets are whole thousandths, so sums are exact in any order.

Statistics of all folds come from one pass: a row carries, per fold, what it adds to the sums (its target times its
copies) and counts; a training row adds nothing to its own fold. The value for all rows joins after the aggregate, so
no join key is in every row; token keys are left to the runtime's skew handling, and aggregates combine map-side.

Token occurrences are what is large. The training rows are summed once, by the teacher's fit, and the single student's sums are
carried on by its fold students. A model's most frequent tokens are looked up where a row's tokens are; only occurrences of
the others are joined. Extra rows bucketed by ``row_id`` (``partitioning.bucketed``) meet their labels without being shuffled.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..plans.partitioning import text_batches
from ..plans.steps import Steps
from ..session import table_path


@dataclass
class TokenMeans:
    """A regressor per fold: token values and the values for all rows."""

    tokens: DataFrame  # token, v array<bigint>; n, how often it was counted, if known
    base: DataFrame  # one row: v array<bigint>
    folds: int
    sums: DataFrame | None = None  # token (null: all rows), x0, x1, ...: the sums and then the counts of each fold


def _train_adds(train: DataFrame, k: int, times: int) -> DataFrame:
    """D4 without making rows: ``times`` copies of each training row outside fold f, as sums and counts per fold."""
    out = [F.when(F.col("kfold") != f, F.lit(times)).otherwise(F.lit(0)).cast("bigint") for f in range(k)]
    return train.select("row_id", "toks", F.array(*[o * F.col("target") for o in out]).alias("s"), F.array(*out).alias("c"))


def _pseudo_adds(extra: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """Pseudo-labelled rows ``labels(row_id, t array)``, once in every fold; a null label adds nothing."""
    t = [F.col("t")[f] for f in range(k)]
    return extra.join(labels.hint("shuffle_hash"), "row_id").select(
        "row_id", "toks", F.array(*[F.coalesce(x, F.lit(0)).cast("bigint") for x in t]).alias("s"),
        F.array(*[x.isNotNull().cast("bigint") for x in t]).alias("c"))


def _means(k: int) -> list[Column]:
    s = [F.sum(F.col("s")[f]) for f in range(k)] + [F.sum(F.col("c")[f]) for f in range(k)]
    return [x.alias(f"x{i}") for i, x in enumerate(s)]


def _values(k: int) -> Column:
    one = [F.when(F.col(f"x{k + f}") > 0, F.floor(F.expr(f"x{f} div x{k + f}"))).cast("bigint") for f in range(k)]
    return F.array(*one).alias("v")


def _sums(adds: DataFrame, k: int, before: DataFrame | None = None) -> DataFrame:
    """``token, x0, x1, ...`` of ``adds(row_id, toks, s, c)``, with those of ``before`` added; the row without token is of all rows."""
    xs = [F.col("s")[f] for f in range(k)] + [F.col("c")[f] for f in range(k)]
    each = adds.select(F.explode("toks").alias("token"), *[x.alias(f"x{i}") for i, x in enumerate(xs)]).filter("token IS NOT NULL")
    whole = adds.agg(*_means(k)).select(F.lit(None).cast("string").alias("token"), *[f"x{i}" for i in range(2 * k)])
    if before is None:
        return _added(each, k).unionByName(whole)
    return _added(each.unionByName(whole).unionByName(before), k)


def _added(sums: DataFrame, k: int) -> DataFrame:
    return sums.groupBy("token").agg(*[F.sum(f"x{i}").alias(f"x{i}") for i in range(2 * k)])


def _copied(sums: DataFrame, times: int, k: int) -> DataFrame:
    """The sums of ``times`` copies of the rows."""
    return sums.select("token", *[(F.col(f"x{i}") * times).alias(f"x{i}") for i in range(2 * k)])


def _as_folds(sums: DataFrame, k: int) -> DataFrame:
    """A single model's sums in every fold."""
    return sums.select("token", *[F.col("x0").alias(f"x{f}") for f in range(k)], *[F.col("x1").alias(f"x{k + f}") for f in range(k)])


def of_sums(sums: DataFrame, k: int) -> TokenMeans:
    many = sum((F.coalesce(F.col(f"x{k + f}"), F.lit(0)) for f in range(k)), F.lit(0)).cast("bigint")
    return TokenMeans(sums.filter("token IS NOT NULL").select("token", _values(k), many.alias("n")),
                      sums.filter("token IS NULL").select(_values(k)), k, sums)


def fit(adds: DataFrame, k: int, path: str | None = None) -> TokenMeans:
    """The regressor of ``adds(row_id, toks, s, c)``; with ``path`` its sums are written there, which ends its lineage."""
    return _fitted(_sums(adds, k), k, path)


def _fitted(sums: DataFrame, k: int, path: str | None) -> TokenMeans:
    if path:
        sums.write.mode("overwrite").parquet(f"{path}/sums")
        sums = sums.sparkSession.read.parquet(f"{path}/sums")
    return of_sums(sums, k)


# Most tokens of a model that are sent to the tasks, the most frequent ones; occurrences of the others are joined.
MAX_LOCAL_TOKENS = 1_000_000


def _split(tokens: DataFrame, most: int) -> tuple[pa.Table, DataFrame | None]:
    """A model's tokens for the tasks, at most ``most``: all, or those from a frequency on; and the others."""
    tokens = tokens.withColumn("n", F.col("n") if "n" in tokens.columns else F.lit(1))
    if tokens.count() <= most:
        return tokens.select("token", "v").toArrow(), None
    level = F.floor(F.log2(F.greatest(F.col("n"), F.lit(1))) * 8)
    least, room = None, most
    for at, many in sorted(((r["level"], r["count"]) for r in tokens.groupBy(level.alias("level")).count().collect()), reverse=True):
        if many > room:
            break
        least, room = at, room - many
    often = F.lit(False) if least is None else level >= least
    return tokens.filter(often).select("token", "v").toArrow(), tokens.filter(~often).select("token", "v")


def _look_up(rows: DataFrame, local: pa.Table, k: int, finish, kinds: str) -> DataFrame:
    """Each row's tokens looked up where they are: no shuffle, and no key that is in every row. ``finish`` makes a batch of the row ids, each
    fold's sums and counts, and the tokens that ``local`` lacks."""
    column = lambda c: pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type)
    flat = column(local["v"]).flatten()
    sent = rows.sparkSession.sparkContext.broadcast((column(local["token"]), [flat.take(pa.array(np.arange(f, k * local.num_rows, k))) for f in range(k)]))

    def run(batches):
        known, values = sent.value
        for batch in batches:
            toks = batch["toks"]
            n = toks.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.concatenate(([0], np.cumsum(n)))
            words = toks.flatten().dictionary_encode()
            at = pc.index_in(words.dictionary.cast(known.type), value_set=known).take(words.indices)
            out = []
            for f in range(k):
                v = values[f].take(at)
                there = v.is_valid().to_numpy(zero_copy_only=False)
                v = v.fill_null(0).to_numpy(zero_copy_only=False)
                out.append([np.diff(np.concatenate(([0], np.cumsum(x, dtype=np.int64)))[ends]) for x in (v, there)])

            def lacking():
                there = at.is_valid().to_numpy(zero_copy_only=False)
                left = np.concatenate(([0], np.cumsum(~there)))[ends]
                return pa.ListArray.from_arrays(pa.array(left, pa.int32()), words.take(pa.array(np.flatnonzero(~there))).dictionary_decode().cast(pa.string()))
            yield finish(batch["row_id"], out, lacking)

    return text_batches(rows.select("row_id", "toks")).mapInArrow(run, f"row_id {rows.schema['row_id'].dataType.simpleString()}, {kinds}")


def _lists(columns: list[np.ndarray], k: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, k * len(columns[0]) + 1, k), pa.int32()), pa.array(np.stack(columns, 1).reshape(-1)))


def _predict_in_place(rows: DataFrame, local: pa.Table, base: list[int], k: int) -> DataFrame:
    def finish(row_id, out, _):
        totals = [total + base[f] for f, (total, _) in enumerate(out)]
        p = [np.sign(t) * (np.abs(t) // (many + 1)) for t, (_, many) in zip(totals, out)]  # towards zero, like div
        return pa.RecordBatch.from_arrays([row_id, _lists(p, k)], ["row_id", "p"])

    return _look_up(rows, local, k, finish, "p array<bigint>")


def _predict_with_join(rows: DataFrame, local: pa.Table, others: DataFrame | None, base: list[int | None], k: int) -> DataFrame:
    """Sums over ``local`` in place; the tokens left, with their row's number, meet ``others`` in one join for all folds."""
    def finish(row_id, out, lacking):
        return pa.RecordBatch.from_arrays([row_id, _lists([a for a, _ in out], k), _lists([b for _, b in out], k), lacking()], ["row_id", "s", "n", "rest"])

    spark = rows.sparkSession
    path = table_path(spark, f"row-sums-{uuid.uuid4().hex}")
    _look_up(rows, local, k, finish, "s array<bigint>, n array<bigint>, rest array<string>").withColumn("no", F.monotonically_increasing_id()).write.parquet(path)
    d = spark.read.parquet(path)
    known = [(F.col("s")[f], F.col("n")[f]) for f in range(k)]
    if others is not None:
        found = d.select("no", F.explode("rest").alias("token")).join(others, "token").groupBy("no").agg(
            *[F.sum(F.col("v")[f]).alias(f"s{f}") for f in range(k)], *[F.count(F.col("v")[f]).alias(f"n{f}") for f in range(k)])
        d = d.select("row_id", "s", "n", "no").join(found, "no", "left")
        known = [(s + F.coalesce(F.col(f"s{f}"), F.lit(0)), n + F.coalesce(F.col(f"n{f}"), F.lit(0))) for f, (s, n) in enumerate(known)]
    d = d.select("row_id", *[(s + F.lit(base[f]).cast("bigint")).alias(f"s{f}") for f, (s, _) in enumerate(known)], *[(n + 1).alias(f"n{f}") for f, (_, n) in enumerate(known)])
    return d.select("row_id", F.array(*[F.expr(f"s{f} div n{f}") for f in range(k)]).alias("p"))


def predict(rows: DataFrame, model: TokenMeans, max_local: int = MAX_LOCAL_TOKENS) -> DataFrame:
    """``(row_id, p array)``: each row's prediction in every fold. At most ``max_local`` tokens of the model are sent to the tasks; with more, the
    occurrences of the less frequent ones meet them in one join for all folds, with the same result."""
    k = model.folds
    local, others = _split(model.tokens, max_local)
    base = model.base.select("v").first()["v"]
    if others is None and all(x is not None for x in base):
        return _predict_in_place(rows, local, base, k)
    return _predict_with_join(rows, local, others, base, k)


def blend(predictions: DataFrame, n: int, k: int, weights: Sequence[float] | None = None) -> DataFrame:
    """``(row_id, t array)``, per fold the mean of the first ``n`` teachers' predictions ``p0, p1, ...``, or their weighted sum, rounded down."""
    if weights is None:
        t = [F.expr(f"({' + '.join(f'p{i}[{f}]' for i in range(n))}) div {n}") for f in range(k)]
    else:
        t = [F.floor(sum((F.lit(w) * F.col(f"p{i}")[f] for i, w in enumerate(weights)), F.lit(0.0))) for f in range(k)]
    return predictions.select("row_id", F.array(*[x.cast("bigint") for x in t]).alias("t"))


def teach(extra: DataFrame, teachers: Sequence[TokenMeans], weights: Sequence[float] | None = None) -> DataFrame:
    """The labels that the teachers give together."""
    d = None
    for i, m in enumerate(teachers):
        p = predict(extra, m).withColumnRenamed("p", f"p{i}")
        d = p if d is None else d.join(p, "row_id")
    return blend(d, len(teachers), teachers[0].folds, weights)


def average(labels: DataFrame, k: int) -> DataFrame:
    """The folds' mean label, rounded down, as the label of one student; null if a fold has none."""
    return labels.select("row_id", F.array(F.expr(f"({' + '.join(f't[{f}]' for f in range(k))}) div {k}")).alias("t"))


def fold_wise_student(train_sums, extra, labels, k: int, times: int = 3, path: str | None = None) -> TokenMeans:
    """Student f learns fold f's pseudo labels and ``times`` copies of the training rows outside fold f (``train_sums``: their sums, the teacher's)."""
    return _fitted(_sums(_pseudo_adds(extra, labels, k), k, _copied(train_sums, times, k)), k, path)


def single_student(extra, labels, k: int, path: str | None = None) -> TokenMeans:
    """I3, first stage: one student of the folds' average label."""
    return fit(_pseudo_adds(extra, average(labels, k), 1), 1, path)


def continued(train_sums, single: TokenMeans, k: int, times: int = 3, path: str | None = None) -> TokenMeans:
    """I3, second stage: the single student's statistics, carried on in every fold with ``times`` copies of its training rows."""
    return _fitted(_added(_as_folds(single.sums, k).unionByName(_copied(train_sums, times, k)), k), k, path)


def validate(train: DataFrame, model: TokenMeans, own_fold: bool) -> DataFrame:
    """H1 in whole target units: ``(fold, n_rows, rmse)`` of each row in its own fold's model, or (fold -1) of all rows
    in a single model."""
    e = train.join(predict(train, model), "row_id")
    p = F.element_at("p", F.col("kfold") + 1) if own_fold else F.col("p")[0]
    err = F.pow((F.col("target") - p) / 1000.0, 2)
    fold = F.col("kfold") if own_fold else F.lit(-1)
    return e.groupBy(fold.alias("fold")).agg(F.count(F.lit(1)).alias("n_rows"), F.sqrt(F.avg(err)).alias("rmse"))


# The weights of the first and the second teacher in the second cycle.
TWO_TEACHERS = (0.33, 0.67)


def run_cycles(train: DataFrame, extra: DataFrame, k: int = 5, times: int = 3, name: str = "cycles") -> DataFrame:
    """I4: the three cycles with growing teachers. ``train`` has row_id, toks (distinct), kfold and target, ``extra`` row_id and
    toks. Returns ``(cycle, stage, fold, n_rows, rmse)``.

    Cycle 0 fits the first teacher on the training rows. Cycle 1: its fold labels teach fold-wise students. Cycle 2: both
    teachers, weighted, teach one student of the average label, validated on all training rows; fold students carry it on. Cycle 3: the same
    with the mean of three teachers.

    Every model and every teacher's predictions are steps, written once below the shared folder under ``name``: a run that
    ended early, called again with the same rows and parameters, reads the finished steps and makes the others.
    """
    steps = Steps(train.sparkSession, table_path(train.sparkSession, name), {"k": k, "times": times, "two_teachers": TWO_TEACHERS},
                  {"train": train, "extra": extra})

    def model(step: str, make, folds: int = k, carried: bool = False) -> TokenMeans:
        """The step's model; one table, in which the entry for all rows has no token. It has the sums if another model carries them on, else the values."""
        def table() -> DataFrame:
            m = make()
            return m.sums if carried else m.tokens.unionByName(m.base, allowMissingColumns=True)
        both = steps.table(step, table)
        return of_sums(both, folds) if carried else TokenMeans(both.filter("token IS NOT NULL"), both.filter("token IS NULL").select("v"), folds)

    def predicted(i: int, teacher: TokenMeans, before: DataFrame | None) -> DataFrame:
        """Predictions p0 to pi of the extra rows, the i-th teacher's beside the stored ones of the earlier teachers."""
        def table() -> DataFrame:
            p = predict(extra, teacher).withColumnRenamed("p", f"p{i}")
            return p if before is None else before.join(p, "row_id")
        return steps.table(f"predictions-{i}", table)

    def score(cycle: int, stage: str, m: TokenMeans) -> DataFrame:
        done = steps.table(f"score-{cycle}-{stage}", lambda: validate(train, m, stage == "folds"))
        return done.select(F.lit(cycle).alias("cycle"), F.lit(stage).alias("stage"), "fold", "n_rows", "rmse")

    teacher = model("teacher", lambda: fit(_train_adds(train, k, 1), k), carried=True)
    known = predicted(0, teacher, None)
    out = score(0, "folds", teacher)
    for cycle, weights in ((1, None), (2, TWO_TEACHERS), (3, None)):
        labels = blend(known, cycle, k, weights)
        if cycle == 1:
            student = model("student-1", lambda: fold_wise_student(teacher.sums, extra, labels, k, times))
        else:
            single = model(f"single-{cycle}", lambda: single_student(extra, labels, k), 1, True)
            out = out.unionByName(score(cycle, "single", single))
            student = model(f"student-{cycle}", lambda: continued(teacher.sums, single, k, times))
        out = out.unionByName(score(cycle, "folds", student))
        if cycle < 3:
            known = predicted(cycle, student, known)
    return out


# ---------------------------------------------------------------- I3, second stage, by steps from the single student's values

def _own_values(train: DataFrame, start: TokenMeans, k: int) -> TokenMeans:
    """The single student's values for every fold; a training token it doesn't know begins with its value for all rows."""
    base = start.base.select(F.array_repeat(F.col("v")[0], k).alias("v"))
    own = train.select(F.explode("toks").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    new = own.join(start.tokens.select("token"), "token", "left_anti").select("token", base.scalar().alias("v"), "n")
    return TokenMeans(start.tokens.select("token", F.array_repeat(F.col("v")[0], k).alias("v"), "n").unionByName(new), base, k)


def _gradients(train: DataFrame, model: TokenMeans) -> tuple[DataFrame, DataFrame]:
    """Sums of the errors, and how many rows, per token and over all rows, of each fold's training rows: summed in the tasks before the shuffle."""
    k = model.folds
    e = train.join(predict(train, model).hint("shuffle_hash"), "row_id")
    out = [F.col("kfold") != f for f in range(k)]
    e = e.select("toks", F.array(*[F.when(o, F.col("target") - F.col("p")[f]).otherwise(F.lit(0)) for f, o in enumerate(out)]).alias("s"),
                 F.array(*[o.cast("bigint") for o in out]).alias("c"))
    per = e.select(F.explode("toks").alias("token"), "s", "c").groupBy("token").agg(*_means(k))
    return per, e.agg(*_means(k))


def warm_start(train: DataFrame, start: TokenMeans, k: int, epochs: int, path: str) -> list[TokenMeans]:
    """Every fold's model goes on from the single student ``start`` on its own training rows; the models before and after each epoch.

    An epoch moves a token's value by half the mean error (towards zero) of the fold's training rows that hold it, and the value for all rows by half the
    mean error of all; one pass over the training rows serves all folds. The models are written below ``path``, epoch by epoch.
    """
    def written(m: TokenMeans, epoch: int) -> TokenMeans:
        m.tokens.write.parquet(f"{path}/epoch-{epoch}/tokens")
        m.base.write.parquet(f"{path}/epoch-{epoch}/base")
        read = train.sparkSession.read
        return TokenMeans(read.parquet(f"{path}/epoch-{epoch}/tokens"), read.parquet(f"{path}/epoch-{epoch}/base"), k)

    def moved(v: str, f: int) -> Column:
        return F.expr(f"{v}[{f}] + CASE WHEN coalesce(x{k + f}, 0) > 0 THEN x{f} div (2 * x{k + f}) ELSE 0 END")

    models = [written(_own_values(train, start, k), 0)]
    for epoch in range(1, epochs + 1):
        per, whole = _gradients(train, models[-1])
        tokens = models[-1].tokens.join(per, "token", "left").select("token", F.array(*[moved("v", f) for f in range(k)]).alias("v"), "n")
        base = whole.withColumn("v", models[-1].base.select("v").scalar()).select(F.array(*[moved("v", f) for f in range(k)]).alias("v"))
        models.append(written(TokenMeans(tokens, base, k), epoch))
    return models
