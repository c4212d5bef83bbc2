"""Operators that replace a driver fit, a sort per epoch, a whole-row exchange, small files or a delete before a rename."""

import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from textfold.operators import distill, epochs, filters, ridge, user_model
from textfold.plans.steps import Steps
from textfold.sources import layout, once


# ---------------------------------------------------------------- I1

def test_ridge_equals_numpy_on_each_training_set(spark):
    rng = np.random.default_rng(0)
    x, y, fold = rng.integers(0, 50, (300, 6)), rng.integers(-1000, 1000, 300), rng.integers(0, 4, 300)
    df = spark.createDataFrame([(int(f), [float(v) for v in a], int(b)) for f, a, b in zip(fold, x, y)], "kfold int, x array<double>, y long")
    sums = [sorted(map(str, ridge.products(df.repartition(n), F.col("x"), F.col("y"), 6, 4).collect())) for n in (1, 7)]
    assert sums[0] == sums[1] and len(sums[0]) == 4 * 8  # exact, however the rows are split
    models = ridge.fit_ridge(df.repartition(7), F.col("x"), F.col("y"), 6, 4, penalty=2.0)
    got = {r["w_fold"]: r["w"] for r in models.collect()}
    z = np.column_stack((np.ones(300), x))
    for f in range(4):
        t = fold != f
        want = np.linalg.solve(z[t].T @ z[t] + 2.0 * np.diag([0] + [1] * 6), z[t].T @ y[t])
        assert np.allclose(got[f], want)
    p = ridge.predict_ridge(df, F.col("x"), models).select("kfold", "x", "prediction").collect()
    assert all(np.isclose(r["prediction"], np.dot([1.0, *r["x"]], got[r["kfold"]])) for r in p) and len(p) == 300
    with pytest.raises(Exception, match="every row needs"):
        ridge.fit_ridge(df, F.col("x"), F.col("y"), 5, 4).collect()


# ---------------------------------------------------------------- G1

def open_sums(content):
    offset = int(content)
    return lambda ids, lengths: np.stack([ids.sum(1) + offset, lengths, np.full(len(ids), ids.shape[0] * ids.shape[1])], 1)


def test_user_model_gets_bounded_batches_and_keeps_keys(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(f"r{i}", rng.integers(1, 9, int(rng.integers(0, 60))).tolist()) for i in range(500)] + [("none", None), ("long", [1] * 5000)]
    df = spark.createDataFrame(rows, "row_id string, input_ids array<int>").repartition(3)
    user_model.write_file(spark, str(tmp_path / "m" / "model.bin"), b"100")
    model = user_model.Shipped(spark, str(tmp_path / "m" / "model.bin"))
    out = user_model.score_with(df, model, open_sums, [("sum", 0), ("length", 0), ("cells", 1)], budget=600).collect()
    got = {(r["row_id"], r["model"], r["fold"]): r["logit"] for r in out}
    assert len(got) == len(out) == 3 * len(rows)
    for key, ids in rows:
        assert got[key, "sum", 0] == sum(ids or []) + 100 and got[key, "length", 0] == len(ids or [])
        assert got[key, "cells", 1] <= 600 or key == "long"
    order = [r["row_id"] for r in user_model.score_with(df.coalesce(1), model, open_sums, [("a", 0), ("b", 0), ("c", 0)]).collect()][::3]
    assert order == [r["row_id"] for r in df.coalesce(1).collect()]  # the input's order
    with pytest.raises(Exception, match="scores for"):
        user_model.score_with(df, model, open_sums, [("a", 0)]).collect()
    with pytest.raises(Exception):
        user_model.Shipped(spark, str(tmp_path / "nothing"))


def test_budget_batches():
    lengths = np.array([5, 0, 3, 100, 3, 7])
    batches = user_model.budget_batches(lengths, 12)
    assert sorted(np.concatenate(batches).tolist()) == list(range(6))
    assert all(len(b) == 1 or len(b) * lengths[b].max() <= 12 for b in batches)
    assert user_model.budget_batches(np.zeros(0, int), 5) == []


# ---------------------------------------------------------------- E7

@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 97, 1000, 1023])
def test_epochs_are_permutations(spark, n):
    ranked = spark.range(n).select(F.col("id").alias("position"))
    e = epochs.epoch_positions(ranked, 7, [0, 1, 2, 3])
    orders = {}
    for r in e.collect():
        orders.setdefault(r["epoch"], {})[r["position"]] = r["epoch_position"]
    assert all(sorted(o.values()) == list(range(n)) for o in orders.values())
    if n > 90:
        assert len({tuple(o[i] for i in range(n)) for o in orders.values()}) == 4
        moved = np.array([orders[0][i] for i in range(n)])
        assert abs(np.corrcoef(moved, np.arange(n))[0, 1]) < 0.25
        assert (np.abs(np.diff(moved)) == 1).mean() < 0.05  # neighbours don't stay neighbours


def test_epochs_need_no_exchange(spark):
    ranked = spark.range(100).select(F.col("id").alias("position"))
    plan = epochs.epoch_positions(ranked, 7, [0, 1])._jdf.queryExecution().executedPlan().toString()
    main = plan.split("Subquery")[0]
    assert "hashpartitioning" not in main and "rangepartitioning" not in main


# ---------------------------------------------------------------- D3

ROWS = [(1, "x", "y"), (2, "x", "y"), (3, "x", None), (4, "x", None), (5, "", "xy"), (6, "xy", ""), (7, None, "xy"), (8, "x:y", "n"), (9, "x", "y"), (10, "1:x", "")]


@pytest.mark.parametrize("clash", [False, True])
def test_dedup_by_digest(spark, clash):
    df = spark.createDataFrame([(*r, f"more {r[0]}") for r in ROWS], "id long, a string, b string, more string").repartition(3)
    digest = F.lit(b"same") if clash else None  # all digests equal: the values alone decide
    got = filters.dedup_by_digest(df, "id", ["a", "b"], digest)
    assert sorted(r["id"] for r in got.collect()) == [1, 3, 5, 6, 7, 8, 10] and got.columns == df.columns
    assert filters.dedup_by_digest(df.limit(0), "id", ["a", "b"]).count() == 0


# ---------------------------------------------------------------- A9, A10, A11

def test_files_are_bounded(spark, tmp_path):
    df = spark.range(5000).select(F.col("id").alias("row_id"), F.when(F.col("id") % 10 < 7, 0).when(F.col("id") % 10 < 9, 1).alias("fold"),
                                  F.lit("m").alias("model")).repartition(16)
    layout.write_sized(df, str(tmp_path / "t"), ["model", "fold"], rows_per_file=500)
    back = spark.read.parquet(str(tmp_path / "t")).groupBy("fold", F.input_file_name().alias("f")).count().collect()
    assert sum(r["count"] for r in back) == 5000 and max(r["count"] for r in back) <= 600
    assert sorted(sum(r["fold"] == f for r in back) for f in (0, 1, None)) == [2, 3, 8]
    layout.write_sized(df.limit(0), str(tmp_path / "empty"), ["model", "fold"])


def test_one_of_several_builders_commits(spark, tmp_path):
    path, gate, built = str(tmp_path / "t"), threading.Barrier(3), []

    def builder(i):
        def build():
            built.append(i)
            gate.wait(60)  # all of them have found no table
            return spark.range(10 + i)
        results.append(once.build_once(spark, build, path).count())
    results = []
    threads = [threading.Thread(target=builder, args=(i,)) for i in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(built) == [0, 1, 2] and len(set(results)) == 1 and results[0] in (10, 11, 12)
    assert once.build_once(spark, lambda: 1 / 0, path).count() == results[0]
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("table-")]) == 1
    assert not [p for p in (tmp_path / "t").iterdir() if p.name.startswith("_CURRENT.")]


def test_a_build_that_fails_leaves_no_table(spark, tmp_path):
    path = str(tmp_path / "t")
    bad = spark.range(5).select(F.raise_error(F.lit("stop")).cast("int").alias("x"))
    with pytest.raises(Exception, match="stop"):
        once.build_once(spark, lambda: bad, path)
    assert once.committed(spark, path) is None
    assert once.build_once(spark, lambda: spark.range(4), path).count() == 4 and once.committed(spark, path).count() == 4


# ---------------------------------------------------------------- I2 to I4

def cycle_tables(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(40)]
    toks = lambda: sorted(set(rng.choice(words, rng.integers(0, 12)).tolist()))
    train = [(f"t{i}", toks(), i % 3, int(rng.integers(0, 9000))) for i in range(60)]
    extra = [(f"x{i}", toks()) for i in range(80)]
    return (spark.createDataFrame(train, "row_id string, toks array<string>, kfold int, target long"),
            spark.createDataFrame(extra, "row_id string, toks array<string>"))


def test_cycles_go_on_where_they_ended(spark, tmp_path, monkeypatch):
    train, extra = cycle_tables(spark)
    want = sorted(map(tuple, distill.run_cycles(train, extra, 3, 2, str(tmp_path / "whole")).collect()))
    built, real = [], Steps.table

    def table(self, step, build):
        def counted():
            if len(built) >= limit:
                raise RuntimeError("killed")
            built.append(step)
            return build()
        return real(self, step, counted)
    monkeypatch.setattr(Steps, "table", table)
    limit = 4
    with pytest.raises(RuntimeError, match="killed"):
        distill.run_cycles(train, extra, 3, 2, str(tmp_path / "again"))
    first, limit = list(built), 99
    got = sorted(map(tuple, distill.run_cycles(train, extra, 3, 2, str(tmp_path / "again")).collect()))
    assert got == want and built[:4] == first and len(set(built)) == len(built) == 15
    n = len(built)
    distill.run_cycles(train.repartition(5), extra, 3, 2, str(tmp_path / "again")).collect()
    assert len(built) == n  # the same rows, split otherwise: nothing is made again
    distill.run_cycles(train, extra.filter("row_id <> 'x1'"), 3, 2, str(tmp_path / "again")).collect()
    assert len(built) == 2 * n  # other rows: another job


def test_predictions_in_place_equal_the_join(spark):
    train, extra = cycle_tables(spark)
    model = distill.fit(distill._train_adds(train, 3, 1), 3)
    pairs = [sorted(map(str, distill.predict(extra, model, m).collect())) for m in (distill.MAX_LOCAL_TOKENS, 3)]
    assert pairs[0] == pairs[1]


def test_warm_start_steps(spark, tmp_path):
    train, extra = cycle_tables(spark)
    teacher = distill.fit(distill._train_adds(train, 3, 1), 3)
    single = distill.single_student(extra, distill.teach(extra, [teacher]), 3)
    models = distill.warm_start(train, single, 3, 2, str(tmp_path / "w"))
    rows = train.collect()
    base = [single.base.first()["v"][0]] * 3
    known = {r["token"]: r["v"][0] for r in single.tokens.collect()}
    values = [{t: known.get(t, base[0]) for r in rows for t in r["toks"]} | known for _ in range(3)]
    trunc = lambda a, b: abs(a) // b * (1 if a >= 0 else -1)
    for epoch, m in enumerate(models):
        assert m.base.first()["v"] == base
        assert {r["token"]: tuple(r["v"]) for r in m.tokens.collect()} == {t: tuple(v[t] for v in values) for t in values[0]}
        for f in range(3):
            mine = [r for r in rows if r["kfold"] != f]
            error = {r["row_id"]: r["target"] - trunc(sum(values[f][t] for t in r["toks"]) + base[f], len(r["toks"]) + 1) for r in mine}
            for t in list(values[f]):
                there = [error[r["row_id"]] for r in mine if t in r["toks"]]
                if there:
                    values[f][t] += trunc(sum(there), 2 * len(there))
            base[f] += trunc(sum(error.values()), 2 * len(error))
