"""Scores and statistics made where a row's tokens are, students of all folds from one pass, bounded batches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textfold.operators import cycles, distill, scoring, subword, tokens, user_model
from textfold.plans.partitioning import bucketed

B = scoring.BIAS_TOKEN
ROWS = [("a", ["x", "y", "x"], 1, 0), ("b", ["z", None, "?"], 0, 1), ("c", [], 1, 2), ("d", None, 0, None), ("a", ["y"], 1, 0), (None, ["x"], 0, 1)]


def _rows(spark):
    return spark.createDataFrame(ROWS, "row_id string, toks array<string>, label int, kfold int").repartition(3)


def _weights(spark, bias=True):
    w = [(m, f, t, v * (f + 1)) for m in ("m", "n") for f in (0, 1, 2) for t, v in (("x", 3), ("y", -2), ("z", 7), *([(B, 10)] if bias else []))]
    return spark.createDataFrame(w, "model string, fold int, token string, w bigint")


def _same(a, b):
    assert a.columns == b.columns and [t for _, t in a.dtypes] == [t for _, t in b.dtypes]
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


@pytest.mark.parametrize("bias", [True, False])
def test_sums_in_place_equal_the_join(spark, bias):
    rows, w = _rows(spark), _weights(spark, bias)
    for binary in ((), ("n",)):
        _same(scoring.score_models(rows, "toks", w, binary, weights_bound=100), scoring.score_models(rows, "toks", w, binary))
        _same(scoring.score_own_fold(rows, "toks", w, binary, keep=["label"], weights_bound=100), scoring.score_own_fold(rows, "toks", w, binary, keep=["label"]))
    for binary in (True, False):
        _same(scoring.score_linear(rows, "toks", w, binary=binary, weights_bound=100), scoring.score_linear(rows, "toks", w, binary=binary))
    assert scoring.score_models(rows.limit(0), "toks", w, weights_bound=100).count() == 0
    for s in (scoring.score_models(rows, "toks", _weights(spark), weights_bound=100), scoring.score_linear(rows, "toks", _weights(spark), weights_bound=100)):
        plan = s._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "MapInArrow" in plan  # no occurrence is joined or shuffled


def test_statistics_in_place_equal_the_join(spark, monkeypatch):
    vocab = spark.createDataFrame([("x",), ("y",), ("z",)], "token string")
    inplace = scoring.class_token_stats(_rows(spark), "toks", "label", vocab)
    assert "MapInArrow" in inplace._jdf.queryExecution().optimizedPlan().toString()
    got = sorted(map(str, inplace.collect()))
    monkeypatch.setattr(scoring, "MAX_LOCAL_VOCAB", 1)
    assert got == sorted(map(str, scoring.class_token_stats(_rows(spark), "toks", "label", vocab).collect()))


def test_students_of_all_folds_from_one_pass(spark, monkeypatch):
    rng = np.random.default_rng(3)
    word = lambda: [str(t) for t in rng.choice(list("xyzu"), int(rng.integers(1, 6)))]
    train = [(f"t{i}", word(), i % 2, i % 3) for i in range(30)]
    extra = [(f"e{i}", word()) for i in range(20)]
    vocab = spark.createDataFrame([("x", 0), ("y", 1), ("z", 2)], "token string, id int")
    teacher = {(f, t): int(rng.integers(-50, 50)) for f in range(3) for t in ("x", "y", "z", B)}
    w = spark.createDataFrame([("nb", f, t, v) for (f, t), v in teacher.items()], "model string, fold int, token string, w bigint")
    calls = []
    stats = scoring.class_token_stats
    monkeypatch.setattr(scoring, "class_token_stats", lambda *a, **b: calls.append(1) or stats(*a, **b))
    got = {(r["fold"], r["token"]): r["w"] for r in cycles.pseudo_cycle(
        spark.createDataFrame(train, "row_id string, toks array<string>, label int, kfold int"),
        spark.createDataFrame(extra, "row_id string, toks array<string>"), w, vocab, k=3, times=3).collect()}
    assert len(calls) == 2  # the extra rows and the training rows, whatever the number of folds
    want = {}
    for f in range(3):
        mix = [(t, int(teacher[f, B] + sum(teacher.get((f, x), 0) for x in t) > 0), 1) for _, t in extra] + [(t, y, 3) for _, t, y, g in train if g != f]
        c = {(y, x): sum(n * t.count(x) for t, z, n in mix if z == y) for y in (0, 1) for x in "xyz"}
        n = [sum(c[y, x] for x in "xyz") for y in (0, 1)]
        for x in "xyz":
            want[f, x] = round(1000 * (np.log((c[1, x] + 1) / (n[1] + 3)) - np.log((c[0, x] + 1) / (n[0] + 3))))
        want[f, B] = round(1000 * np.log(sum(n for _, y, n in mix if y) / sum(n for _, y, n in mix if not y)))
    assert got == want


def test_batches_of_texts_are_bounded(spark):
    keys = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"]
    before = [spark.conf.get(k) for k in keys]
    df = spark.range(3000).select(F.col("id").cast("string").alias("row_id"), F.array(F.lit("x")).alias("toks"), F.array(F.lit(1)).alias("input_ids"), F.lit("x").alias("text"))
    vocab = spark.createDataFrame([("x", 0)], "token string, id int")
    merges = subword.Merges(np.arange(256), np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64))

    class Model:
        def opened(self, open_model):
            return lambda ids, lengths: np.ones((len(ids), 1))
    try:
        for step in (lambda: tokens.encode(df, vocab, "toks", vocab_size_bound=1), lambda: subword.encode_subword(df, "text", merges),
                     lambda: user_model.score_with(df, Model(), None, [("m", 0)])):
            spark.conf.set(keys[0], "10000")
            assert step().count() == 3000
            assert int(spark.conf.get(keys[0])) <= 1000 and int(spark.conf.get(keys[1])) <= 16 << 20
    finally:
        for k, v in zip(keys, before):
            spark.conf.set(k, v)


def test_token_pattern_in_both_forms(spark):
    from textfold.functions.text import FAST_TOKEN_PATTERN, TOKEN_PATTERN

    texts = ["ab1c, d中文e", "été x€y +1\t\n\u000b z", "", "a b　c \u0000q", "\U0001f600á 豈-١½_"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in df.select(F.regexp_extract_all("text", F.lit(TOKEN_PATTERN), 0).alias("a"), F.regexp_extract_all("text", F.lit(FAST_TOKEN_PATTERN), 0).alias("b")).collect():
        assert r["a"] == r["b"]


def test_predictions_with_rare_tokens_joined(spark):
    """A model larger than the tasks may have: frequent tokens in place, the others joined; rows of one id stay apart."""
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(30)]
    train = spark.createDataFrame([(f"t{i}", sorted({words[int(x * x * 30)] for x in rng.random(6)}), i % 3, int(rng.integers(-9000, 9000))) for i in range(50)],
                                  "row_id string, toks array<string>, kfold int, target long")
    rows = spark.createDataFrame([("a", ["w0", "w29", "new", None]), ("a", ["w1"]), ("b", []), ("c", None), (None, words)], "row_id string, toks array<string>")
    model = distill.fit(distill._train_adds(train, 3, 1), 3)
    n = model.tokens.count()
    want = sorted(map(str, distill.predict(rows, model).collect()))
    for most in (0, 1, n // 2, n - 1, n):
        local, others = distill._split(model.tokens, most)
        assert local.num_rows <= most and local.num_rows + (others.count() if others else 0) == n
        assert sorted(map(str, distill.predict(rows, model, most).collect())) == want
    often = {r["token"]: r["n"] for r in model.tokens.collect()}
    local, others = distill._split(model.tokens, n // 2)
    assert 0 < local.num_rows and min(often[t] for t in local["token"].to_pylist()) > max(often[r["token"]] for r in others.collect())


def test_labels_meet_rows_in_buckets(spark):
    """Rows in buckets of their id aren't shuffled for their labels, nor the training rows summed again for a student."""
    extra = bucketed(spark.createDataFrame([("x1", ["a", "b"]), ("x2", ["b"]), ("x2", ["c"])], "row_id string, toks array<string>"), "row_id", "test_rows")
    train = spark.createDataFrame([("t1", ["a"], 0, 9), ("t2", ["a", "c"], 1, -5)], "row_id string, toks array<string>, kfold int, target long")
    labels = spark.createDataFrame([("x1", [3, None]), ("x2", [4, 5])], "row_id string, t array<bigint>")
    adds = distill._pseudo_adds(extra, labels, 2)
    plan = adds._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Sort [" not in plan
    teacher = distill.fit(distill._train_adds(train, 2, 1), 2)
    student = distill.fold_wise_student(teacher.sums, extra, labels, 2, 3)
    assert {r["token"]: r["v"] for r in student.tokens.collect()} == {"a": [-3, 9], "b": [3, 5], "c": [-2, 5]}  # towards zero
    assert student.base.first()["v"] == [0, 7]
    single = distill.single_student(extra, labels, 2)
    both = distill.continued(teacher.sums, single, 2, 3)
    assert {r["token"]: r["v"] for r in both.tokens.collect()} == {"a": [-5, 9], "b": [4, 4], "c": [-2, 4]}


def test_fold_models_read_rows_made_once(spark):
    """The predictions read the written features; tokens are not made again for every fold."""
    from pyspark.sql import functions as F

    from textfold.operators import cycles

    rows = spark.createDataFrame([(f"r{i}", i % 3, i % 2, f"{'good' if i % 2 else 'bad'} w{i % 7}") for i in range(42)], "row_id string, kfold int, label int, text string")
    p = cycles.fit_folds(rows.withColumn("toks", F.split("text", " ")), "toks", "label", k=3, num_features=64, max_iter=3)
    plan = p._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" not in plan and plan.count("parquet") == 3  # each fold's own rows, as written
    got = {r["row_id"]: r for r in p.collect()}
    assert len(got) == 42 and all(r["fold"] == int(k[1:]) % 3 and (r["logit"] > 0) == bool(int(k[1:]) % 2) for k, r in got.items())
