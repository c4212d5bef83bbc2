from pyspark.sql import functions as F

from textfold.functions.numeric import sigmoid
from textfold.operators import ensemble, metrics, tokens


def test_tokenize(spark):
    df = spark.createDataFrame([("ab你好c 1",)], "t string")
    assert df.select(tokens.tokenize(F.col("t"))).first()[0] == ["ab", "你", "好", "c", "1"]


def test_pad_and_pair(spark):
    df = spark.createDataFrame([([7, 8, 9],)], "ids array<int>")
    ids, mask = tokens.pad_to(F.col("ids"), 5)
    r = df.select(ids.alias("i"), mask.alias("m")).first()
    assert r.i == [7, 8, 9, 0, 0] and r.m == [1, 1, 1, 0, 0]
    cases = [((9, 2), (3, 2)), ((2, 9), (2, 3)), ((3, 9), (3, 2)), ((1, 2), (1, 2))]
    pdf = spark.createDataFrame([(a, b) for (a, b), _ in cases], "la int, lb int")
    a2, b2 = tokens.pair_budget(F.col("la"), F.col("lb"), 8)  # budget 5
    got = [(r[0], r[1]) for r in pdf.select(a2, b2).collect()]
    assert got == [e for _, e in cases]


def test_pair_budget_matches_loop(spark):
    def loop(la, lb, t):
        while la + lb > t:
            if la > lb:
                la -= 1
            else:
                lb -= 1
        return la, lb

    rows = [(la, lb) for la in range(0, 15) for lb in range(0, 15)]
    df = spark.createDataFrame(rows, "la int, lb int")
    for t in (2, 5, 8):
        a2, b2 = tokens.pair_budget(F.col("la"), F.col("lb"), t + 3)
        got = [(r[0], r[1]) for r in df.select(a2, b2).collect()]
        assert got == [loop(a, b, t) for a, b in rows]


def test_mlm_mask_properties(spark):
    ids = [2] + list(range(10, 60)) + [3] + [0] * 12
    df = spark.createDataFrame([(str(i), ids) for i in range(40)], "row_id string, ids array<int>")
    m = tokens.mlm_mask(df, "ids", seed=1, epoch=0, vocab_len=100).collect()
    sel = 0
    for r in m:
        for x, inp, lab in zip(ids, r.masked_ids, r.labels):
            if x in (0, 1, 2, 3, 4):
                assert lab == -100 and inp == x
            if lab != -100:
                sel += 1
                assert lab == x
            else:
                assert inp == x
    assert 0.08 < sel / (40 * 50) < 0.22
    again = tokens.mlm_mask(df, "ids", seed=1, epoch=0, vocab_len=100).collect()
    assert [r.masked_ids for r in again] == [r.masked_ids for r in m]


def _pred(spark, rows):
    return spark.createDataFrame(rows, "row_id string, model string, fold int, logit double")


def test_ensembles(spark):
    p = _pred(spark, [("r", "m1", 0, 1.0), ("r", "m1", 1, 3.0), ("r", "m2", 2, 5.0)])
    assert ensemble.final_labels(p).first().target == 3.5
    p2 = _pred(spark, [("r", "m1", 0, 1.0), ("r", "m2", 0, 2.0)])
    w = spark.createDataFrame([("m1", 0.33), ("m2", 0.67)], "model string, w double")
    assert abs(ensemble.fold_labels(p2, weights=w).first().target - 1.67) < 1e-12
    lab = spark.createDataFrame([("a", f, float(f + 1)) for f in range(5)] +
                                [("b", f, None if f == 1 else float(f + 1)) for f in range(5)],
                                "row_id string, fold int, target double")
    got = {r.row_id: r.target for r in ensemble.average_pseudo(lab).collect()}
    assert got == {"a": 3.0, "b": None}
    tie = _pred(spark, [("r", f"m{i}", 0, x) for i, x in enumerate([2.0, -1.0, .5, -.2])])
    assert ensemble.vote(tie).first().vote == 0
    v = ensemble.vote(_pred(spark, [("r", f"m{i}", 0, x) for i, x in enumerate([1.0, 1.0, -9.0])])).first()
    assert v.vote == 1 and v.soft_vote == 0 and abs(v.mean_prob - 0.4874) < 1e-4


def test_agreement_by_length(spark):
    a = spark.createDataFrame([("x", 1), ("y", 1)], "row_id string, vote int")
    b = spark.createDataFrame([("x", 1), ("y", 0)], "row_id string, vote int")
    lens = spark.createDataFrame([("x", 32), ("y", 33)], "row_id string, n_tokens int")
    got = {r.bucket: (r.n_equal, r.n_rows) for r in ensemble.agreement_by_length(a, b, lens).collect()}
    assert got == {"<=32": (1, 1), ">32": (0, 1)}


def test_metrics(spark):
    df = spark.createDataFrame([(str(i), f"{i:02x}", 1.0, 0.0) for i in range(4)], "row_id string, k string, y double, p double")
    assert metrics.rmse(df, "p", "y").first().rmse == 1.0
    assert abs(metrics.batch_rmse(df, "p", "y", 2, "k").first().batch_rmse - 1.414214) < 1e-6
    z = spark.createDataFrame([(str(i), f"{i:02x}", 0.0, 1) for i in range(3)], "row_id string, k string, x double, y int")
    assert abs(metrics.bce(z, "x", "y").first().bce - 0.693147) < 1e-6
    assert abs(metrics.batch_bce(z, "x", "y", 2, "k").first().batch_bce - 1.074823) < 1e-6


def test_best_checkpoint(spark):
    log = spark.createDataFrame([(0, 0, 320, .1), (0, 0, 326, .5), (0, 0, 330, .4), (0, 0, 334, .4)],
                                "fold int, epoch int, step long, metric double")
    assert metrics.best_checkpoint(log, "a", centre=330, radius=5).first().step == 330
    log_b = spark.createDataFrame([(0, 0, 99, .1), (0, 1, 99, .3)], "fold int, epoch int, step long, metric double")
    assert metrics.best_checkpoint(log_b, "b").first().epoch == 1


def test_sigmoid(spark):
    assert abs(spark.range(1).select(sigmoid(F.lit(0.3))).first()[0] - 0.574442516811659) < 1e-15


def test_score_models_equals_per_model_scoring(spark):
    from textfold.operators import scoring

    rows = spark.createDataFrame([("a", ["x", "y", "x"]), ("b", ["z"]), ("c", [])], "row_id string, toks array<string>")
    b = scoring.BIAS_TOKEN
    w = spark.createDataFrame(
        [(m, f, t, v) for m in ("cnt", "bin") for f in (0, 1)
         for t, v in (("x", 3 if m == "cnt" else 5), ("y", -2), ("z", 7 + f), (b, 10 * (f + 1)))],
        "model string, fold int, token string, w bigint")
    both = {(r.row_id, r.model, r.fold): r.logit_milli
            for r in scoring.score_models(rows, "toks", w, binary_models=("bin",)).collect()}
    cnt = scoring.score_linear(rows, "toks", w.filter("model = 'cnt'"))
    bnr = scoring.score_linear(rows, "toks", w.filter("model = 'bin'"), binary=True)
    single = {(r.row_id, r.model, r.fold): r.logit_milli for r in cnt.unionByName(bnr).collect()}
    assert both == single and len(both) == 3 * 2 * 2
    assert both[("a", "cnt", 0)] == 3 + (-2) + 3 + 10 and both[("a", "bin", 0)] == 5 - 2 + 10
    assert both[("c", "bin", 1)] == 20  # no tokens: bias only
