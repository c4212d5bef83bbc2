"""Plan assertions: pruning reaches the scan, and ranks never use a single-task window over data."""

import re

from pyspark.sql import functions as F

from textfold.plans import catalog
from textfold.plans.ordering import hash_rank

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_folds_scan_is_pruned(spark):
    plan = _plan(catalog.QUERIES["folds_regression"](spark, SF))
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line and "documents.parquet" in line]
    assert scans, plan
    for s in scans:
        assert "text:string" not in s, s


def test_rank_windows_are_partitioned(spark):
    df = spark.read.parquet(f"{SF}/orders.parquet").select(F.col("o_orderkey").cast("string").alias("row_id"))
    ranked = hash_rank(df.withColumn("k", F.md5("row_id")), "k")
    ranked.collect()
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    # Every window over the data is partitioned by the bucket; the only unpartitioned window
    # runs over the small bucket-totals table, after an aggregate.
    windows = [line for line in plan.splitlines() if re.search(r"\bWindow \[", line)]
    assert any("__bkt" in w for w in windows)
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            below = " ".join(lines[i + 1:i + 4])
            assert "HashAggregate(keys=[__bkt" in below, below


def test_local_collection_is_size_checked(spark):
    import pytest

    from textfold.plans.local import TooLargeForLocal, to_local

    assert to_local(spark.range(5), 5).count() == 5
    with pytest.raises(TooLargeForLocal):
        to_local(spark.range(6), 5)


def test_bucket_digits_follow_group_bound():
    from textfold.plans.ordering import BUCKET_TABLE_BUDGET, digits_for_groups

    assert digits_for_groups(None) == 3
    assert digits_for_groups(1) == 4 and digits_for_groups(2) == 4 and digits_for_groups(64) == 3
    for g in (1, 2, 5, 16, 64, 1000, 100_000):
        d = digits_for_groups(g)
        assert 2 <= d <= 4
        assert g * 16 ** d <= BUCKET_TABLE_BUDGET or d == 2


def test_equal_lengths_are_cut_by_position(spark):
    from textfold.operators.batching import block_shuffle
    from textfold.plans.ordering import range_buckets, range_rank

    n = 5000
    df = spark.range(n).select(F.col("id").cast("string").alias("row_id"), F.lit(7).alias("len"),
                               F.md5(F.col("id").cast("string")).alias("k"), F.col("id").alias("pos"))
    points, ties = range_buckets(df, ["len", "pos"], n_buckets=16)
    assert points == [7.0] and len(ties[7.0]) >= 14
    ranked = range_rank(df, ["len", "pos"], splits=(points, ties))
    assert ranked.filter("_rank != pos").count() == 0
    got = block_shuffle(df, 8, "len", "k", sort_bs_num=None).groupBy("batch").count().collect()
    assert len(got) == n // 8 and all(r["count"] == 8 for r in got)


def test_encoding_does_not_regroup(spark):
    from textfold.operators import tokens

    df = spark.createDataFrame([("a", ["x", "y", "x"]), ("b", []), ("c", None), ("d", ["zz"])], "row_id string, toks array<string>")
    vocab = spark.createDataFrame([("x", 5), ("y", 6)], "token string, id int")
    e = tokens.encode(df, vocab, "toks", vocab_size_bound=10)
    assert {r.row_id: r.input_ids for r in e.collect()} == {"a": [5, 6, 5], "b": [], "c": [], "d": [tokens.UNK_ID]}
    assert "Exchange" not in _plan(e)
    assert {r.row_id: r.input_ids for r in tokens.encode(df, vocab, "toks").collect()} == {r.row_id: r.input_ids for r in e.collect()}


def test_out_of_fold_scoring_reads_one_fold(spark):
    from textfold.operators import scoring

    w = spark.createDataFrame([("m", f, t, 10 * f + (t == "x")) for f in range(3) for t in ("x", "y", scoring.BIAS_TOKEN)]
                              , "model string, fold int, token string, w bigint")
    rows = spark.createDataFrame([("a", ["x", "x", "q"], 2), ("b", [], 1)], "row_id string, toks array<string>, kfold int")
    own = {(r.row_id, r.fold): r.logit_milli for r in scoring.score_own_fold(rows, "toks", w).collect()}
    all_ = {(r.row_id, r.fold): r.logit_milli for r in scoring.score_models(rows, "toks", w).collect()}
    assert own == {("a", 2): 62, ("b", 1): 10} and own.items() <= all_.items() and len(all_) == 6


def test_labelled_texts_meet_their_labels_once(spark, tmp_path):
    """Texts and labels that come twice or are null; a text is in one join only, that of the labels to keep."""
    from textfold.plans import catalog

    docs = [(1, "x", "en", "s", 1), (10, "x", "en", "s", 1), (2, "x", "en", "s", 1), (2, "x", "en", "s", 1), (3, None, "en", "s", 0), (4, "y", None, None, None), (None, "y", "en", "s", 1)]
    labels = [(1, 0, 0), (10, 1, 0), (2, 0, 1), (2, 1, 1), (3, 0, 0), (3, 0, 0), (4, None, 0), (5, 1, 1), (None, 1, 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    lab = catalog.labelled(spark, str(tmp_path))
    assert lab.columns == ["row_id", "doc_id", "text", "lang", "source", "n_chars", "label", "toxic"]
    # of text x, label 0 has 1 and 2 and label 1 has 10 and 2: the smallest ids as strings are 1 and 10
    assert sorted((r["doc_id"], r["text"], r["label"]) for r in lab.collect()) == [(1, "x", 0), (3, None, 0), (3, None, 0), (4, "y", None), (10, "x", 1)]
    plan = lab._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    semi = next(i for i, line in enumerate(lines) if "Join LeftSemi" in line)
    assert "text#" not in lines[semi + 1]  # the labels are cut down, not the texts joined again
