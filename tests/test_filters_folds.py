import pytest
from pyspark.sql import functions as F

from textfold.operators import batching, filters, folds


def test_filters(spark):
    df = spark.createDataFrame([(32,), (33,), (128,), (129,)], "n int")
    assert sorted(r.n for r in filters.length_between(df, "n", 32, 128).collect()) == [33, 128]
    c = spark.createDataFrame([(0,), (1,), (2,), (None,)], "category int")
    assert sorted(filters.exclude_category(c).collect(), key=str) == sorted(
        [c.collect()[0], c.collect()[2], c.collect()[3]], key=str)
    h = spark.range(250).withColumnRenamed("id", "o")
    assert [r.o for r in filters.head_fraction(h, 100, ["o"]).collect()] == [0, 1]


def test_non_empty_forms(spark):
    df = spark.createDataFrame([("NA", 'q"uo', "0"), ("", "b", "1"), ("a", "b", "")], "text_a string, text_b string, label string")
    two = filters.non_empty(df, ["text_a", "text_b"]).collect()
    three = filters.non_empty(df, ["text_a", "text_b", "label"]).collect()
    assert [r.text_a for r in two] == ["NA", "a"] and [r.text_a for r in three] == ["NA"]


def test_dedup_and_mix(spark):
    d = spark.createDataFrame([("x", "y", 1), ("x", "y", 1), ("x", "y", 0), ("y", "x", 1)], "a string, b string, l int")
    assert filters.dedup(d).count() == 3
    pseudo = spark.createDataFrame([("p1", "t", 1.0), ("p2", "t", 2.0)], "row_id string, excerpt string, target double")
    train = spark.createDataFrame([("a", "t", 1.0, 0), ("b", "t", 1.0, 1), ("c", "t", 1.0, 1)],
                                  "row_id string, excerpt string, target double, kfold int")
    assert filters.mix_pseudo(pseudo, train, 0).count() == 8


def test_sturges_and_cut(spark):
    for n, k in [(100, 7), (2834, 12), (5000, 13)]:
        assert spark.range(n).select(folds.sturges_bins(spark.range(n))).first()[0] == k
    df = spark.createDataFrame([(float(x),) for x in range(8)], "x double")
    assert [r.bin for r in folds.cut(df, "x", 4).orderBy("x").collect()] == [0, 0, 1, 1, 2, 2, 3, 3]
    df = spark.createDataFrame([(0.0,), (5.0,), (10.0,)], "x double")
    assert [r.bin for r in folds.cut(df, "x", 2).orderBy("x").collect()] == [0, 0, 1]
    const = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    assert len({r.bin for r in folds.cut(const, "x", 5).collect()}) == 1


def _classes(spark, sizes):
    rows, i = [], 0
    for c, n in sizes:
        for _ in range(n):
            rows.append((f"r{i}", c))
            i += 1
    return spark.createDataFrame(rows, "row_id string, y int")


def test_stratified_counts(spark):
    df = _classes(spark, [(0, 7), (1, 5)])
    f = folds.assign_folds(df, "y", k=3, seed=1)
    per = {(r.kfold, r.y): r["count"] for r in f.groupBy("kfold", "y").count().collect()}
    sizes = [sum(v for (k, _), v in per.items() if k == i) for i in range(3)]
    assert sizes == [4, 4, 4]
    for c, n in [(0, 7), (1, 5)]:
        counts = sorted(per.get((i, c), 0) for i in range(3))
        assert max(counts) - min(counts) <= 1 and sum(counts) == n


def test_stratified_independent_of_partitioning(spark):
    df = _classes(spark, [(0, 70), (1, 31), (2, 9)])
    a = {r.row_id: r.kfold for r in folds.assign_folds(df, "y", k=5, seed=3).collect()}
    b = {r.row_id: r.kfold for r in folds.assign_folds(df.repartition(7), "y", k=5, seed=3).collect()}
    assert a == b


def test_stratified_error_when_all_classes_small(spark):
    df = _classes(spark, [(0, 3), (1, 2)])
    with pytest.raises(Exception, match="n_splits"):
        folds.assign_folds(df, "y", k=5).collect()


def test_labels_fixture(spark):
    lab = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").withColumn("row_id", F.col("doc_id").cast("string"))
    f = folds.assign_folds(lab, "quality", k=5, seed=42)
    got = {(r.kfold, r.quality): r["count"] for r in f.groupBy("kfold", "quality").count().collect()}
    assert [(got[(i, 1)], got[(i, 0)]) for i in range(5)] == [(69, 11), (68, 12), (68, 12), (68, 12), (68, 11)]


def test_block_shuffle_fixture(spark):
    lengths = [3, 9, 1, 7, 5, 5, 2, 8, 4, 6, 11]
    # order key = zero-padded index, so the input order is the row order
    df = spark.createDataFrame([(str(i), f"{i:04x}", n) for i, n in enumerate(lengths)], "row_id string, k string, n int")
    b = batching.block_shuffle(df, 2, "n", "k", sort_bs_num=2, shuffle=False, digits=2)
    order = [int(r.row_id) for r in b.orderBy("position").collect()]
    assert order == [1, 3, 0, 2, 7, 4, 5, 6, 9, 8, 10]
    g = batching.block_shuffle(df, 2, "n", "k", sort_bs_num=None, shuffle=True, digits=2)
    assert sorted(r.position for r in g.collect()) == list(range(11))


def test_batches(spark):
    df = spark.range(10).select(F.col("id").cast("string").alias("row_id"), F.md5(F.col("id").cast("string")).alias("k"))
    b = batching.assign_batches(df, "k", 4)
    assert sorted(r["count"] for r in b.groupBy("batch").count().collect()) == [2, 4, 4]
