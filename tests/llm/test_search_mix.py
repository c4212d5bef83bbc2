"""Nearest neighbours, source mixing, and the pipeline."""

import math
import sys

import numpy as np

from textfold.llm import multi_index, pareto_mix
from tests.llm import brute

SF = "/root/testdata/sf0.01"


def nearest(rows, queries, n):
    ids = np.array([i for i, _ in rows])
    v = np.array([x for _, x in rows], dtype=np.float64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    out = {}
    for i, x in queries:
        s = np.array(x, dtype=np.float64) @ v.T / np.linalg.norm(x)
        out[i] = sorted((-round(c, 12), j) for c, j in zip(s, ids) if j != i)[:n]
    return out


def test_recall_and_order(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    got = {}
    for r in multi_index.search(df, df.filter("vec_id % 50 = 0")).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    true = nearest(rows, [r for r in rows if r[0] % 50 == 0], 5)
    assert set(got) == set(true)
    found = [j in {v for v, _ in got[q].values()} for q in true for _, j in true[q]]
    assert np.mean(found) >= 0.9
    for q, hits in got.items():
        assert sorted(hits) == [1, 2, 3, 4, 5]
        scores = [hits[k][1] for k in sorted(hits)]
        assert scores == sorted(scores, reverse=True)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0, 0.0, 1.0]), (50, [1.0, 0.0, 0.0, 1.0]), (7, [1.0, 0.0, 0.0, 1.0]), (3, [0.0, 1.0, 0.0, 0.0]),
            (9, [-0.0, 1.0, 0.0, 0.0]), (100, None), (4, [0.0] * 4), (5, [nan, 1.0, 0.0, 0.0]), (6, [inf, 1.0, 0.0, 0.0]),
            (8, [1.0, None, 0.0, 0.0]), (150, [1.0, 2.0]), (None, [1.0, 0.0, 0.0, 1.0]), (11, [2.0, 0.0, 0.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, cell int, q int")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9))
                 for r in multi_index.search(df, df.filter("vec_id % 50 = 0")).collect())
    assert got == [(0, 1, 7, 1.0), (0, 2, 11, 1.0), (0, 3, 50, 1.0), (0, 4, 3, 0.0), (0, 5, 9, 0.0),
                   (50, 1, 0, 1.0), (50, 2, 7, 1.0), (50, 3, 11, 1.0), (50, 4, 3, 0.0), (50, 5, 9, 0.0)]
    assert multi_index.search(df.limit(0), df.limit(0)).count() == 0
    alone = df.filter("vec_id = 0")
    assert multi_index.search(alone, alone).count() == 0


def test_one_vector_in_most_rows(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 8)).round(3)
    x[np.arange(600) % 3 != 0] = x[1]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    true = nearest(rows, [r for r in rows if r[0] % 50 == 0], 5)
    got = {}
    for r in multi_index.search(df, df.filter("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    same = [q for q in true if (x[q] == x[1]).all()]
    assert same and all(got[q] == [j for _, j in true[q]] for q in same)


def test_walk_is_in_order():
    rng = np.random.default_rng(4)
    index = multi_index.Index(rng.normal(size=(5, 2)), rng.normal(size=(7, 2)))
    a, b = rng.random(5), rng.random(7)
    walked = [a[c // 7] + b[c % 7] for c in index.walk(a, b)]
    assert len(walked) == 35 and walked == sorted(walked)


# ------------------------------------------------------------------ mixing

def targets(sizes, most=3):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(most * sizes[s] for s in capped)
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s] + 1e-9]
        if not over:
            return {s: share.get(s, most * sizes[s]) for s in names}
        capped.update(over)


def check_mix(rows, got):
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len(brute.WORD.findall(t or ""))
    want, largest, taken = targets(sizes), {}, {}
    assert len(got) == len(rows)
    for r in got:
        s = r["source"]
        assert r["source_size"] == sizes[s] and math.isclose(r["target"], want[s], rel_tol=1e-9, abs_tol=1e-9)
        assert r["taken"] == r["size"] * r["copies"] and r["taken"] <= 3 * r["size"]
        if r["size"]:
            assert r["copies"] in (want[s] // sizes[s], want[s] // sizes[s] + 1) or math.isclose(want[s] % sizes[s], 0, abs_tol=1e-6)
        largest[s] = max(largest.get(s, 0), r["size"])
        taken[s] = taken.get(s, 0) + r["taken"]
    return sizes, want, largest, taken


def test_mix_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["source"], r["text"]) for r in df.collect()]
    got = pareto_mix.mix_sources(df).collect()
    sizes, want, largest, taken = check_mix(rows, got)
    off = {s: abs(taken[s] - want[s]) / want[s] for s in sizes}
    assert max(off.values()) < 0.02, off
    again = pareto_mix.mix_sources(df.repartition(7)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))
    mixed = pareto_mix.mixed(df)
    assert mixed.columns == df.columns and mixed.count() == sum(r["copies"] for r in got if r["size"])


def test_mix_edges(spark):
    rows = [(1, "b", None), (2, "b", ""), (3, None, "a b c"), (None, "a", "x y"), (5, "\U0001f600", "w " * 50), (5, "\U0001f600", "w " * 50),
            (6, "￿", "v " * 200), (7, "c", "u " * 20000), (8, "c", "u"), (9, "c", "u v")]
    df = spark.createDataFrame([(d, s, t, 1, 0.5) for d, s, t in rows], "doc_id long, source string, text string, size int, p double")
    check_mix(rows, pareto_mix.mix_sources(df).collect())
    assert pareto_mix.mix_sources(df.limit(0)).count() == 0
    assert pareto_mix.mixed(df.limit(0)).count() == 0


# ------------------------------------------------------------------ pipeline

def test_pipeline(spark):
    import corpus_pipeline
    from public_tokenizers import path
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        docs = stage(spark, docs, sf)
        assert docs.columns == names, name
        docs = corpus_pipeline.materialize(docs, "test")
        after = [r["doc_id"] for r in docs.collect()]
        if name == "language_id":
            assert after and set(after) <= {d for d, _ in before} and len(after) > 0.95 * len(before)
        if name == "ngram_jaccard_join":
            assert sorted(after) == sorted(d for d, _, c in brute.link_documents(before) if d == c)
        if name == "decontamination":
            from textfold.llm.edit_decontam import normal
            items = [normal(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            assert sorted(after) == sorted(d for d, t in before if not any(i in normal(t) for i in items))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = [tuple(r)[:4] for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()]
    assert sorted(got) == sorted(brute.token_rows(rows, Tokenizer.from_file(path("word_bpe_49k.json"))))
    assert "corpus_pipeline" in sys.modules
