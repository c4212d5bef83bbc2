"""Substring dedup and n-gram Jaccard join against brute force; edge inputs."""

import random

import numpy as np
import pytest

from textfold.llm import jaccard_join, superkmer
from tests.llm import brute

SF = "/root/testdata/sf0.001/documents.parquet"


def key(row):
    return tuple((x is not None, x) for x in row)


def frame(spark, rows):
    # clashing names of inner columns
    return spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, digest int, c string")


EDGE = [(1, None), (2, ""), (3, "a b c"), (None, "x " * 20), (4, "x " * 20), (5, "x " * 20), (5, "x " * 20),
        (6, " ".join(map(str, range(40)))), (7, " ".join(map(str, range(5, 30))) + "\n\n q"),
        (8, "\n".join(map(str, range(10, 60)))), (8, "zz " * 13), (9, "A b C"), (None, None), (None, "x " * 20),
        (10, "w" * 100_000 + " " + "v " * 30_000), (11, " \t\n ")]


def test_superkmer_edges(spark):
    got = [tuple(r) for r in superkmer.remove_repeats(frame(spark, EDGE)).drop("kept").collect()]
    assert sorted(got, key=key) == sorted(brute.remove_repeats(EDGE), key=key)
    assert superkmer.remove_repeats(frame(spark, EDGE).limit(0)).count() == 0


def test_superkmer_documents(spark):
    df = spark.read.parquet(SF)
    got = [tuple(r) for r in superkmer.remove_repeats(df, bucket_bytes=20_000).drop("kept").collect()]
    assert sorted(got) == sorted(brute.remove_repeats([tuple(r) for r in df.select("doc_id", "text").collect()]))


def test_equal_windows_with_colliding_hashes():
    ids = np.array([1, 2, 3, 1, 2, 3, 1, 2, 4], dtype=np.int32)
    at = np.arange(len(ids) - 2)
    order, begins = superkmer.equal_windows(ids, at, 3)
    groups = {tuple(sorted(g)) for g in np.split(order, begins[1:])}
    assert groups == {(0, 3), (1, 4), (2, 5), (6,)}


def test_jaccard_edges(spark):
    got = [tuple(r) for r in jaccard_join.link_documents(frame(spark, EDGE)).collect()]
    assert sorted(got, key=key) == sorted(brute.link_documents(EDGE), key=key)
    assert jaccard_join.link_documents(frame(spark, EDGE).limit(0)).count() == 0


@pytest.mark.parametrize("seed", [2])
def test_jaccard_random_near_copies(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    common = [rng.choice(vocabulary) for _ in range(30)]
    rows = []
    for i in range(60):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(1, 90))] + common * rng.randrange(2)
        rows.append(w)
        for _ in range(rng.randrange(8)):
            x = list(rng.choice(rows[-3:])) or ["one"]
            for _ in range(rng.randrange(4)):
                x[rng.randrange(len(x))] = rng.choice(vocabulary)
            rows.append(x[rng.randrange(3):] or x[:1] or ["one"])
    rng.shuffle(rows)
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    got = [tuple(r) for r in jaccard_join.link_documents(frame(spark, rows)).collect()]
    assert sorted(got) == sorted(brute.link_documents(rows))


def test_jaccard_documents(spark):
    df = spark.read.parquet(SF)
    got = [tuple(r) for r in jaccard_join.link_documents(df).collect()]
    assert sorted(got) == sorted(brute.link_documents([tuple(r) for r in df.select("doc_id", "text").collect()]))


def test_prefixes_hold_a_shared_shingle():
    for n in range(1, 200):
        for m in range(1, n + 1):
            need = -(-3 * (n + m) // 7)
            if need <= m:
                assert jaccard_join.probe_prefix(n) >= n - need + 1
                assert jaccard_join.index_prefix(m) >= m - need + 1


def test_parities_bound_the_difference():
    rng = np.random.default_rng(0)
    sizes = [0, 1, 70, 300, 400, 900, 901]
    first = np.concatenate(([0], np.cumsum(sizes)))
    base = rng.integers(0, 1 << 63, 1200, dtype=np.uint64)
    gram = np.concatenate([np.sort(rng.choice(base, n, replace=False)) for n in sizes])
    short, long_ = jaccard_join.parities(gram, first), jaccard_join.long_parities(gram, first).to_pylist()
    for i in range(len(sizes)):
        for j in range(len(sizes)):
            differ = len(set(gram[first[i]:first[i + 1]].tolist()) ^ set(gram[first[j]:first[j + 1]].tolist()))
            assert sum((int(s[i]) ^ int(s[j])) .__and__((1 << 64) - 1).bit_count() for s in short) <= differ
            x, y = (np.array(long_[k], dtype=np.int64).view(np.uint64) for k in (i, j))
            m = min(len(x), len(y))
            x, y = (np.bitwise_xor.reduce(v.reshape(-1, m), axis=0) for v in (x, y))
            assert int(np.bitwise_count(x ^ y).sum()) <= differ


def test_star_pairs_stream_over_batches():
    """The pairs of a list don't depend on where its batches end, and are those of its first rows with all others."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    t = np.sort(rng.integers(0, 12, 90))
    rows = {"t": t, "c": rng.permutation(90), "n": rng.integers(8, 12, 90), "pos": rng.integers(0, 2, 90), "comp": rng.integers(0, 60, 90)}
    rows |= {b: rng.integers(-3, 3, 90) for b in jaccard_join.PARITY}
    table = pa.table({k: pa.array(np.asarray(v, np.int64)) for k, v in rows.items()})
    got = []
    for size in (1, 2, 7, 90):
        out = [r for b in jaccard_join._star_pairs(table.to_batches(max_chunksize=size)) for r in zip(*(c.to_pylist() for c in b.columns))]
        got.append(sorted(out))
    want = []
    for x in range(90):
        first = int(np.searchsorted(t, t[x]))
        for h in range(first, min(first + jaccard_join.HUBS, x)):
            n1, n2, p1, p2 = (int(rows[k][i]) for k in ("n", "pos") for i in (x, h))
            differ = sum(bin((int(rows[b][x]) ^ int(rows[b][h])) & (1 << 64) - 1).count("1") for b in jaccard_join.PARITY)
            if 4 * n1 >= 3 * n2 and 4 * n2 >= 3 * n1 and 7 * min(n1 - p1, n2 - p2) >= 3 * (n1 + n2) and rows["comp"][x] != rows["comp"][h] and 7 * differ <= n1 + n2:
                a, b = sorted((int(rows["c"][x]), int(rows["c"][h])))
                want.append((a, b, n1 + n2))
    assert all(g == sorted(want) for g in got) and len(want) > 3
