"""Approximate nearest neighbours by an inverted multi-index.

A normalised vector is two halves, and each half is quantised by its own ``K`` centroids, so a vector lies in one
of ``K * K`` cells. A query walks the cells in the order of the summed distances of their two centroids,
with a heap over centroid pairs, until the cells it passed hold the wanted share of all vectors; their entries
are reranked by the exact cosine of the original vectors in double precision.

Fitting uses a bounded sample: ``FIT_VECTORS`` distinct vectors with the smallest key hashes, for k-means
and for the share: the smallest of ``SHARES`` that finds ``FIT_RECALL`` of the true neighbours of
``FIT_QUERIES`` of them. Every row is indexed. Vectors that are equal are one entry with its smallest ids (as
many as one query can return, all it takes), pre-aggregated in each task, so a vector in a third of all rows is
one entry. Cells larger than ``BLOCK_ENTRIES`` are dealt over several blocks, each searched on its own.

Defined results: vectors that are null, zero, of another length than the most common one of the sample, or
hold null or non-finite components take no part; rows without an id neither; fewer candidates than asked
for: all of them; ties go to the smaller id; repeated ids are one vector each; further columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import materialize

K_RANGE = (8, 64)  # the fourth root of the number of distinct vectors, within these bounds
FIT_VECTORS = 8192
FIT_QUERIES = 128
FIT_RECALL = 0.95
SHARES = (0.01, 0.02, 0.03, 0.05, 0.07, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.9, 1.0)
KMEANS_ROUNDS = 12
BLOCK_ENTRIES = 4096
QUERY_ROWS = 256


def matrix(col: pa.Array) -> np.ndarray:
    """The vectors of a list column, all of one length."""
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1) if len(col) else np.zeros((0, 0))


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def clean(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, v) of the vectors that take part, as doubles."""
    v = F.col(embedding).cast("array<double>")
    d = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), v.alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return d.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0))


def kmeans(x: np.ndarray, k: int, rounds: int = KMEANS_ROUNDS) -> np.ndarray:
    """Centroids, from evenly spaced rows on; an empty cluster takes the row farthest from its centroid."""
    c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        d = ((c * c).sum(axis=1)[None] - 2 * x @ c.T)
        near = d.argmin(axis=1)
        for j in range(len(c)):
            own = near == j
            c[j] = x[own].mean(axis=0) if own.any() else x[(d.min(axis=1) + (x * x).sum(axis=1)).argmax()]
    return c


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None] - 2 * x @ c.T


class Index:
    """Centroids of both halves, entries of each cell, and the share of entries a query looks at."""

    def __init__(self, left: np.ndarray, right: np.ndarray):
        self.left, self.right, self.half = left, right, left.shape[1]
        self.sizes = np.zeros(len(left) * len(right), dtype=np.int64)
        self.share = 1.0

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        u = unit(x)
        return distances(u[:, :self.half], self.left), distances(u[:, self.half:], self.right)

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.halves(x)
        return a.argmin(axis=1) * len(self.right) + b.argmin(axis=1)

    def walk(self, a: np.ndarray, b: np.ndarray):
        """Cells by summed distance, nearest first (the multi-sequence algorithm)."""
        i_order, j_order = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        heap, pushed = [(a[i_order[0]] + b[j_order[0]], 0, 0)], {(0, 0)}
        while heap:
            _, i, j = heapq.heappop(heap)
            yield int(i_order[i]) * len(b) + int(j_order[j])
            for x, y in ((i + 1, j), (i, j + 1)):
                if x < len(a) and y < len(b) and (x, y) not in pushed:
                    pushed.add((x, y))
                    heapq.heappush(heap, (a[i_order[x]] + b[j_order[y]], x, y))

    def visited(self, x: np.ndarray, wanted: float) -> list[list[int]]:
        """For each query the cells with entries it looks at, until ``wanted`` entries are passed."""
        out = []
        for a, b in zip(*self.halves(x)):
            passed, cells = 0, []
            for cell in self.walk(a, b):
                if passed >= wanted:
                    break
                if self.sizes[cell]:
                    cells.append(cell)
                    passed += int(self.sizes[cell])
            out.append(cells)
        return out


def fit(distinct: DataFrame, neighbours: int, k: int | None = None) -> Index | None:
    """Index of a bounded sample of the distinct vectors: centroids, and the share that reaches the recall."""
    rows = distinct.select("v").orderBy(F.xxhash64("v"), "v").limit(FIT_VECTORS).toArrow()["v"].combine_chunks()
    if not len(rows):
        return None
    size = np.bincount(np.diff(rows.offsets.to_numpy())).argmax()
    rows = rows.filter(pa.compute.equal(pa.compute.list_value_length(rows), int(size)))
    x = unit(matrix(rows))
    half = x.shape[1] // 2
    k = k or int(np.clip(round(distinct.count() ** 0.25), *K_RANGE))
    index = Index(kmeans(x[:, :half], k), kmeans(x[:, half:], k))
    index.dim = x.shape[1]
    cell = index.cells(x)
    index.sizes = np.bincount(cell, minlength=len(index.sizes))
    q = np.arange(0, len(x), max(1, len(x) // FIT_QUERIES))[:FIT_QUERIES]
    s = x[q] @ x.T
    s[np.arange(len(q)), q] = -np.inf
    n = min(neighbours, len(x) - 1)
    if n:
        true = np.argpartition(-s, n - 1, axis=1)[:, :n]
        for share in SHARES:
            seen = [np.isin(cell[t], cells).mean() for t, cells in zip(true, index.visited(x[q], share * len(x)))]
            if np.mean(seen) >= FIT_RECALL:
                break
        index.share = share
    return index


def _smallest_ids(keep: int):
    """Distinct vectors of a task with their smallest ids."""
    def run(batches):
        for batch in batches:
            ids: dict[bytes, list[int]] = {}
            for i, v in zip(batch["vec_id"].to_pylist(), matrix_rows(batch["v"])):
                ids.setdefault(v, []).append(i)
            yield pa.RecordBatch.from_arrays(
                [pa.array([np.frombuffer(v, np.float64) for v in ids], pa.list_(pa.float64())),
                 pa.array([sorted(set(i))[:keep] for i in ids.values()], pa.list_(pa.int64()))], ["v", "ids"])
    return run


def matrix_rows(col: pa.Array) -> list[bytes]:
    off = col.offsets.to_numpy()
    raw = (col.values.to_numpy(zero_copy_only=False) + 0.0).tobytes()  # -0.0 becomes 0.0
    return [raw[8 * a:8 * b] for a, b in zip(off[:-1].tolist(), off[1:].tolist())]


def _assign(index: Index):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                cell = index.cells(matrix(batch["v"]))
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), batch["v"], batch["ids"]], ["cell", "v", "ids"])
    return run


def _visit(index: Index, wanted: float, salts: np.ndarray):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [(i, c, s) for i, cells in enumerate(index.visited(matrix(batch["v"]), wanted))
                    for c in cells for s in range(salts[c])]
            at, cell, salt = (np.array(x, np.int64) for x in zip(*rows))
            for a in range(0, len(at), 10_000):
                t = pa.array(at[a:a + 10_000])
                yield pa.RecordBatch.from_arrays([pa.array(cell[a:a + 10_000]), pa.array(salt[a:a + 10_000]),
                                                  batch["q"].take(t), batch["v"].take(t)], ["cell", "salt", "q", "v"])
    return run


def cosines(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``q`` with the same row of ``v``, summed in one fixed order."""
    dot, qq, vv = (np.add.reduce(x, axis=1) for x in (q * v, q * q, v * v))
    return dot / (np.sqrt(qq) * np.sqrt(vv))


def _score(keep: int):
    out = pa.schema([("q", pa.int64()), ("ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.float64()))])

    def run(key, queries: pa.Table, entries: pa.Table) -> pa.Table:
        if not queries.num_rows or not entries.num_rows:
            return out.empty_table()
        q, v = matrix(queries["v"].combine_chunks()), matrix(entries["v"].combine_chunks())
        ids = entries["ids"].to_pylist()
        first = np.array([i[0] for i in ids])
        found_ids, found = [], []
        n, unit_v = min(keep, len(v)), unit(v).T
        for i in range(len(q)):
            if i % QUERY_ROWS == 0:
                near = unit(q[i:i + QUERY_ROWS]) @ unit_v
            row = near[i % QUERY_ROWS]
            at = np.flatnonzero(row >= np.partition(row, len(v) - n)[len(v) - n] - 1e-9)  # ties at the edge stay in
            s = cosines(np.broadcast_to(q[i], (len(at), q.shape[1])), v[at])
            best = sorted((-x, j) for x, a in zip(s.tolist(), at.tolist()) for j in ids[a])[:keep]
            found_ids.append([j for _, j in best])
            found.append([-x for x, _ in best])
        return pa.table([queries["q"].combine_chunks(), pa.array(found_ids, pa.list_(pa.int64())),
                         pa.array(found, pa.list_(pa.float64()))], schema=out)
    return run


def search(vectors: DataFrame, queries: DataFrame, neighbours: int = 5, vec_id: str = "vec_id",
           embedding: str = "embedding", k: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest ``neighbours`` found of each row of ``queries`` among the
    other rows of ``vectors``. Both have the columns ``vec_id`` and ``embedding``."""
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    keep = neighbours + 1  # a query's own id may be among the ids of its vector
    local = clean(vectors, vec_id, embedding).mapInArrow(_smallest_ids(keep), "v array<double>, ids array<bigint>")
    distinct = local.groupBy("v").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep).alias("ids"))
    distinct = materialize(distinct, "ann-vectors")
    index = fit(distinct, neighbours, k)
    if index is None:
        return empty
    distinct = distinct.filter(F.size("v") == index.dim)
    entries = materialize(distinct.mapInArrow(_assign(index), "cell bigint, v array<double>, ids array<bigint>"), "ann-cells")
    index.sizes = np.zeros_like(index.sizes)
    for r in entries.groupBy("cell").count().collect():  # at most K * K rows
        index.sizes[r["cell"]] = r["count"]
    salts = np.maximum(1, -(-index.sizes // BLOCK_ENTRIES))
    salt_of = F.element_at(F.array(*[F.lit(int(s)) for s in salts]), (F.col("cell") + 1).cast("int"))
    entries = entries.withColumn("salt", F.pmod(F.xxhash64("v"), salt_of).cast("bigint"))
    asked = clean(queries, vec_id, embedding).withColumnRenamed("vec_id", "query_id")
    asked = asked.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0))).filter(F.size("v") == index.dim)
    asked = materialize(asked, "ann-queries")
    unique = materialize(asked.groupBy("v").agg(F.min("query_id").alias("q")), "ann-asked")  # equal vectors ask once
    visits = unique.select("q", "v").mapInArrow(_visit(index, index.share * int(index.sizes.sum()), salts),
                                                "cell bigint, salt bigint, q bigint, v array<double>")
    found = (visits.groupBy("cell", "salt").cogroup(entries.groupBy("cell", "salt"))
             .applyInArrow(_score(keep), "q bigint, ids array<bigint>, scores array<double>"))
    # The few nearest of a block stay a list; a query's lists, one per block it looks at, are merged where they meet.
    few = F.zip_with("ids", "scores", lambda i, s: F.struct((-s).alias("far"), i.alias("vec_id"))).alias("few")
    best = found.select("q", few).groupBy("q").agg(F.slice(F.array_sort(F.flatten(F.collect_list("few"))), 1, keep).alias("best"))
    near = asked.join(unique.join(best, "q").select("v", "best"), "v").select("query_id", F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1,
                                                            neighbours).alias("best"))
    return near.select("query_id", F.posexplode("best").alias("pos", "e")).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("e.vec_id").alias("vec_id"), (-F.col("e.far")).alias("score"))
