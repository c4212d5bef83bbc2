"""Substring dedup: word windows counted exactly in super-k-mer buckets.

Every window of ``k`` words has a minimiser, the smallest hash of its ``m``-word runs. Consecutive
windows that share one travel as a single packed string (a super-k-mer) to the minimiser's bucket. A
bucket sorts its windows, compares the words of neighbours (equal hashes alone never count as equal),
and learns the smallest document of each. Identical super-k-mers of a task are sent once with the list
of their places, so a passage in a third of all documents costs its bucket a few bytes a place.

Minimisers of ``m`` words spread well: a frequent word or word pair does not make a hot bucket.

Defined results: null or empty text has no words and loses none; a text under ``k`` words has no
window; a null ``doc_id`` is not smaller than another and none is smaller than it, so that document
keeps all words; repeated rows with one ``doc_id`` don't remove each other's words; further columns of
the input are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .shared import small_batches
from .words import Words, slices, text_bytes

WINDOW = 13
MINIMISER_WORDS = 3
READ_BYTES = 2 << 20
FLUSH_BYTES = 16 << 20
BUCKET_BYTES = 4 << 20


def _pack(parts: list[np.ndarray]) -> bytes:
    """Arrays as one compressed string."""
    head = np.array([len(p) for p in parts], dtype=np.int64).tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(p.tobytes() for p in parts))


def _unpack(blob: bytes, kinds: list[type]) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = np.frombuffer(raw, dtype=np.int64, count=len(kinds))
    out, at = [], 8 * len(kinds)
    for kind, k in zip(kinds, n):
        out.append(np.frombuffer(raw, dtype=kind, count=k, offset=at))
        at += int(k) * np.dtype(kind).itemsize
    return out


# super-k-mers' lengths and bytes; then for each place: super-k-mer, document, row digest, first word
KINDS = [np.int32, np.uint8, np.int32, np.int64, np.int64, np.int32]


def super_kmers(w: Words, k: int = WINDOW, m: int = MINIMISER_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimiser, first word and number of windows of each super-k-mer of the texts."""
    gram = np.full(max(0, w.n_words), np.iinfo(np.uint64).max, dtype=np.uint64)
    h, at = w.ngrams(w.hashes(), m)
    gram[at] = h
    n = w.n_words - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    span, least, size = k - m + 1, gram, 1  # smallest of each run of `span` grams, by doubling
    while size < span:
        step = min(size, span - size)
        least = np.minimum(least[:len(least) - step], least[step:])
        size += step
    doc = w.doc()
    ok = doc[:n] == doc[k - 1:]
    least = least[:n]
    new = ok.copy()
    new[1:] &= (least[1:] != least[:-1]) | (doc[1:n] != doc[:n - 1])
    a = np.flatnonzero(new)
    total = np.concatenate(([0], np.cumsum(ok)))
    return least[a], a, np.diff(np.append(total[a], total[-1]))


def _send(n_buckets: int, k: int, m: int):
    def flush(held):
        texts = [t for part in held for t in part[0]]
        bucket, doc, digest, place = (np.concatenate(x) for x in list(zip(*held))[1:])
        order = np.argsort(bucket, kind="stable")
        bucket, doc, digest, place = bucket[order], doc[order], digest[order], place[order]
        cut = np.flatnonzero(np.diff(bucket)) + 1
        ids, blobs = [], []
        for x, y in zip([0, *cut], [*cut, len(bucket)]):
            seen: dict[bytes, int] = {}
            which = [seen.setdefault(texts[i], len(seen)) for i in order[x:y].tolist()]
            ids.append(int(bucket[x]))
            blobs.append(_pack([np.array([len(t) for t in seen], np.int32), np.frombuffer(b"".join(seen), np.uint8),
                                np.array(which, np.int32), doc[x:y], digest[x:y], place[x:y]]))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "packed"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            batch = batch.filter(pa.compute.is_valid(batch["doc_id"]))
            for a, b in slices(batch["text"], READ_BYTES):
                part = batch.slice(a, b - a)
                w = Words(*text_bytes(part["text"]))
                least, first, windows = super_kmers(w, k, m)
                if not len(first):
                    continue
                raw, s = w.data.tobytes(), w.start
                row = np.searchsorted(w.first, first, side="right") - 1
                held.append(([raw[x:y] for x, y in zip(s[first].tolist(), s[first + windows + k - 1].tolist())],
                             (least % np.uint64(n_buckets)).astype(np.int64),
                             part["doc_id"].to_numpy(zero_copy_only=False)[row],
                             part["digest"].to_numpy(zero_copy_only=False)[row], (first - w.first[row]).astype(np.int32)))
                size += len(raw)
                if size >= FLUSH_BYTES:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)
    return run


def equal_windows(ids: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Order that brings equal windows together, and the index in it where each distinct window begins.
    A window is the ``k`` word ids from ``at``."""
    h = np.zeros(len(ids) - k + 1, dtype=np.uint64)
    for j in range(k):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += ids[j:j + len(h)].astype(np.uint64)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h = h[at]
    order = np.argsort(h)
    near = h[order[1:]] == h[order[:-1]]
    x, y = at[order[:-1]][near], at[order[1:]][near]
    same = np.ones(len(x), dtype=bool)
    for j in range(k):
        same &= ids[x + j] == ids[y + j]
    if not same.all():  # two different windows with one hash: sort by the words themselves
        order = np.lexsort([ids[at + j] for j in range(k - 1, -1, -1)])
        near = np.ones(len(at) - 1, dtype=bool)
        for j in range(k):
            near &= ids[at[order[1:]] + j] == ids[at[order[:-1]] + j]
    return order, np.flatnonzero(np.concatenate(([True], ~near)))


def _count(k: int):
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.int64()), ("first", pa.int32()), ("end", pa.int32())])

    def run(table: pa.Table) -> pa.Table:
        length, raw, which, doc, digest, place, base = [], [], [], [], [], [], 0
        for blob in table["packed"]:
            n, r, u, d, g, p = _unpack(blob.as_py(), KINDS)
            length.append(n), raw.append(r), which.append(u + base), doc.append(d), digest.append(g), place.append(p)
            base += len(n)
        length, raw, which, doc, digest, place = map(np.concatenate, (length, raw, which, doc, digest, place))
        # words: exact ids by their bytes
        end = np.flatnonzero(raw == 0x20) + 1
        off = pa.py_buffer(np.concatenate(([0], end)).astype(np.int64).tobytes())
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(end), [None, off, pa.py_buffer(raw)])
        ids = words.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        del words
        stop = np.searchsorted(end, np.cumsum(length), side="right")  # words up to each super-k-mer's end
        n_windows = np.diff(np.concatenate(([0], stop))) - k + 1
        first_word = stop - n_windows - k + 1
        first_window = np.concatenate(([0], np.cumsum(n_windows)))
        of = np.repeat(np.arange(len(length)), n_windows)
        at = np.arange(first_window[-1]) - first_window[of] + first_word[of]
        order, begins = equal_windows(ids, at, k)
        least = np.full(len(length), np.iinfo(np.int64).max)
        np.minimum.at(least, which, doc)
        smallest = np.minimum.reduceat(least[of][order], begins)
        window_min = np.empty(len(at), dtype=np.int64)
        window_min[order] = np.repeat(smallest, np.diff(np.append(begins, len(at))))
        # places of super-k-mers with a window that is in a smaller document
        seen = np.minimum.reduceat(window_min, first_window[:-1])
        hit = np.flatnonzero(seen[which] < doc)
        which, doc, digest, place = which[hit], doc[hit], digest[hit], place[hit]
        n = n_windows[which]
        one = np.repeat(np.arange(len(which)), n)
        step = np.arange(len(one)) - np.repeat(np.cumsum(n) - n, n)
        flag = window_min[first_window[which][one] + step] < doc[one]
        flag_before = np.concatenate(([False], flag[:-1])) & (step > 0)
        flag_after = np.concatenate((flag[1:], [False])) & (np.concatenate((step[1:], [0])) > 0)
        a, b = np.flatnonzero(flag & ~flag_before), np.flatnonzero(flag & ~flag_after)
        return pa.Table.from_arrays([pa.array(doc[one[a]]), pa.array(digest[one[a]]),
                                     pa.array((place[one[a]] + step[a]).astype(np.int32)),
                                     pa.array((place[one[b]] + step[b] + k).astype(np.int32))], schema=schema)
    return run


def repeated_spans(docs: DataFrame, k: int = WINDOW, m: int = MINIMISER_WORDS,
                   bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, digest, first, end): word spans of windows that also start in a smaller document.
    ``docs`` has doc_id, text and digest (a bigint that tells rows with one doc_id apart). Spans of a document may overlap."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    n_buckets = max(16, math.ceil(total / bucket_bytes))
    sent = docs.select("doc_id", "digest", "text").mapInArrow(_send(n_buckets, k, m), "bucket bigint, packed binary")
    return sent.groupBy("bucket").applyInArrow(_count(k), "doc_id bigint, digest bigint, first int, end int")


def _cut(batches):
    for batch in batches:
        for a, b in slices(batch["text"], READ_BYTES):
            part = batch.slice(a, b - a)
            w = Words(*text_bytes(part["text"]))
            raw, first = w.data.tobytes(), w.first
            removed, kept_hash, kept_text = [], [], []
            for i, spans in enumerate(part["spans"]):
                x, y = int(first[i]), int(first[i + 1])
                if not spans.is_valid or not len(spans):
                    kept = raw[w.start[x]:max(w.start[x], w.start[y] - 1)] if y > x else b""
                    gone = 0
                else:
                    cover = np.zeros(y - x + 1, dtype=np.int32)
                    flat = spans.values.flatten()
                    np.add.at(cover, flat[0].to_numpy(), 1)
                    np.add.at(cover, flat[1].to_numpy(), -1)
                    gone_at = np.cumsum(cover[:-1]) > 0
                    gone = int(gone_at.sum())
                    edge = np.diff(np.concatenate(([True], gone_at, [True])).astype(np.int8))
                    begin, stop = np.flatnonzero(edge == -1) + x, np.flatnonzero(edge == 1) + x
                    kept = b"".join(raw[w.start[s]:w.start[e]] for s, e in zip(begin, stop))[:-1]
                removed.append(gone)
                kept_hash.append(hashlib.sha256(kept).hexdigest())
                kept_text.append(kept)
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], pa.array(w.count, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(kept_hash, pa.string()), pa.array(kept_text, pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, k: int = WINDOW, m: int = MINIMISER_WORDS,
                   bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) of each row: ``kept`` is the text without the words
    covered by a window of ``k`` words that also starts in a document with a smaller id."""
    d = small_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # the text's digest tells rows with one doc_id apart; it travels only where there are such rows
    repeats = d.groupBy("doc_id").count().filter("count > 1").limit(1).count()
    d = d.withColumn("digest", F.xxhash64("text") if repeats else F.lit(0).cast("bigint"))
    spans = (repeated_spans(d, k, m, bucket_bytes).groupBy("doc_id", "digest")
             .agg(F.collect_list(F.struct("first", "end")).alias("spans")))
    return (d.join(spans, ["doc_id", "digest"], "left").select("doc_id", "text", "spans")
            .mapInArrow(_cut, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept string"))
