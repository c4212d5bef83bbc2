"""N-gram Jaccard join by vertical partitioning, exact.

A document is its set of shingles (``WORDS`` consecutive words, A-Z lower-cased). Two documents link when
their sets' Jaccard similarity reaches 3/4, in integers ``7 * overlap >= 3 * (size + size)``.

1. Documents with equal sets are one class, found by a digest of the set; all else works on classes.
2. The global order of shingles puts those that many documents of some task share (``heavy``) last, by
   how often they were seen, and the others before them by their hash. Any order gives the same links;
   this one keeps common passages out of the prefixes.
3. Two classes can only link if they share a shingle within a prefix of their ordered sets, so only
   prefixes are shuffled. A shingle's list is never paired with itself as a whole: in each of ``STARS`` rounds
   its members meet ``HUBS`` of them, linked classes merge into components, and in the last round members
   of different components of a list are paired, all of them.
   A pair is a candidate where its sizes, what follows the shared shingle in both orders, 256 parity bits of both sets, and
   then a parity bit or two for each of their shingles leave room for enough overlap.
4. Overlaps of candidate pairs are counted by vertical partitioning: the order is cut into ``FRAGMENTS``,
   each fragment counts the partial overlaps of its part of the sets, and the sums per pair decide.
5. Components come from alternating large and small stars over the links.

Lists of heavy shingles are salted, so a near copy in a third of all rows doesn't fill one task.

Defined results: null and empty texts have no shingles and link with nothing, component their own id; a text
under ``WORDS`` words is one shingle; repeated rows are one class and each a row of the result; a class
whose ids are all null has a null component; further columns are ignored; an empty table gives no rows. Shingles are
63-bit hashes of their words, digests 128 bits.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .shared import drop_caches, materialize, small_batches
from .words import Words, mix, slices, text_bytes

WORDS = 5
READ_BYTES = 2 << 20
HEAVY_SEEN = 8
HEAVY_MOST = 200_000
FLUSH_SHINGLES = 2_000_000
SALTS = 64
STARS = 2
HUBS = 3
FRAGMENTS = 4
BLOCK_SHINGLES = 1_500_000
WANTED_BROADCAST = 1_000_000  # rows of three 64-bit numbers: 24 MB; more of them are joined by a shuffle
CLASHES = 10_000
PARITY = ("b0", "b1", "b2", "b3")
_TOP = np.uint64(1 << 63)


def shingle_sets(w: Words, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of all texts, sorted by (text, shingle), and the first of each text in them."""
    h = w.hashes()
    doc = w.doc()
    gram, at = w.ngrams(h, k)
    of = doc[at] if len(at) else at
    few = np.flatnonzero((w.count > 0) & (w.count < k))
    extra, extra_of = [], []
    for n in range(1, k):  # a short text as a whole is one shingle
        d = few[w.count[few] == n]
        total = np.full(len(d), n, dtype=np.uint64)
        for j in range(n):
            total = mix(total * np.uint64(0x9E3779B97F4A7C15) + h[w.first[d] + j])
        extra.append(total), extra_of.append(d)
    gram, of = np.concatenate([gram, *extra]) >> np.uint64(1), np.concatenate([of, *extra_of])
    order = np.argsort(gram)
    order = order[np.argsort(of[order].astype(np.int32), kind="stable")]
    gram, of = gram[order], of[order]
    if len(gram):
        new = np.concatenate(([True], (gram[1:] != gram[:-1]) | (of[1:] != of[:-1])))
        gram, of = gram[new], of[new]
    return gram, np.searchsorted(of, np.arange(len(w.count) + 1))


def digests(gram: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set, and of the set's size."""
    out = []
    n = np.diff(first).astype(np.uint64)
    for salt in (np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(gram ^ salt), dtype=np.uint64)))
        out.append(mix((total[first[1:]] - total[first[:-1]]) ^ (n * salt)).view(np.int64))
    return out[0], out[1]


def parities(gram: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Four 64-bit words for each set: whether an odd number of its shingles falls on each of 256 places. Two sets differ in at
    least as many shingles as these differ in bits."""
    place = (gram >> np.uint64(6)) & np.uint64(3)
    bit = np.uint64(1) << (gram & np.uint64(63))
    some = np.flatnonzero(np.diff(first))
    out = []
    for word in range(4):
        total = np.zeros(len(first) - 1, dtype=np.uint64)
        if len(some):
            total[some] = np.bitwise_xor.reduceat(np.where(place == word, bit, np.uint64(0)), first[some])
        out.append(total.view(np.int64))
    return out


def long_parities(gram: np.ndarray, first: np.ndarray) -> pa.ListArray:
    """The same in a bit or two for each shingle of a set: arrays of 64-bit words, a power of two of them."""
    n = np.diff(first)
    words = 2 ** np.ceil(np.log2(np.maximum(n, 64) / 64)).astype(np.int64)
    upto = np.concatenate(([0], np.cumsum(words)))
    of = np.repeat(np.arange(len(n)), n)
    place = gram & (words[of] * 64 - 1).astype(np.uint64)
    total = np.zeros(int(upto[-1]), dtype=np.uint64)
    np.bitwise_xor.at(total, upto[of] + (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
    return pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(total.view(np.int64)))


def _sets(batches):
    drop_caches()
    for batch in batches:
        for a, b in slices(batch["text"], READ_BYTES):
            part = batch.slice(a, b - a)
            gram, first = shingle_sets(Words(*text_bytes(part["text"]), lower=True))
            yield part, gram, first


def _classes(batches):
    """A row for each document, and (kind 1) rows of shingles that many classes of this task share."""
    names = ["kind", "doc_id", "digest", "n", "c1", "c2", *PARITY, "bits"]
    held, size, seen = [], 0, set()

    def heavy():
        gram, count = np.unique(np.concatenate(held), return_counts=True)
        much = count >= HEAVY_SEEN
        n = int(much.sum())
        return pa.RecordBatch.from_arrays([pa.array(np.ones(n, np.int32)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(count[much]),
                                           pa.array(gram[much].astype(np.int64)), *[pa.nulls(n, pa.int64())] * 5, pa.nulls(n, pa.list_(pa.int64()))], names)
    for part, gram, first in _sets(batches):
        n = np.diff(first)
        c1, c2 = digests(gram, first)
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n), np.int32)), part["doc_id"], part["digest"], pa.array(n), pa.array(c1),
                                          pa.array(c2), *map(pa.array, parities(gram, first)), long_parities(gram, first)], names)
        new = np.zeros(len(n), dtype=bool)
        for i, c in enumerate(c1.tolist()):
            if c not in seen:
                seen.add(c)
                new[i] = True
        held.append(gram[np.repeat(new, n)])
        size += len(held[-1])
        if size >= FLUSH_SHINGLES:
            yield heavy()
            held, size, seen = [], 0, set()
    if size:
        yield heavy()


def ordered(gram: np.ndarray, first: np.ndarray, heavy: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The sets' shingles as keys of the global order, sorted within each set: a shingle that isn't heavy is its hash,
    a heavy one its rank above all hashes. ``heavy`` is sorted and ``rank`` goes with it."""
    key = gram
    if len(heavy):
        at = np.minimum(np.searchsorted(heavy, gram), len(heavy) - 1)
        is_heavy = heavy[at] == gram
        key = np.where(is_heavy, rank[at] | _TOP, gram)
        of = np.repeat(np.arange(len(first) - 1, dtype=np.int32), np.diff(first))
        # hashes are sorted already: a stable sort brings each set's heavy shingles to its end, in their order
        order = np.lexsort((np.where(is_heavy, rank[at], 0), is_heavy, of)) if is_heavy.any() else None
        key = key if order is None else key[order]
    return key


def probe_prefix(n):
    """Shingles of a set of ``n`` of which one is shared with any set it links with."""
    return n - (3 * n + 3) // 4 + 1


def index_prefix(n):
    """The same for sets it links with that aren't smaller."""
    return n - (6 * n + 6) // 7 + 1


def _postings(heavy: np.ndarray, rank: np.ndarray, clash: np.ndarray):
    def run(batches):
        for _, gram, first in _sets(batches):
            n = np.diff(first)
            c1, c2 = digests(gram, first)
            c1 = np.where(np.isin(c1, clash), c2, c1)
            _, one = np.unique(c1, return_index=True)
            live = np.zeros(len(n), dtype=bool)
            live[one] = True
            live &= n > 0
            key = ordered(gram, first, heavy, rank)
            of = np.repeat(np.arange(len(n)), n)
            pos = np.arange(len(key)) - first[of]
            keep = live[of] & (pos < probe_prefix(n)[of])
            key, of, pos = key[keep], of[keep], pos[keep]
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(c1[of]),
                                              pa.array(n[of] << 32 | pos)], ["t", "c", "np"])
    return run


POSTING = "t bigint, c bigint, np bigint"


def _shared(batches):
    """Postings, in order of (t, c), whose shingle has another class too; equal postings once. A heavy
    shingle is known to, and its list may go on in another partition."""
    last, last_same = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch[x].to_numpy() for x in ("t", "c", "np")]
        if last is not None:
            cols = [np.concatenate(x) for x in zip(last, cols)]
        t, c, _ = cols
        once = np.concatenate(([True], (t[1:] != t[:-1]) | (c[1:] != c[:-1])))
        cols = [x[once] for x in cols]
        t = cols[0]
        same = t[1:] == t[:-1]
        before = np.concatenate(([last_same], same))
        keep = np.flatnonzero(((t < 0) | before | np.append(same, False))[:-1])
        if len(keep):
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in cols], ["t", "c", "np"])
        last, last_same = [x[-1:] for x in cols], bool(before[-1])
    if last is not None and (last_same or last[0][0] < 0):
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in last], ["t", "c", "np"])


def _fragments(heavy: np.ndarray, rank: np.ndarray):
    """The ordered set of each class in its fragments: equal ranges of the hashes, and the heavy shingles."""
    edges = np.array([(i << 63) // (FRAGMENTS - 1) for i in range(1, FRAGMENTS)], dtype=np.uint64)

    def run(batches):
        for part, gram, first in _sets(batches):
            key = ordered(gram, first, heavy, rank)
            fragment = np.searchsorted(edges, key, side="right")
            of = np.repeat(np.arange(len(first) - 1), np.diff(first))
            cut = np.searchsorted(of * FRAGMENTS + fragment, np.arange((len(first) - 1) * FRAGMENTS + 1))
            raw = key.tobytes()
            has = np.flatnonzero(np.diff(cut))
            c = part["c"].to_numpy()[has // FRAGMENTS]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c), pa.array((has % FRAGMENTS).astype(np.int32)),
                 pa.array([raw[8 * x:8 * y] for x, y in zip(cut[has].tolist(), cut[has + 1].tolist())], pa.binary())],
                ["c", "fragment", "keys"])
    return run


PARTIAL = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("overlap", pa.int64())])
STEP = 2_000_000


def _overlaps(key, pairs: pa.Table, sets: pa.Table) -> pa.Table:
    """Shingles that the members of each pair of a block share: the partial overlaps of the fragments, counted one after the other, and summed."""
    total = np.zeros(pairs.num_rows, dtype=np.int64)
    ab = [pairs["a"].to_numpy(), pairs["b"].to_numpy()]
    for fragment in range(FRAGMENTS):
        total += _partial(ab, sets.filter(pc.equal(sets["fragment"], fragment)))
    some = total > 0
    return pa.table([pa.array(ab[0][some]), pa.array(ab[1][some]), pa.array(total[some])], schema=PARTIAL)


def _partial(ab: list[np.ndarray], sets: pa.Table) -> np.ndarray:
    """Partial overlap of each pair, from the members' sets in one fragment."""
    n_pairs = len(ab[0])
    if not n_pairs or not sets.num_rows:
        return np.zeros(n_pairs, dtype=np.int64)
    c, one = np.unique(sets["c"].to_numpy(), return_index=True)
    data, off = text_bytes(sets["keys"].combine_chunks().take(pa.array(one)))
    keys, off = data.view(np.uint64) if len(data) % 8 == 0 else data[:0], off // 8
    size = np.diff(off)
    at = [np.minimum(np.searchsorted(c, x), len(c) - 1) for x in ab]
    both = (c[at[0]] == ab[0]) & (c[at[1]] == ab[1])
    at = [x[both] for x in at]
    shared = np.zeros(len(at[0]), dtype=np.int64)
    upto = np.concatenate(([0], np.cumsum(size[at[0]] + size[at[1]])))
    x = 0
    while x < len(shared):
        y = max(x + 1, int(np.searchsorted(upto, upto[x] + STEP, side="right")) - 1)
        value, of = [], []
        for side in at:
            n = size[side[x:y]]
            of.append(np.repeat(np.arange(y - x, dtype=np.int32), n))
            value.append(keys[np.repeat(off[side[x:y]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))])
        value, of = np.concatenate(value), np.concatenate(of)
        order = np.argsort(value)
        order = order[np.argsort(of[order], kind="stable")]
        value, of = value[order], of[order]
        twice = (value[1:] == value[:-1]) & (of[1:] == of[:-1])
        shared[x:y] = np.bincount(of[1:][twice], minlength=y - x)
        x = y
    out = np.zeros(n_pairs, dtype=np.int64)
    out[both] = shared
    return out


def plausible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b, total) whose long parity bits leave room for enough overlap; the longer array is folded to the other."""
    x, y = (classes.select(F.col("c").alias(s), F.col("bits").alias(f"{s}bits")) for s in "ab")
    p = pairs.join(x, "a").join(y, "b").withColumn("least", F.least(F.size("abits"), F.size("bbits")))

    def word(s: str, i: Column) -> Column:
        own = F.get(f"{s}bits", i)
        return F.when(F.size(f"{s}bits") > F.col("least"), own.bitwiseXOR(F.get(f"{s}bits", i + F.col("least")))).otherwise(own)
    bits = F.transform(F.sequence(F.lit(0), F.col("least") - 1), lambda i: F.bit_count(word("a", i).bitwiseXOR(word("b", i))))
    differ = F.aggregate(bits, F.lit(0), lambda total, n: total + n)
    return p.filter(7 * differ <= F.col("total")).select("a", "b", "total")


def in_pairs(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The classes that are in a pair, found where they are if the pairs are few enough to send; else all."""
    if 2 * pairs.count() > WANTED_BROADCAST:
        return classes
    ids = pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct()
    return classes.join(F.broadcast(ids), "c", "left_semi")


def pair_sets(d: DataFrame, classes: DataFrame, pairs: DataFrame, n_pairs: int, heavy: np.ndarray, rank: np.ndarray) -> DataFrame:
    """(c, fragment, keys) of the classes in ``pairs``, from the text of one document of each."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct().join(classes, "c")
    wanted = wanted.select("c", F.col("one.doc_id").alias("i"), F.col("one.digest").alias("g"))
    if 2 * n_pairs <= WANTED_BROADCAST:
        wanted = F.broadcast(wanted)
    texts = d.join(wanted, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("digest") == F.col("g"))).select("c", "text")
    return texts.mapInArrow(_fragments(heavy, rank), "c bigint, fragment int, keys binary")


def links(pairs: DataFrame, n_shingles: int, sets: DataFrame) -> DataFrame:
    """(u, v) of the candidate pairs (a, b, total) that link; ``total`` is the sum of their sizes, ``n_shingles`` of all totals."""
    blocks = max(1, math.ceil(n_shingles / BLOCK_SHINGLES))
    # A class with more pairs than a block holds is cut into as many parts as its pairs need.
    most = pairs.groupBy("a").agg(F.sum("total").alias("n")).agg(F.max("n")).head()[0]
    parts = max(1, math.ceil(most / BLOCK_SHINGLES))
    p = pairs.withColumn("block", F.pmod(F.xxhash64("a", F.pmod(F.xxhash64("b"), F.lit(parts))), F.lit(blocks)).cast("int"))
    need = p.select(F.col("block").alias("to_block"), F.explode(F.array("a", "b")).alias("c")).distinct()
    left = p.select("block", "a", "b").groupBy("block")
    right = need.join(sets, "c").groupBy("to_block")
    total = left.cogroup(right).applyInArrow(_overlaps, "a bigint, b bigint, overlap bigint")
    return (total.join(pairs, ["a", "b"]).filter(7 * F.col("overlap") >= 3 * F.col("total"))
            .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(u, v): the smallest node ``v`` of the component of each node ``u`` but that one, from edges u > v, by alternating
    large stars and small stars until every edge ends in a root. Every round is written to the shared folder."""
    e = materialize(edges.distinct(), "components")
    while True:
        roots = e.select(F.col("v").alias("u")).distinct()
        inner = e.join(roots, "u", "left_semi").limit(1).count()
        several = 0 if inner else e.groupBy("u").count().filter("count > 1").limit(1).count()
        if not inner and not several:
            return e
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        e = (e.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
             .unionAll(least.select("u", F.col("m").alias("v"))).distinct())
        e = materialize(e, "components")


def _may_link(n1: Column, p1: Column, n2: Column, p2: Column) -> Column:
    """Whether sets that share the shingles at these places can overlap enough: by sizes, and by what follows there."""
    return ((4 * n1 >= 3 * n2) & (4 * n2 >= 3 * n1)
            & (7 * F.least(n1 - p1, n2 - p2) >= 3 * (n1 + n2)))


def _pairs(x: str, y: str) -> list[Column]:
    c = lambda s, f: F.col(f"{s}{f}")
    return [F.least(c(x, "c"), c(y, "c")).alias("a"), F.greatest(c(x, "c"), c(y, "c")).alias("b"),
            (c(x, "n") + c(y, "n")).alias("total")]


MEMBER = ("c", "n", "pos", "comp", *PARITY)


def _named(lists: DataFrame, s: str) -> DataFrame:
    return lists.select("t", *[F.col(f).alias(f"{s}{f}") for f in MEMBER])


def _cond(x: str, y: str) -> Column:
    differ = sum((F.bit_count(F.col(f"{x}{b}").bitwiseXOR(F.col(f"{y}{b}"))) for b in PARITY), F.lit(0))
    return (7 * differ <= F.col(f"{x}n") + F.col(f"{y}n")) & (F.col(f"{x}comp") != F.col(f"{y}comp")) & _may_link(F.col(f"{x}n"), F.col(f"{x}pos"), F.col(f"{y}n"), F.col(f"{y}pos"))


def star_pairs(lists: DataFrame, seed: int) -> DataFrame:
    """Every class of a list with the list's hubs, where they are in different components and may link. The hubs change with the
    seed, so a class that is too far from one copy of its text meets others in the next round.

    A list is sorted by hashes of its classes, so its hubs come first and the others meet them as they stream by. Heavy lists, which go on in
    several partitions, get their hubs by an aggregate."""
    order = F.xxhash64("c", F.lit(HUBS * seed))
    light = lists.filter("t >= 0").select("t", *MEMBER).repartition("t").sortWithinPartitions("t", order, "c")
    return light.mapInArrow(_star_pairs, PAIR).unionAll(_heavy_star_pairs(lists.filter("t < 0"), seed)).distinct()


PAIR = "a bigint, b bigint, total bigint"


def _star_pairs(batches):
    """Pairs of each row with the first ``HUBS`` rows of its list; the rows come list by list."""
    hubs = None  # of the list that was open at the end of the last batch: its first rows, and how many there are
    for batch in batches:
        if not batch.num_rows:
            continue
        new = [batch[x].to_numpy(zero_copy_only=False) for x in ("t", *MEMBER)]
        cols = new if hubs is None else [np.concatenate((h, x)) for h, x in zip(hubs, new)]
        t = cols[0]
        begin = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
        size = np.diff(np.append(begin, len(t)))
        place = np.arange(len(t)) - np.repeat(begin, size)
        fresh = np.arange(len(t)) >= len(t) - len(new[0])  # a hub kept from before has met the other ones
        col = dict(zip(("t", *MEMBER), cols))
        for i in range(HUBS):
            x = np.flatnonzero(fresh & (place > i))
            h = np.repeat(begin, size)[x] + i
            x, h = _linkable(col, x, h)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(col["c"][x], col["c"][h])), pa.array(np.maximum(col["c"][x], col["c"][h])),
                                              pa.array(col["n"][x] + col["n"][h])], ["a", "b", "total"])
        keep = slice(begin[-1], begin[-1] + HUBS)
        hubs = [x[keep] for x in cols]


def _linkable(col: dict[str, np.ndarray], x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows that ``_cond`` keeps."""
    n1, n2, p1, p2 = col["n"][x], col["n"][h], col["pos"][x], col["pos"][h]
    ok = (4 * n1 >= 3 * n2) & (4 * n2 >= 3 * n1) & (7 * np.minimum(n1 - p1, n2 - p2) >= 3 * (n1 + n2)) & (col["comp"][x] != col["comp"][h])
    x, h = x[ok], h[ok]
    differ = sum(np.bitwise_count((col[b][x] ^ col[b][h]).view(np.uint64)).astype(np.int64) for b in PARITY)
    ok = 7 * differ <= col["n"][x] + col["n"][h]
    return x[ok], h[ok]


def _heavy_star_pairs(lists: DataFrame, seed: int) -> DataFrame:
    member = F.struct(*MEMBER)
    hubs = lists.groupBy("t").agg(*[F.min_by(member, F.xxhash64("c", F.lit(HUBS * seed + i))).alias(f"hub{i}") for i in range(HUBS)])
    hub = hubs.select("t", F.explode(F.array_distinct(F.array(*[f"hub{i}" for i in range(HUBS)]))).alias("hub"))
    hub = hub.select("t", *[F.col(f"hub.{f}").alias(f"h{f}") for f in MEMBER])
    return _named(lists, "x").join(hub, "t").filter(_cond("x", "h")).select(*_pairs("x", "h"))


def cross_pairs(lists: DataFrame) -> DataFrame:
    """All pairs of classes of a list that are in different components and may link. A list's largest component is
    paired with the others, never with itself."""
    sizes = lists.groupBy("t", "comp").count()
    major = sizes.groupBy("t").agg(F.max(F.struct("count", "comp"))["comp"].alias("major"), F.count("*").alias("parts"))
    mixed = lists.join(major.filter("parts > 1"), "t")
    y = _named(mixed, "y")
    x = _named(mixed.filter("comp != major"), "x").join(major.select("t", "major"), "t")
    once = (F.col("ycomp") == F.col("major")) | (F.col("xc") < F.col("yc"))
    return x.join(y, "t").filter(once & _cond("x", "y")).select(*_pairs("x", "y")).distinct()


def link_documents(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_shingles, component_id) of each row: the size of its set, and the smallest id that links reach."""
    d = small_batches(docs).select(F.col(key).cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("digest", F.xxhash64("text"))
    seen = materialize(_with_digest(d), "jaccard-sets")
    rows = seen.filter("kind = 0")
    heavy = (seen.filter("kind = 1").groupBy(F.col("c1").alias("t")).agg(F.sum("n").alias("n"))
             .orderBy(F.desc("n"), "t").limit(HEAVY_MOST).toArrow())
    t, n = heavy["t"].to_numpy().view(np.uint64), heavy["n"].to_numpy()
    rank = np.empty(len(t), dtype=np.uint64)
    rank[np.lexsort((t, n))] = np.arange(len(t), dtype=np.uint64)
    order = np.argsort(t)
    t, rank = t[order], rank[order]

    # A class is known by the first half of its digest; where different sets share that (a few among 1e11), by the second.
    clash = np.sort(rows.groupBy("c1").agg(F.min("c2").alias("x"), F.max("c2").alias("y")).filter("x != y").select("c1")
                    .limit(CLASHES + 1).toArrow()["c1"].to_numpy())
    if len(clash) > CLASHES:
        raise ValueError(f"more than {CLASHES} halves of digests are shared")
    if len(clash):
        rows = rows.withColumn("c1", F.when(F.col("c1").isin(clash.tolist()), F.col("c2")).otherwise(F.col("c1")))
    classes = materialize(rows.groupBy(F.col("c1").alias("c")).agg(
        F.min("doc_id").alias("least"), F.max(F.struct("doc_id", "digest")).alias("one"), *[F.min(b).alias(b) for b in PARITY], F.min("bits").alias("bits"),
        F.min("c2").alias("x"), F.max("c2").alias("y")), "jaccard-classes")
    if len(clash) and classes.filter("x != y").limit(1).count():
        raise ValueError("two different shingle sets share their digest's halves crosswise")

    salt = F.when(F.col("t") < 0, F.pmod("c", F.lit(SALTS))).otherwise(F.lit(0))
    postings = d.select("text").mapInArrow(_postings(t, rank, clash), POSTING)
    lists = postings.repartition(F.col("t"), salt).sortWithinPartitions("t", "c").mapInArrow(_shared, POSTING)
    lists = lists.select("t", "c", F.shiftright("np", 32).alias("n"), F.col("np").bitwiseAND(0xFFFFFFFF).alias("pos"))
    lists = materialize(lists.join(classes.select("c", *PARITY), "c"), "jaccard-lists")
    stars = None
    for turn in range(STARS + 1):
        if stars is None:
            now = lists.withColumn("comp", F.col("c"))
        else:
            of = stars.select(F.col("u").alias("c"), F.col("v").alias("m"))
            now = lists.join(of, "c", "left").withColumn("comp", F.coalesce("m", "c")).drop("m")
        found = materialize(star_pairs(now, turn) if turn < STARS else cross_pairs(now), "jaccard-candidates")
        pairs = materialize(plausible(found, in_pairs(found, classes)), "jaccard-pairs")
        n_pairs, n_shingles = pairs.agg(F.count("*"), F.sum("total")).head()
        if n_pairs:
            edges = links(pairs, n_shingles, pair_sets(d, classes, pairs, n_pairs, t, rank))
            stars = components(edges if stars is None else stars.unionAll(edges))
    if stars is None:
        stars = lists.select(F.col("c").alias("u"), F.col("c").alias("v")).limit(0)

    of = stars.select(F.col("u").alias("c"), F.col("v").alias("m"))
    named = classes.join(of, "c", "left").select("c", "least", F.coalesce("m", "c").alias("comp"))
    least = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    ids = named.join(least, "comp").select(F.col("c").alias("c1"), "component_id")
    return rows.join(ids, "c1").select("doc_id", F.col("n").alias("n_shingles"),
                                       F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _with_digest(d: DataFrame) -> DataFrame:
    return d.mapInArrow(_classes, "kind int, doc_id bigint, digest bigint, n bigint, c1 bigint, c2 bigint, "
                          + ", ".join(f"{b} bigint" for b in PARITY) + ", bits array<bigint>")
