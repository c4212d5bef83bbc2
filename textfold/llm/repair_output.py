"""Token-ID output as Re-Pair grammars with random-access decoding.

Documents are sorted by ``doc_id`` into ranges; a range's task encodes its texts, appends the end id to each
and cuts them into shards of about ``SHARD_IDS`` ids. In a shard, frequent adjacent pairs of symbols are
replaced by nonterminals, the most frequent first: each round replaces the pairs above a count that falls
from round to round and then stays until a round gains little, and where two of them overlap the more frequent one. A pair never spans two documents.

A shard is one row of a Parquet table written into the shared folder: its place (``part``, ``shard``), its
documents' range, the ids before it in its part, and ``payload``, the grammar: document ids, ids and
symbols of each document, rules as pairs of symbols, the symbols in planes of 16 and then single bits, and
the rules' expansion lengths. ``decode_documents`` expands any run of a shard's documents and only these;
``read_ids`` decodes all.

Encoding: the tokenizer's own model encodes every distinct piece between white space once per task memory
(its memo is bounded); texts are lower-cased and cut by the tokenizer's published rule. Pieces beyond
U+024F, or with control characters or a special token's beginning, go through the whole tokenizer as they are.

Defined results: null text is empty and holds the end id alone; null ``doc_id`` sorts first; rows with one
``doc_id`` follow each other in the order of their text; further columns are ignored; an empty table
writes no shard and reads as no rows; a document larger than a shard is a shard of its own.
"""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from .shared import scratch, small_batches, worker_cache
from .words import slices

SHARD_IDS = 1 << 20
ENCODE_BYTES = 8 << 20
MEMO_ENTRIES = 500_000
END_ID = 1
LEAST_COUNT = 16
LARGEST_SHARE = 1 / 1000
FALL = 8
LEAST_GAIN = 0.02

_encoders: dict[tuple, "PieceEncoder"] = worker_cache()


class PieceEncoder:
    """Ids of texts by a lower-casing byte-level BPE with word ends, piece by piece."""

    # what the fast way leaves to the whole tokenizer: controls, beyond Latin Extended-B, dotted capital I
    OTHER = re.compile("[^\t-\r -~¡-įı-ɏ]|<\\|")
    PIECE = re.compile(r"[^\t-\r ]+")
    MARK_RUN = r"([^\s\pL\pN]+)"
    MARKS = ".,;:!?*#$%&()-_\"/"  # a run of these after a word is a token of its own

    def __init__(self, path: str, end_id: int):
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.cut = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        # byte-level characters: printable bytes stand for themselves, the others for 256 and up in order
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [b for b in range(256) if b not in set(plain)]
        self.bytes_as = {b: chr(256 + i) for i, b in enumerate(others)}
        self.end_id = end_id
        self.forget()

    def forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.pool, self.begin = array("i", [self.end_id]), array("q", [0])

    def _remember(self, piece: str, ids) -> int:
        at = self.memo[piece] = len(self.begin)
        self.begin.append(len(self.pool))
        self.pool.extend(ids)
        return at

    def _of_token(self, token: str) -> int:
        """The place of a piece that the tokenizer's rule doesn't cut."""
        at = self.memo.get(token)
        if at is not None:
            return at
        form = token if token.isascii() else token.encode().decode("latin-1").translate(self.bytes_as)
        return self._remember(token, [t.id for t in self.whole.model.tokenize(form)])

    def _learn(self, piece: str) -> int:
        word = piece.rstrip(self.MARKS)
        if word.isalpha():
            tokens = [word, piece[len(word):]] if len(word) < len(piece) else [piece]
        elif piece[0] == "\0":
            return self._remember(piece, self.whole.encode(piece[1:], add_special_tokens=False).ids)
        else:
            tokens = self.cut(piece)
        if tokens == [piece]:
            return self._of_token(piece)
        ids = array("i")
        for at in map(self._of_token, tokens):
            ids.extend(self.pool[self.begin[at]:self.begin[at + 1] if at + 1 < len(self.begin) else len(self.pool)])
        return self._remember(piece, ids)

    def pieces(self, col: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Lower-cased pieces of all texts, and how many each has. Texts with characters that aren't left to the fast way are cut
        here, and their pieces with such characters stay as they are, marked by a NUL."""
        other = pc.match_substring_regex(col, self.OTHER.pattern)
        lower = pc.utf8_lower(col)
        # the rule cuts before and after a run of marks anyway; with apostrophes it may not
        lower = pc.if_else(pc.match_substring(lower, "'"), lower, pc.replace_substring_regex(lower, self.MARK_RUN, r" \1 "))
        if pc.any(other).as_py():
            cut = ["\n".join("\0" + p if self.OTHER.search(p) else p.lower() for p in self.PIECE.findall(t))
                   for t in col.filter(other).to_pylist()]
            lower = pc.replace_with_mask(lower, other, pa.array(cut, lower.type))
        lower = pc.ascii_trim_whitespace(lower)
        some = pc.not_equal(lower, "").to_numpy(zero_copy_only=False)
        parts = pc.ascii_split_whitespace(lower.filter(pa.array(some)))
        count = np.zeros(len(col), dtype=np.int64)
        count[some] = pc.list_value_length(parts).to_numpy()
        return parts.flatten(), count

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts with the end id after each, and the number of ids of each."""
        flat, count = self.pieces(col)
        coded = flat.dictionary_encode()
        pieces = coded.dictionary.to_pylist()
        if len(self.memo) > MEMO_ENTRIES:
            self.forget()
        place = list(map(self.memo.get, pieces))
        for i, at in enumerate(place):
            if at is None:
                place[i] = self._learn(pieces[i])
        which = np.array(place, dtype=np.int64)[coded.indices.to_numpy()] if place else np.zeros(0, np.int64)
        which = np.insert(which, np.cumsum(count), END)  # the end id after each text
        known = pa.ListArray.from_arrays(pa.array(np.append(self.begin, len(self.pool)).astype(np.int32)),
                                         pa.array(np.array(self.pool)))
        lists = known.take(pa.array(which))
        upto = np.concatenate(([0], np.cumsum(count + 1)))
        return lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy()[upto])


END = 0  # place of the end id among the remembered pieces


def encoder(path: str, end_id: int) -> PieceEncoder:
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = PieceEncoder(path, end_id)
    return _encoders[path, end_id]


def _winners(at: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Which of the places ``at`` are replaced in a round, so that no two of them share a symbol: those whose pair ranks before the pairs that
    overlap it. Of a run of one symbol, whose pairs are equal and overlap each other, every second place from the left."""
    r = place[at + 1]
    begins = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1] + 1) | (r[1:] != r[:-1]))))
    size = np.diff(np.concatenate((begins, [len(at)])))
    ends = begins + size - 1
    left = place[at[begins]] < r[begins]  # the pair that begins one symbol before ranks better: leave the first place
    right = np.append(place, len(place))[at[ends] + 2] < r[ends]
    offset = np.arange(len(at)) - np.repeat(begins, size) - np.repeat(left, size)
    return (offset >= 0) & (offset % 2 == 0) & (np.arange(len(at)) <= np.repeat(ends - right, size))


def compress(ids: np.ndarray, doc_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair of a shard: symbols, symbols of each document, rules (pairs), expansion length of each rule.
    Symbols from ``max(ids) + 1`` on are the rules."""
    seq = ids.astype(np.uint64)
    first_rule = int(ids.max()) + 1 if len(ids) else 0
    stops = np.zeros(len(seq), dtype=bool)
    stops[np.cumsum(doc_sizes) - 1] = True
    rules, lengths, n_rules = [], [np.ones(0, np.int64)], 0
    floor = max(LEAST_COUNT, int(len(ids) * LARGEST_SHARE))
    while len(seq) > 1:
        a, b, before = seq[:-1], seq[1:], len(seq)
        # candidates: pairs in a count bucket that reaches the floor; then exact counts of these alone
        h = ((a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(44)).astype(np.int64)
        open_ = ~stops[:-1]
        bucket = np.bincount(h[open_], minlength=1 << 20)
        at = np.flatnonzero(open_ & (bucket >= floor)[h])
        pair, inverse, count = np.unique(a[at] << np.uint64(32) | b[at], return_inverse=True, return_counts=True)
        frequent = count >= floor
        if frequent.any():
            order = np.lexsort((pair, -count))
            rank = np.empty(len(pair), dtype=np.int64)
            rank[order] = np.arange(len(pair))
            keep = frequent[inverse]
            at, which = at[keep], inverse[keep]
            place = np.full(len(seq) + 1, len(pair), dtype=np.int64)  # rank of the pair that begins there
            place[at + 1] = rank[which]
            wins = _winners(at, place)
            at, which = at[wins], which[wins]
            used = np.unique(which)
            number = np.zeros(len(pair), dtype=np.uint64)
            number[used] = np.arange(len(used), dtype=np.uint64) + np.uint64(first_rule + n_rules)
            new = np.stack((pair[used] >> np.uint64(32), pair[used] & np.uint64(0xFFFFFFFF)), axis=1).astype(np.int64)
            known = np.concatenate(lengths)
            size = [np.where(new[:, k] >= first_rule, known[np.maximum(new[:, k] - first_rule, 0)] if len(known) else 1, 1)
                    for k in (0, 1)]
            rules.append(new)
            lengths.append(size[0] + size[1])
            n_rules += len(used)
            seq[at] = number[which]
            stops[at] = stops[at + 1]
            live = np.ones(len(seq), dtype=bool)
            live[at + 1] = False
            seq, stops = seq[live], stops[live]
        if floor == LEAST_COUNT and before - len(seq) <= LEAST_GAIN * before:
            break
        floor = max(LEAST_COUNT, floor // FALL)
    sizes = np.diff(np.concatenate(([-1], np.flatnonzero(stops))))
    pairs = np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)
    return seq.astype(np.int64), sizes, pairs, np.concatenate(lengths)


# Fixed values of the payload: a magic number, then eight sizes, all little-endian 64-bit
MAGIC = 0x3152_4941_5052_4750


def pack(doc_ids: np.ndarray, null_ids: np.ndarray, doc_sizes: np.ndarray, ids: np.ndarray) -> bytes:
    symbols, sizes, pairs, lengths = compress(ids, doc_sizes)
    first_rule = int(ids.max()) + 1
    bits = max(16, int(symbols.max()).bit_length())
    head = np.array([MAGIC, len(doc_ids), len(symbols), len(pairs), first_rule, bits, len(ids), 0, 0], np.int64)
    planes = [np.packbits((symbols >> k & 1).astype(np.uint8)) for k in range(16, bits)]
    return b"".join(p.tobytes() for p in [head, doc_ids.astype(np.int64), null_ids.astype(np.uint8), doc_sizes.astype(np.int64),
                                          sizes.astype(np.int64), pairs.astype(np.int32), lengths.astype(np.int32),
                                          (symbols & 0xFFFF).astype(np.uint16), *planes])


class Shard:
    """A payload opened for decoding."""

    def __init__(self, payload: bytes):
        head = np.frombuffer(payload, np.int64, 9)
        if head[0] != MAGIC:
            raise ValueError("not a Re-Pair shard")
        _, docs, n, rules, self.first_rule, bits, self.n_ids, _, _ = map(int, head)
        at = 72

        def take(kind, count):
            nonlocal at
            out = np.frombuffer(payload, kind, count, at)
            at += out.nbytes
            return out
        self.doc_ids, self.null_ids = take(np.int64, docs), take(np.uint8, docs).astype(bool)
        self.doc_sizes, self.symbol_counts = take(np.int64, docs), take(np.int64, docs)
        self.pairs = take(np.int32, 2 * rules).reshape(-1, 2)
        self.lengths = take(np.int32, rules)
        self.symbols = take(np.uint16, n).astype(np.int32)
        for k in range(16, bits):
            self.symbols |= np.unpackbits(take(np.uint8, (n + 7) // 8), count=n).astype(np.int32) << k

    def _needed(self, symbols: np.ndarray) -> np.ndarray:
        """The rules that symbols are made of, in order: a rule's parts come before it."""
        first, needed = self.first_rule, np.zeros(len(self.pairs), dtype=bool)
        new = np.unique(symbols[symbols >= first]) - first
        while len(new):
            needed[new] = True
            parts = np.unique(self.pairs[new])
            parts = parts[parts >= first] - first
            new = parts[~needed[parts]]
        return np.flatnonzero(needed)

    def _expanded(self, rules: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """These rules written out, one after the other, and where each begins."""
        size = self.lengths.astype(np.int64)
        end = np.cumsum(size[rules])
        begin = np.zeros(len(self.pairs), dtype=np.int64)
        begin[rules] = end - size[rules]
        pool = np.empty(int(end[-1]) if len(end) else 0, dtype=np.int32)
        at_of, size_of, first = begin.tolist(), size.tolist(), self.first_rule
        for i, pair in zip(rules.tolist(), self.pairs[rules].tolist()):
            at = at_of[i]
            for s in pair:
                if s < first:
                    pool[at] = s
                    at += 1
                else:
                    x, n = at_of[s - first], size_of[s - first]
                    pool[at:at + n] = pool[x:x + n]
                    at += n
        return pool, begin

    def decode_documents(self, first: int, last: int) -> np.ndarray:
        """The ids of documents ``first`` to ``last - 1`` of the shard, from their symbols and the rules these need."""
        upto = np.concatenate(([0], np.cumsum(self.symbol_counts)))
        s = self.symbols[upto[first]:upto[last]]
        rule = s >= self.first_rule
        which = np.where(rule, s - self.first_rule, 0)
        if not rule.any():
            return s.copy()
        pool, begin = self._expanded(self._needed(s))
        n = np.where(rule, self.lengths[which], 1).astype(np.int64)
        out = np.repeat(s, n)
        at = np.arange(len(out)) - np.repeat(np.cumsum(n) - n, n)
        inner = np.repeat(rule, n)
        out[inner] = pool[(np.repeat(begin[which], n) + at)[inner]]
        return out


FILE_SCHEMA = ("part int, shard int, first_doc bigint, last_doc bigint, n_docs bigint, n_ids bigint, start_in_part bigint, "
               "payload binary")


def _encode_part(path: str, end_id: int, shard_ids: int):
    from pyspark import TaskContext

    names = [f.split()[0] for f in FILE_SCHEMA.split(", ")]

    def run(batches):
        enc, part = encoder(path, end_id), TaskContext.get().partitionId()
        held, n_held, shard, start = [], 0, 0, 0

        def flush():
            nonlocal held, n_held, shard, start
            keys, null, sizes, ids = (np.concatenate(x) for x in zip(*held))
            row = [part, shard, None if null[0] else int(keys[0]), None if null[-1] else int(keys[-1]), len(keys), len(ids),
                   start, pack(keys, null, sizes, ids)]
            held, n_held, shard, start = [], 0, shard + 1, start + len(ids)
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names)
        for batch in batches:
            null = batch["doc_id"].is_null().to_numpy(zero_copy_only=False)
            keys = batch["doc_id"].fill_null(0).to_numpy()
            for a, b in slices(batch["text"], ENCODE_BYTES):
                ids, sizes = enc.encode(batch["text"].slice(a, b - a))
                end = np.cumsum(sizes)
                x = 0
                while x < b - a:  # cut into shards
                    done = end[x - 1] if x else 0
                    y = max(x + 1, int(np.searchsorted(end, done + shard_ids - n_held, side="right")))
                    held.append((keys[a + x:a + y], null[a + x:a + y], sizes[x:y], ids[done:end[y - 1]]))
                    n_held += int(end[y - 1] - done)
                    x = y
                    if n_held >= shard_ids or x < b - a:
                        yield flush()
        if held:
            yield flush()
    return run


def write_ids(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS,
              parts: int | None = None) -> None:
    """Encode ``docs`` (doc_id, text) and write the shards to the Parquet folder ``path`` in doc_id order."""
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = small_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    d.mapInArrow(_encode_part(tokenizer_path, end_id, shard_ids), FILE_SCHEMA).write.parquet(path)


def _decode(batches):
    for batch in batches:
        for payload, start in zip(batch["payload"], batch["start"]):
            s = Shard(payload.as_py())
            ids = s.decode_documents(0, len(s.doc_ids))
            end = np.cumsum(s.doc_sizes)
            begin, raw = end - s.doc_sizes, memoryview(ids.astype("<u4").view(np.uint8))
            crc = [zlib.crc32(raw[4 * x:4 * y]) for x, y in zip(begin.tolist(), end.tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(s.doc_ids, mask=s.null_ids), pa.array(begin + start.as_py()), pa.array(s.doc_sizes),
                 pa.array(crc, pa.int64()), pa.array(s.symbol_counts)],
                ["doc_id", "start", "n_tokens", "ids_crc32", "n_symbols"])


def shard_starts(spark, path: str) -> DataFrame:
    """The shards with ``start``, the ids of all documents before them. Sums by part go through the window."""
    shards = spark.read.schema(FILE_SCHEMA).parquet(path)
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    return shards.join(parts, "part").withColumn("start", F.col("before") + F.col("start_in_part"))


def read_ids(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, n_symbols) of every document, decoded from the files."""
    return shard_starts(spark, path).select("payload", "start").mapInArrow(
        _decode, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, n_symbols bigint")


def write_and_read(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> DataFrame:
    path = scratch(docs.sparkSession, "token-ids")
    write_ids(docs, path, tokenizer_path, end_id, shard_ids)
    return read_ids(docs.sparkSession, path)
