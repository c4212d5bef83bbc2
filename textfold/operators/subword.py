"""F1 with a subword vocabulary: byte-level pair merges by rank, from a given vocabulary file (vocabularies aren't trained here).

Texts are cut into words by a pattern in the JVM. An Arrow function encodes the distinct words of a batch that it hasn't seen yet, all at once:
a word's symbols are neighbours in one array, each round looks up the ranks of all neighbouring pairs, takes every word's lowest
rank and merges all its places, left to right; a word without a known pair leaves. The rounds follow the longest word, not the number of words.
Rows are then gathered from the words' ids, so nothing is shuffled; the merges (at most ``MAX_MERGES``) are sent to every task once.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..plans.partitioning import text_batches

MAX_MERGES = 1_000_000
MEMO_WORDS = 300_000
NONE = np.int64(1) << 40  # the rank of an unknown pair

# The word pattern of the byte-level vocabularies; (?U) gives \s its Unicode meaning.
WORDS = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself where it is printable Latin-1, else the next one from U+0100 on."""
    out, spare = [], 256
    for b in range(256):
        if 33 <= b < 127 or 161 <= b < 256 and b != 173:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


@dataclass
class Merges:
    """Ids of the 256 bytes, and the known pairs ``left << 32 | right`` in order with their ranks and merged ids."""

    bytes_: np.ndarray
    pairs: np.ndarray
    ranks: np.ndarray
    merged: np.ndarray


def load_merges(spark: SparkSession, path: str) -> Merges:
    """Merges of a ``tokenizers`` file of the byte-level BPE kind, on the driver."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    if model["type"] != "BPE" or len(model["merges"]) > MAX_MERGES:
        raise ValueError(f"{path}: not a byte-pair vocabulary of at most {MAX_MERGES} merges")
    ids = model["vocab"]
    both = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    pairs = np.array([ids[a] << 32 | ids[b] for a, b in both], np.int64)
    merged = np.array([ids[a + b] for a, b in both], np.int64)
    order = np.argsort(pairs, kind="stable")
    return Merges(np.array([ids[c] for c in byte_symbols()], np.int64), pairs[order], order.astype(np.int64), merged[order])


def _every_second(chosen: np.ndarray) -> np.ndarray:
    """Of each run of neighbouring places the first, third, ...: a place and the next one share a symbol."""
    at = np.flatnonzero(chosen)
    if not len(at):
        return at
    begins = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1] + 1)))
    offset = np.arange(len(at)) - np.repeat(begins, np.diff(np.concatenate((begins, [len(at)]))))
    return at[offset % 2 == 0]


def merge_words(words: list[bytes], m: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words end to end, and how many each has."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    symbols = m.bytes_[np.frombuffer(b"".join(words), np.uint8)]
    word = np.repeat(np.arange(len(words)), size)
    done_symbols, done_words = [], []
    while len(symbols):
        pair = symbols[:-1] << 32 | symbols[1:]
        at = np.minimum(np.searchsorted(m.pairs, pair), len(m.pairs) - 1)
        same = word[:-1] == word[1:]
        known = same & (m.pairs[at] == pair)
        rank = np.where(known, m.ranks[at], NONE)
        rank = np.append(rank, NONE)
        begins = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        least = np.minimum.reduceat(rank, begins)
        length = np.diff(np.concatenate((begins, [len(word)])))
        least = np.repeat(least, length)
        over = least == NONE
        if over.any():
            done_symbols.append(symbols[over])
            done_words.append(word[over])
        places = _every_second((rank == least) & ~over)
        symbols[places] = m.merged[at[places]]
        keep = ~over
        keep[places + 1] = False
        symbols, word = symbols[keep], word[keep]
    if not done_words:
        return np.zeros(0, np.int64), size
    word = np.concatenate(done_words)
    order = np.argsort(word, kind="stable")
    return np.concatenate(done_symbols)[order], np.bincount(word, minlength=len(words))


class _Memo:
    """Ids of words seen before in this task, as one array with offsets."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.forget()

    def forget(self):
        self.number: dict[str, int] = {}
        self.ids, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def numbers(self, words: list[str]) -> np.ndarray:
        if len(self.number) + len(words) > MEMO_WORDS:
            self.forget()
        new = [w for w in words if w not in self.number]
        if new:
            ids, sizes = merge_words([w.encode() for w in new], self.merges)
            self.number.update(zip(new, range(len(self.sizes), len(self.sizes) + len(new))))
            self.ids, self.sizes = np.concatenate((self.ids, ids.astype(np.int32))), np.concatenate((self.sizes, sizes))
        return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))


def split_words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORDS), 0)


def encode_subword(df: DataFrame, text: str, merges: Merges, key: str = "row_id", out: str = "input_ids") -> DataFrame:
    """``key, out``: the ids of each whole text, without special tokens; a null text has none."""
    sent = df.sparkSession.sparkContext.broadcast(merges)

    def run(batches):
        memo = _Memo(sent.value)
        for batch in batches:
            words = batch["words"]
            n_words = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = words.flatten().dictionary_encode()
            number = memo.numbers(flat.dictionary.to_pylist())
            number = number[flat.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.zeros(0, np.int64)
            size = memo.sizes[number]
            begin = (np.cumsum(memo.sizes) - memo.sizes)[number]
            inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            ids = memo.ids[np.repeat(begin, size) + inner]
            at = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(n_words)))]
            yield pa.RecordBatch.from_arrays([batch[key], pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))], [key, out])

    kind = df.schema[key].dataType.simpleString()
    return text_batches(df.select(key, split_words(F.col(text)).alias("words"))).mapInArrow(run, f"{key} {kind}, {out} array<int>")
