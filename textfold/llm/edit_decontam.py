"""Benchmark decontamination by pigeonhole edit matching.

A benchmark item of L characters may differ from a passage by up to ``floor(EDIT_SHARE * L)`` edits. Cut
into one piece more than that, at least one piece must occur in the passage unchanged, so exact piece hits
(an Aho-Corasick automaton of all pieces, one pass over a text) find every candidate. Around a hit, Myers'
bit-parallel algorithm gives the least edit distance of the whole item to any substring.

Texts and items are compared in lower case with each run of white space as one space. Items are a stated query
set: blocks of at most ``BLOCK_BYTES`` of items are sent to the tasks, and each block passes over all documents.

Items under ``LEAST_CHARS`` characters are matched without errors, and only where no word goes on beyond either end.

Defined results: null and empty documents match nothing; items that are null or blank match nothing; repeated rows and items give repeated results; further columns are ignored; an empty
table on either side gives no rows. Whole texts are searched.
"""

from __future__ import annotations

import math
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import drop_caches, small_batches

EDIT_SHARE = 0.05
LEAST_CHARS = 20
BLOCK_BYTES = 8 << 20
# Scripts written without spaces between words (Thai, Lao, Myanmar, Khmer, kana, Han).
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff"
                      "\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def in_word(c: str) -> bool:
    return c == "_" or c.isalnum() or unicodedata.category(c)[0] == "M"


def goes_on(text: str, at: int) -> bool:
    """Whether a word goes on from before ``at`` to behind it."""
    if not 0 < at < len(text):
        return False
    a, b = text[at - 1], text[at]
    return in_word(a) and in_word(b) and not (UNSPACED.match(a) or UNSPACED.match(b))


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """``errors + 1`` pieces of about the same length, with their offsets."""
    n = errors + 1
    cut = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cut, cut[1:])]


class Pattern:
    """Myers' bit-parallel distance of a pattern to the nearest substring of a text."""

    def __init__(self, text: str):
        self.size = len(text)
        self.where: dict[str, int] = {}
        for i, c in enumerate(text):
            self.where[c] = self.where.get(c, 0) | 1 << i

    def distance(self, text: str) -> int:
        top, mask = 1 << self.size - 1, (1 << self.size) - 1
        plus, minus, score = mask, 0, self.size
        best = score
        for c in text:
            eq = self.where.get(c, 0)
            xv = eq | minus
            xh = (((eq & plus) + plus) ^ plus) | eq
            ph = minus | ~(xh | plus) & mask
            mh = plus & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
            ph, mh = ph << 1 & mask, mh << 1 & mask  # a match may begin anywhere
            plus = mh | ~(xv | ph) & mask
            minus = ph & xv
            best = min(best, score)
        return best


class Matcher:
    def __init__(self, items: list[tuple[int, str]], edit_share: float):
        import ahocorasick

        self.items, places = [], {}
        for item_id, text in items:
            t = normal(text)
            if not t:
                continue
            errors = math.floor(edit_share * len(t)) if len(t) >= LEAST_CHARS else 0
            for at, piece in pieces(t, errors):
                places.setdefault(piece, []).append((len(self.items), at))
            self.items.append((item_id, t, errors, Pattern(t)))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()

    def hits(self, text: str) -> list[tuple[int, int]]:
        """(item_id, distance) of the items in a text, the least distance of each."""
        if not self.items:
            return []
        t = normal(text)
        windows: dict[int, list[list[int]]] = {}
        short: set[int] = set()
        for end, (size, where) in self.automaton.iter(t):
            for i, at in where:
                _, item, errors, _ = self.items[i]
                if len(item) < LEAST_CHARS:
                    if i not in short and not goes_on(t, end + 1 - size) and not goes_on(t, end + 1):
                        short.add(i)
                    continue
                a = max(0, end + 1 - size - at - errors)
                b = end + 1 - size - at + len(item) + errors
                w = windows.setdefault(i, [])
                if w and a <= w[-1][1] and a >= w[-1][0]:
                    w[-1][1] = max(b, w[-1][1])
                else:
                    w.append([a, b])
        out = [(self.items[i][0], 0) for i in short]
        for i, spans in windows.items():
            item_id, item, errors, pattern = self.items[i]
            least = 0 if any(item in t[a:b] for a, b in spans) else min(pattern.distance(t[a:b]) for a, b in spans)
            if least <= errors:
                out.append((item_id, least))
        return sorted(out)


def item_blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES):
    """The items, (item_id, text), in lists of about ``block_bytes``; one list at a time is on the driver."""
    known = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").filter(F.col("text").isNotNull())
    size = known.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    for i in range(blocks):
        yield [(r["item_id"], r["text"]) for r in known.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == i).collect()]


def find_items(docs: DataFrame, items: DataFrame, edit_share: float = EDIT_SHARE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, distance) of each benchmark item within its error budget in a document, with its least distance.
    ``items`` has item_id and text."""
    d = small_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    out = None
    for block in item_blocks(items, block_bytes):
        def run(batches, block=block):
            drop_caches()
            matcher = Matcher(block, edit_share)
            for batch in batches:
                rows = [(k, *hit) for k, t in zip(batch["doc_id"].to_pylist(), batch["text"])
                        if t.is_valid for hit in matcher.hits(t.as_py())]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*rows) if rows else ((), (), ()))],
                                                 ["doc_id", "item_id", "distance"])
        found = d.mapInArrow(run, "doc_id bigint, item_id bigint, distance bigint")
        out = found if out is None else out.unionAll(found)
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, edit_share: float = EDIT_SHARE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns, without those that hold a benchmark item within its error budget."""
    small_batches(docs)
    for block in item_blocks(items, block_bytes):
        def run(batches, block=block):
            drop_caches()
            matcher = Matcher(block, edit_share)
            for batch in batches:
                yield batch.filter(pa.array([not (t.is_valid and matcher.hits(t.as_py())) for t in batch["text"]], pa.bool_()))
        docs = docs.mapInArrow(run, docs.schema)
    return docs
