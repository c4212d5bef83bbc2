"""Token counts: lengths only, from byte-balanced batches inside Arrow functions.

Every text is split at safe boundaries, the places where a run of spaces follows a word. No piece of the
model holds a space mark after another character (checked when the model is loaded), so no merge crosses
such a place and the counts of the parts add up to the count of the whole text. Equal parts are encoded
once; batches of parts hold about the same number of bytes whatever the lengths of the texts are.

Defined results: null or empty text has no bytes and no tokens; a text of spaces only is one part; the
longest text costs the memory of one batch; further columns of the input are ignored; repeated rows are
counted each; an empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import small_batches, worker_cache
from .words import slices

BATCH_BYTES = 4 << 20
ENCODE_BYTES = 256 << 10
MEMO_ENTRIES = 400_000
MARK = "▁"  # the model's space mark; in a text it means a space
PART = re.compile(r" +[^ ]+| +$")

_counters: dict[str, "PartCounter"] = worker_cache()


class PartCounter:
    """Counts tokens of parts; remembers at most ``MEMO_ENTRIES`` of them between batches."""

    def __init__(self, model_path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError(f"{model_path}: pieces cross spaces, so texts can't be split there")
        self.memo: dict[str, int] = {}

    def parts(self, text: str) -> list[str]:
        """The model puts a space before a text; each part begins with its spaces."""
        return PART.findall(" " + text.replace(MARK, " ")) if text else []

    def learn(self, parts: set[str]) -> None:
        if len(self.memo) + len(parts) > MEMO_ENTRIES:
            self.memo = {}
        new = [p for p in parts if p not in self.memo]
        at = 0
        while at < len(new):
            size, end = 0, at
            while end < len(new) and (end == at or size < ENCODE_BYTES):
                size += len(new[end])
                end += 1
            ids = self.model.encode([p[1:] for p in new[at:end]], num_threads=1)
            self.memo.update(zip(new[at:end], map(len, ids)))
            at = end
        if " " in parts:
            self.memo[" "] = 1  # one space at a text's end: alone it would be an empty text

    def counts(self, texts: list[str]) -> list[int]:
        parts = [self.parts(t) for t in texts]
        self.learn(set().union(*parts))
        get = self.memo.__getitem__
        return [sum(map(get, p)) for p in parts]


def _count(model_path: str):
    def run(batches):
        counter = _counters.get(model_path)
        if counter is None:
            counter = _counters[model_path] = PartCounter(model_path)
        for batch in batches:
            n = np.zeros(batch.num_rows, dtype=np.int64)
            for a, b in slices(batch["text"], BATCH_BYTES):
                n[a:b] = counter.counts([t or "" for t in batch["text"].slice(a, b - a).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_bytes"], pa.array(n)],
                                             ["doc_id", "n_bytes", "n_tokens"])
    return run


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row by the sentencepiece model, no special tokens."""
    d = small_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text",
                    F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"))
    counted = d.mapInArrow(_count(model_path), "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
