"""subword ids equal the vocabulary's library and a plain loop over merges."""

import random

import numpy as np
import pytest

from textfold.operators import subword

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", None, " ", "  two  spaces ", "it's WE'LL don't", "日本語 テキスト über straße", "é \U0001f600 \U0001f468‍\U0001f469", "tab\t\nnl \r\n x", "a" * 500, "ab" * 300 + "a",
       "12 345 6789, 0.5%...!!", "nbsp\xa0x　y z", "<|endoftext|>", "hello hello", "\x00\x7f\x85 end"]


@pytest.fixture(scope="module")
def merges(spark):
    return subword.load_merges(spark, PATH)


def plain_merge(word, m):
    """One lowest pair after the other, leftmost first."""
    ranks = {int(p): (int(r), int(x)) for p, r, x in zip(m.pairs, m.ranks, m.merged)}
    ids = [int(m.bytes_[b]) for b in word]
    while True:
        found = [(ranks[a << 32 | b][0], i) for i, (a, b) in enumerate(zip(ids, ids[1:])) if a << 32 | b in ranks]
        if not found:
            return ids
        _, i = min(found)
        ids[i:i + 2] = [ranks[ids[i] << 32 | ids[i + 1]][1]]


def test_merges_equal_a_plain_loop(merges):
    rng = random.Random(3)
    words = [bytes(rng.choices(b"aeinst hr", k=rng.randrange(1, 30))) for _ in range(300)] + [b"aaaaaaaaaaaaaaa", b"ababababab", "é日".encode(), b"\xff\x00"]
    ids, sizes = subword.merge_words(words, merges)
    at = np.concatenate(([0], np.cumsum(sizes)))
    assert [ids[at[i]:at[i + 1]].tolist() for i in range(len(words))] == [plain_merge(w, merges) for w in words]


def test_documents_equal_the_library(spark, merges, monkeypatch):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    library.encode_special_tokens = True
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    monkeypatch.setattr(subword, "MEMO_WORDS", 5000)
    got = {r["doc_id"]: r["input_ids"] for r in subword.encode_subword(docs.unionAll(odd).repartition(3), "text", merges, key="doc_id").collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.unionAll(odd).collect()}
    assert got == {d: library.encode(t or "", add_special_tokens=False).ids for d, t in texts.items()}
    assert subword.encode_subword(docs.limit(0), "text", merges, key="doc_id").collect() == []
