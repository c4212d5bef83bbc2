"""Token output and token counts against the libraries; grammar round trips."""

import numpy as np
import pytest
from public_tokenizers import path

from textfold.llm import repair_output, token_counts
from tests.llm import brute

SF = "/root/testdata/sf0.001/documents.parquet"
ROWS = [(3, "The QUICK brown-fox's 12 jumps, it's don't!"), (1, None), (2, ""), (None, "ﬁ İstanbul ΑΣ Å"), (3, "again"),
        (5, "a<|endoftext|>b <|ENDOFTEXT|>"), (6, "tab\tnl\nnbsp x\u0085y\x1cz  em"), (7, "日本語 テキスト über straße"),
        (8, "aaaa " * 3000 + "b" * 5000), (9, "é \U0001f600 \x00 İ"), (9, "é \U0001f600 \x00 İ"),
        (10, "  two  spaces   three "), (11, " "), (12, "a▁b ▁"), (13, "x  "), (14, "<s> </s> <unk> <0x41>\n\n")]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path("word_bpe_49k.json"))


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 0, 0) for d, t in rows], "doc_id long, text string, start int, part int")


def test_token_ids_round_trip(spark, tokenizer):
    out = repair_output.write_and_read(frame(spark, ROWS), path("word_bpe_49k.json"), shard_ids=500)
    got = [tuple(r)[:4] for r in out.collect()]
    assert sorted(got, key=lambda r: r[1]) == brute.token_rows(ROWS, tokenizer)
    assert repair_output.write_and_read(frame(spark, ROWS).limit(0), path("word_bpe_49k.json")).count() == 0


def test_token_ids_of_documents(spark, tokenizer):
    df = spark.read.parquet(SF)
    got = [tuple(r)[:4] for r in repair_output.write_and_read(df, path("word_bpe_49k.json"), shard_ids=20_000).collect()]
    assert sorted(got) == brute.token_rows([tuple(r) for r in df.select("doc_id", "text").collect()], tokenizer)


def test_runs_and_needed_rules():
    for n in (1, 2, 3, 17, 100_000):
        s = repair_output.Shard(repair_output.pack(np.arange(1), np.zeros(1), np.array([n]), np.full(n, 7, np.int32)))
        assert (s.decode_documents(0, 1) == 7).all() and s.n_ids == n
        assert n < 1000 or len(s.symbols) < 100  # a run halves every round
    ids = np.tile(np.arange(50, dtype=np.int32), 200)
    s = repair_output.Shard(repair_output.pack(np.arange(200), np.zeros(200), np.full(200, 50), ids))
    assert len(s._needed(s.symbols[:0])) == 0 and len(s._needed(s.symbols[:1])) <= len(s.pairs)
    rng = np.random.default_rng(5)
    for _ in range(200):  # no two winners share a symbol, and the best pair always wins somewhere
        at = np.flatnonzero(rng.random(60) < 0.7)
        if len(at):
            place = np.full(62, 9)
            place[at + 1] = rng.integers(0, 4, len(at))
            won = at[repair_output._winners(at, place)]
            assert (np.diff(won) > 1).all() and place[won + 1].min() == place[at + 1].min()


@pytest.mark.parametrize("n, kinds", [(1, 1), (5, 1), (4000, 2), (30_000, 40), (20_000, 60_000)])
def test_grammar(n, kinds):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.5, n) % kinds).astype(np.int32)
    cuts = np.unique(np.append(rng.integers(1, n + 1, 20), n))
    sizes = np.diff(np.concatenate(([0], cuts)))
    s = repair_output.Shard(repair_output.pack(np.arange(len(sizes)), np.zeros(len(sizes)), sizes, ids))
    assert (s.decode_documents(0, len(sizes)) == ids).all()
    for a, b in [(0, 1), (len(sizes) // 2, len(sizes)), (len(sizes) - 1, len(sizes))]:  # random access
        assert (s.decode_documents(a, b) == ids[cuts[a] - sizes[a]:cuts[b - 1]]).all()
    for (x, y), k in zip(s.pairs.tolist(), s.lengths.tolist()):
        size = [1 if v < s.first_rule else int(s.lengths[v - s.first_rule]) for v in (x, y)]
        assert sum(size) == k
    if kinds == 2:
        assert len(s.symbols) < n / 3


def test_token_counts(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))
    rows = ROWS + [(100 + r["doc_id"], r["text"]) for r in spark.read.parquet(SF).collect()]
    got = [tuple(r) for r in token_counts.token_counts(frame(spark, rows), path("piece_bpe_32k.model")).collect()]
    expected = [(d, len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 4096) for d, t in rows]
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    assert sorted(got, key=order) == sorted(expected, key=order)
    assert token_counts.token_counts(frame(spark, rows).limit(0), path("piece_bpe_32k.model")).count() == 0
