"""Language ID: script ranges narrow the candidates, Viterbi over per-word scores labels spans.

The model holds, for each language, log probabilities of hashed character 1- to 3-grams of words, and the
scripts its training words are written in. A word's scores are its log posteriors among the languages of
its script. Viterbi picks the best path through a text's words, where a change of language costs
``SWITCH``; its runs are the spans. The document's language is the one with most letters in its spans,
ties to the more frequent language in training, and the score is its share of all letters.

Fitting uses a bounded sample: about ``FIT_DOCS`` documents of each language, those with the smallest key
hash, with their whole texts. Labels are read for these alone; a prediction sees nothing but the text.

Defined results: a null text or one without a letter is ``und`` with score 0; a script that no language
was seen in leaves all languages possible; without any training document every text is ``und``; null
``doc_id`` is neither learned from nor held out; repeated rows get equal results; further columns are
ignored; an empty table gives no rows. Viterbi runs over all texts of a few MB at once, word
position by word position, so one very long text costs a step per word and no more memory than its words.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .shared import drop_caches, small_batches
from .words import slices

FIT_DOCS = 4000
MOST_LANGUAGES = 250
SLOTS = 1 << 16
SMOOTH = 0.5
FLOOR = -4.0
SWITCH = 6.0
SCRIPT_SHARE = 0.01
READ_BYTES = 2 << 20
LABEL_BYTES = 8 << 20
MEMO_ENTRIES = 300_000
LETTERS = re.compile(r"[^\W\d_]+")

# First code points of the ranges of the main scripts, with the script from there on.
SCRIPT_RANGES = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"),
    (0x0A80, "gujarati"), (0x0B00, "other"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"),
    (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"),
    (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"),
    (0x1780, "khmer"), (0x1800, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "latin"), (0x2C00, "other"),
    (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"),
    (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"),
    (0xFF21, "latin"), (0xFF66, "kana"), (0xFFA0, "other"), (0x20000, "han")]
SCRIPTS = sorted({name for _, name in SCRIPT_RANGES})
_FROM = np.array([a for a, _ in SCRIPT_RANGES])
_SCRIPT = np.array([SCRIPTS.index(name) for _, name in SCRIPT_RANGES])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots of the 1- to 3-grams of the words, the word of each gram, and each word's script."""
    c = np.frombuffer(("\n" + "\n".join(words) + "\n").encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    edge = c == 10
    word = np.cumsum(edge) - 1
    k = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
    shift = np.uint64(64 - 16)
    one = np.flatnonzero(~edge)
    inner = np.flatnonzero(~edge[1:-1]) + 1
    two = np.flatnonzero(~(edge[:-1] & edge[1:]))
    slots = [(c[one] * k[0] + np.uint64(1)) * k[1] >> shift,
             (c[two] * k[0] + c[two + 1] * k[1] + np.uint64(2)) * k[2] >> shift,
             (c[inner - 1] * k[0] + c[inner] * k[1] + c[inner + 1] * k[2]) * k[0] >> shift]
    of = [word[one], np.where(edge[two], word[two], word[two]), word[inner]]
    first = np.flatnonzero(edge[:-1]) + 1
    script = _SCRIPT[np.searchsorted(_FROM, c[first].astype(np.int64), side="right") - 1]
    return np.concatenate(slots).astype(np.int64), np.concatenate(of), script


def _count_grams(languages: list[str]):
    number = {name: i for i, name in enumerate(languages)}
    width = SLOTS + len(SCRIPTS)

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
                words = LETTERS.findall(text.lower())
                if not words:
                    continue
                slot, _, script = grams(words)
                have = total.setdefault(number[lang], np.zeros(width, np.int64))
                have += np.bincount(np.concatenate((slot, SLOTS + script)), minlength=width)
        for lang, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), lang, np.int32)), pa.array(at.astype(np.int32)),
                                              pa.array(n[at])], ["lang", "slot", "n"])
    return run


class Model:
    def __init__(self, languages: list[str], score: np.ndarray, scripts: np.ndarray):
        self.languages, self.score, self.scripts = languages, score, scripts


def fit(docs: DataFrame, fit_docs: int = FIT_DOCS) -> Model:
    """Learn from documents with a language that aren't held out. ``docs`` has doc_id, text, lang."""
    train = small_batches(docs).filter(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull()
                        & F.col("text").isNotNull())
    sizes = train.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES + 1).collect()
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    languages = [r["lang"] for r in sizes]
    if not languages:
        return Model([], np.zeros((SLOTS, 0), np.float32), np.zeros((len(SCRIPTS), 0), bool))
    share = F.coalesce(*[F.when(F.col("lang") == r["lang"], F.lit(min(1.0, fit_docs / r["n"]))) for r in sizes])
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = train.filter(draw < share).select("lang", "text", "doc_id").repartition(8, "doc_id")
    counts = (sample.select("lang", "text").mapInArrow(_count_grams(languages), "lang int, slot int, n bigint")
              .groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow())  # at most languages x slots rows
    n = np.zeros((SLOTS + len(SCRIPTS), len(languages)))
    n[counts["slot"].to_numpy(), counts["lang"].to_numpy()] = counts["n"].to_numpy()
    gram, script = n[:SLOTS], n[SLOTS:]
    score = np.log((gram + SMOOTH) / (gram.sum(axis=0) + SMOOTH * SLOTS)).astype(np.float32)
    return Model(languages, score, script >= np.maximum(1, SCRIPT_SHARE * script.sum(axis=0)))


class WordScores:
    """Log posteriors of words, remembered up to ``MEMO_ENTRIES`` words between batches."""

    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self):
        self.memo: dict[str, int] = {}
        self.table = np.zeros((1 << 12, len(self.model.languages)), np.float32)
        self.known = np.zeros(1 << 12, bool)  # words in a script of some language

    def learn(self, words: list[str]) -> None:
        m = self.model
        slot, of, script = grams(words)
        n = len(words)
        s = np.zeros((n, len(m.languages)), np.float32)
        for j in range(s.shape[1]):
            s[:, j] = np.bincount(of, weights=m.score[slot, j], minlength=n + 1)[:n]
        known = m.scripts[script]
        s[~known & known.any(axis=1)[:, None]] = -1e9
        s[~known.any(axis=1)] = 0
        s -= s.max(axis=1, keepdims=True)
        s -= np.log(np.exp(s).sum(axis=1, keepdims=True))
        have = len(self.memo)
        if have + n > len(self.table):
            grown = np.zeros((max(2 * len(self.table), have + n), s.shape[1]), np.float32)
            grown[:have] = self.table[:have]
            self.table = grown
            self.known = np.concatenate((self.known[:have], np.zeros(len(grown) - have, bool)))
        self.table[have:have + n] = np.maximum(s, FLOOR)
        self.known[have:have + n] = known.any(axis=1)
        self.memo.update(zip(words, range(have, have + n)))

    def rows(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The log posteriors of all words, and whether their script is known."""
        new = list(set().union(*texts) - self.memo.keys())
        if len(self.memo) + len(new) > MEMO_ENTRIES:
            self.forget()
            new = list(set().union(*texts))
        for i in range(0, len(new), 50_000):
            self.learn(new[i:i + 50_000])
        get = self.memo.__getitem__
        at = np.fromiter((i for t in texts for i in map(get, t)), np.int64, sum(map(len, texts)))
        return self.table[at], self.known[at]


def viterbi(score: np.ndarray, count: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best language of each word. Texts lie end to end in ``score`` (words x languages) with ``count`` words
    each; all texts step together, longest first, so each step is a few array operations."""
    n, m = score.shape
    label = np.zeros(n, dtype=np.int16)
    if not n:
        return label
    begin = np.cumsum(count) - count
    order = np.argsort(-count, kind="stable")
    begin, count = begin[order], count[order]
    active = np.searchsorted(-count, -np.arange(int(count[0])), side="left")  # texts with more than t words
    came = np.zeros((n, m), dtype=np.uint8 if m < 256 else np.uint16)
    own = np.arange(m, dtype=came.dtype)
    best = score[begin[:active[0]]].astype(np.float64)
    end = np.empty((len(count), m))
    for t in range(1, int(count[0]) + 1):
        k = int(active[t]) if t < len(active) else 0
        if k < len(best):
            end[k:len(best)] = best[k:]
            best = best[:k]
        if not k:
            break
        top = best.argmax(axis=1)
        change = best[np.arange(k), top][:, None] - switch
        at = begin[:k] + t
        came[at] = np.where(best >= change, own, top[:, None])
        best = np.maximum(best, change) + score[at]
    some = int(active[0])
    now = np.zeros(len(count), dtype=np.int64)
    now[:some] = end[:some].argmax(axis=1)
    for t in range(int(count[0]) - 1, -1, -1):
        k = int(active[t])
        at = begin[:k] + t
        label[at] = now[:k]
        if t:
            now[:k] = came[at, now[:k]]
    return label


SPAN = pa.struct([("first_word", pa.int32()), ("end_word", pa.int32()), ("lang", pa.string())])


class Labeller:
    """Language, score, spans, and share of letters in words of a known script, of the texts of a batch."""

    def __init__(self, model: Model):
        self.names = pa.array([*model.languages, "und"])
        self.m = len(model.languages)
        self.scores = WordScores(model)

    def __call__(self, col: pa.Array) -> tuple[pa.Array, np.ndarray, pa.ListArray, np.ndarray]:
        score, known, count, letters, m = [], [], [], [], self.m
        for a, b in slices(col, READ_BYTES):
            texts = [LETTERS.findall(t.lower()) if t and m else [] for t in col.slice(a, b - a).to_pylist()]
            for into, part in zip((score, known), self.scores.rows(texts)):
                into.append(part)
            count.append(np.fromiter(map(len, texts), np.int64, len(texts)))
            letters.append(np.fromiter((len(w) for t in texts for w in t), np.int64, int(count[-1].sum())))
        score, known, count, letters = map(np.concatenate, (score, known, count, letters))
        label = viterbi(score, count)
        doc = np.repeat(np.arange(len(count)), count)
        share = np.bincount(doc * max(m, 1) + label, weights=letters, minlength=len(count) * max(m, 1)).reshape(len(count), -1)
        total = share.sum(axis=1)
        pred = np.where(total > 0, share.argmax(axis=1), m)
        part = np.divide(share.max(axis=1), total, out=np.zeros(len(count)), where=total > 0)
        known = np.divide(np.bincount(doc, weights=letters * known, minlength=len(count)), total, out=np.zeros(len(count)), where=total > 0)
        new = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (label[1:] != label[:-1])))) if len(doc) else doc
        stop = np.append(new[1:], len(doc)) if len(doc) else new
        base = (np.cumsum(count) - count)[doc[new]]
        spans = pa.StructArray.from_arrays([pa.array((new - base).astype(np.int32)), pa.array((stop - base).astype(np.int32)),
                                            self.names.take(pa.array(label[new].astype(np.int64)))], fields=list(SPAN))
        off = np.searchsorted(doc[new], np.arange(len(count) + 1)).astype(np.int32)
        return self.names.take(pa.array(pred)), part, pa.ListArray.from_arrays(pa.array(off), spans), known


def label_languages(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, spans) of each row; ``spans`` are runs of words in one language."""
    def run(batches):
        drop_caches()
        label = Labeller(model)
        for batch in batches:
            for a, b in slices(batch["text"], LABEL_BYTES):
                part = batch.slice(a, b - a)
                pred, score, spans, _ = label(part["text"])
                yield pa.RecordBatch.from_arrays([part["doc_id"], pred, pa.array(score), spans],
                                                 ["doc_id", "lang_pred", "score", "spans"])
    return small_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        run, "doc_id bigint, lang_pred string, score double, spans array<struct<first_word: int, end_word: int, lang: string>>")


def keep_languages(docs: DataFrame, model: Model, least_score: float) -> DataFrame:
    """The rows of ``docs``, all columns, whose text has a language and at least that share of its letters in spans of known
    languages, however many: in words of a script that some language is written in. A model without languages raises."""
    if not model.languages and not docs.isEmpty():
        raise ValueError("no language learned: no document outside the held-out ones has an id, a text and a lang")
    def run(batches):
        drop_caches()
        label = Labeller(model)
        for batch in batches:
            for a, b in slices(batch["text"], LABEL_BYTES):
                part = batch.slice(a, b - a)
                pred, _, _, known = label(part["text"])
                kept = pa.array((known >= least_score) & (pred.to_numpy(zero_copy_only=False) != "und"))
                yield part.filter(kept)
    return small_batches(docs).mapInArrow(run, docs.schema)
