"""Token sequences as array columns.

Tokenisation is a regular expression evaluated in the JVM; the vocabulary is a
top-k aggregate over the corpus, so it has a proven size bound. A row's tokens are
together already, so encoding maps them in place: an Arrow batch function looks all
tokens of a batch up in the vocabulary at once, without a shuffle. A vocabulary too
large to send to every task is joined instead, token by token.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.hashing import hash_key
from ..functions.text import FAST_TOKEN_PATTERN, TOKEN_PATTERN
from ..plans.partitioning import text_batches

# Ids of the special tokens, and the labels value for positions
# that carry no masked-LM target.
PAD_ID, UNK_ID, CLS_ID, SEP_ID, MASK_ID = 0, 1, 2, 3, 4
SPECIAL_TOKENS = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]"]
N_SPECIAL = len(SPECIAL_TOKENS)
IGNORE_LABEL = -100
# Largest vocabulary sent to the tasks (tens of MB); beyond it the encode join is a shuffle join.
MAX_LOCAL_VOCAB = 1_000_000


def tokenize(col: Column, pattern: str = TOKEN_PATTERN) -> Column:
    """list of tokens of a text column (no lowercasing, so both engines agree)."""
    fast = FAST_TOKEN_PATTERN if pattern == TOKEN_PATTERN else pattern
    return F.regexp_extract_all(F.coalesce(col, F.lit("")), F.lit(fast), 0)


def token_counts(df: DataFrame, tokens_col: str) -> DataFrame:
    """Corpus token frequencies ``(token, count)``; partial aggregation runs map-side."""
    # explode_outer: a plain explode lets the optimizer add a size(tokens) > 0 filter
    # below the projection, which would evaluate the tokeniser twice.
    return (df.select(F.explode_outer(tokens_col).alias("token")).filter(F.col("token").isNotNull())
            .groupBy("token").agg(F.count(F.lit(1)).alias("count")))


def build_vocab(df: DataFrame, tokens_col: str, size: int) -> DataFrame:
    """top-``size`` tokens by (count desc, token); ids start after the special tokens.

    The limit *is* the operator (a vocabulary of fixed size); Spark plans it as a
    distributed top-k, and the result has at most ``size`` rows.
    """
    top = token_counts(df, tokens_col).orderBy(F.desc("count"), F.asc("token")).limit(size)
    w = Window.orderBy(F.desc("count"), F.asc("token"))  # over at most `size` rows
    return top.withColumn("id", (F.row_number().over(w) - 1 + N_SPECIAL).cast("int"))


def fit_vocab(df: DataFrame, tokens_col: str, size: int) -> DataFrame:
    """F1 as an estimator: the top-``size`` vocabulary, returned as a local relation
    (at most ``size`` rows, as a fitted vocabulary model keeps it)."""
    from ..plans.local import to_local

    return to_local(build_vocab(df, tokens_col, size), size)


def encode_columns(df: DataFrame, vocab: DataFrame, columns: dict[str, str], key: str = "row_id") -> DataFrame:
    """F1 in place: token arrays (names of ``columns``) become id arrays (their values), unknown tokens ``UNK_ID``.

    ``vocab`` is a fitted vocabulary of at most ``MAX_LOCAL_VOCAB`` rows (checked). Returns key and the id arrays.
    """
    v = vocab.select("token", "id").limit(MAX_LOCAL_VOCAB + 1).toArrow()
    if v.num_rows > MAX_LOCAL_VOCAB:
        raise ValueError(f"a vocabulary of more than {MAX_LOCAL_VOCAB} tokens is joined: use encode without a bound")
    known, ids = v["token"].combine_chunks(), v["id"].combine_chunks().cast("int32")

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            out = [batch[key]]
            for c in columns:
                flat = batch[c].flatten().dictionary_encode()  # each distinct token of a batch is looked up once
                number = pc.fill_null(ids.take(pc.index_in(flat.dictionary.cast(known.type), value_set=known)), UNK_ID)
                found = number.take(flat.indices)
                n = pc.fill_null(pc.list_value_length(batch[c]), 0).to_numpy()
                off = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(off), found))
            yield pa.RecordBatch.from_arrays(out, [key, *columns.values()])

    kind = df.schema[key].dataType.simpleString()
    return text_batches(df.select(key, *columns)).mapInArrow(run, ", ".join([f"{key} {kind}", *(f"{o} array<int>" for o in columns.values())]))


def encode(df: DataFrame, vocab: DataFrame, tokens_col: str, key: str = "row_id",
           out: str = "input_ids", vocab_size_bound: int | None = None) -> DataFrame:
    """map tokens to ids (unknown -> ``UNK_ID``), keeping token order. Returns ``key, out``.

    With a bound of at most ``MAX_LOCAL_VOCAB`` tokens they are mapped in place, else by a shuffled join.
    """
    if vocab_size_bound is not None and vocab_size_bound <= MAX_LOCAL_VOCAB:
        return encode_columns(df, vocab, {tokens_col: out}, key)
    toks = df.select(key, F.posexplode_outer(tokens_col).alias("pos", "token"))
    j = toks.join(vocab.select("token", "id"), "token", "left")
    pairs = F.when(F.col("pos").isNotNull(),
                   F.struct(F.col("pos"), F.coalesce(F.col("id"), F.lit(UNK_ID)).alias("id")))
    agg = j.groupBy(key).agg(F.array_sort(F.collect_list(pairs)).alias("__p"))
    return agg.select(key, F.transform("__p", lambda x: x["id"]).alias(out))


def token_length(a: Column, b: Column | None = None) -> Column:
    """sequence length with special tokens: ``|a| + 2`` or ``|a| + |b| + 3``."""
    if b is None:
        return (F.size(a) + 2).cast("int")
    return (F.size(a) + F.size(b) + 3).cast("int")


def pad_to(ids: Column, max_len: int, pad: int = PAD_ID) -> tuple[Column, Column]:
    """truncate to ``max_len`` and right-pad with ``pad``; returns (ids, attention_mask)."""
    cut = F.slice(ids, 1, max_len)
    fill = F.greatest(F.lit(max_len) - F.size(cut), F.lit(0))
    padded = F.concat(cut, F.array_repeat(F.lit(pad), fill))
    mask = F.concat(F.array_repeat(F.lit(1), F.size(cut)), F.array_repeat(F.lit(0), fill))
    return padded, mask


def with_specials(ids: Column, max_len: int) -> Column:
    """Single sequence ``[CLS] ids [SEP]`` truncated so it fits ``max_len``."""
    return F.concat(F.array(F.lit(CLS_ID)), F.slice(ids, 1, max_len - 2), F.array(F.lit(SEP_ID)))


def pad_batches(df: DataFrame, ids_col: str, batch_col: str, pad: int = PAD_ID) -> DataFrame:
    """pad each row to the longest sequence of its batch (a batch is bounded in size).

    Adds ``padded_ids``, ``attention_mask``, ``batch_len`` and ``pad_count``.
    """
    w = Window.partitionBy(batch_col)
    d = df.withColumn("batch_len", F.max(F.size(ids_col)).over(w).cast("int"))
    fill = F.col("batch_len") - F.size(ids_col)
    return (d.withColumn("padded_ids", F.concat(F.col(ids_col), F.array_repeat(F.lit(pad), fill)))
             .withColumn("attention_mask", F.concat(F.array_repeat(F.lit(1), F.size(ids_col)),
                                                    F.array_repeat(F.lit(0), fill)))
             .withColumn("pad_count", fill.cast("int")))


def pair_budget(la: Column, lb: Column, max_len: int) -> tuple[Column, Column]:
    """longest-first truncation lengths for a pair within ``max_len - 3`` tokens.

    Closed form of removing one token at a time from the longer side (the second
    side on a tie): ``a' = min(la, max(T - lb, ceil(T/2)))``, ``b' = min(lb, max(T - la, floor(T/2)))``.
    """
    t = max_len - 3
    a2 = F.least(la, F.greatest(F.lit(t) - lb, F.lit((t + 1) // 2)))
    b2 = F.least(lb, F.greatest(F.lit(t) - la, F.lit(t // 2)))
    return a2.cast("int"), b2.cast("int")


def encode_pair(df: DataFrame, a_col: str, b_col: str, max_len: int, pad: bool = True) -> DataFrame:
    """``[CLS] a [SEP] b [SEP]`` with longest-first truncation, segment ids and mask."""
    la, lb = F.size(a_col), F.size(b_col)
    a2, b2 = pair_budget(la, lb, max_len)
    first = F.concat(F.array(F.lit(CLS_ID)), F.slice(a_col, 1, a2), F.array(F.lit(SEP_ID)))
    second = F.concat(F.slice(b_col, 1, b2), F.array(F.lit(SEP_ID)))
    ids = F.concat(first, second)
    seg = F.concat(F.array_repeat(F.lit(0), a2 + 2), F.array_repeat(F.lit(1), b2 + 1))
    d = df.withColumn("input_ids", ids).withColumn("token_type_ids", seg)
    if pad:
        fill = F.lit(max_len) - F.size("input_ids")
        d = (d.withColumn("attention_mask", F.concat(F.array_repeat(F.lit(1), F.size("input_ids")),
                                                     F.array_repeat(F.lit(0), fill)))
              .withColumn("token_type_ids", F.concat("token_type_ids", F.array_repeat(F.lit(0), fill)))
              .withColumn("input_ids", F.concat("input_ids", F.array_repeat(F.lit(PAD_ID), fill))))
    else:
        d = d.withColumn("attention_mask", F.array_repeat(F.lit(1), F.size("input_ids")))
    return d


def special_mask(ids: Column, specials=(PAD_ID, UNK_ID, CLS_ID, SEP_ID, MASK_ID)) -> Column:
    """1 where the id is a special token or padding, else 0.

    Matches the usual special-token mask, which flags [CLS], [SEP], [PAD] (and
    [UNK]/[MASK] when they are registered specials); ordinary ids give 0.
    """
    arr = F.array(*[F.lit(s) for s in specials])
    return F.transform(ids, lambda x: F.array_contains(arr, x).cast("int"))


def mlm_mask(df: DataFrame, ids_col: str, seed: int, epoch: int, vocab_len: int,
             p: float = 0.15, key: str = "row_id",
             specials=(PAD_ID, UNK_ID, CLS_ID, SEP_ID, MASK_ID)) -> DataFrame:
    """masked-LM inputs and labels, redrawn per epoch, a pure function of (seed, epoch, row, position).

    One md5 per position gives four 32-bit uniforms: selection (< p), replacement
    by ``MASK_ID`` (< 0.8), else random id (< 0.5), and the random id itself
    (uniform over the whole vocabulary ``vocab_len`` including specials).
    Special and padding positions are never selected; labels are -100 off the selection.
    """
    two32 = 1 << 32
    t_sel, t_rep, t_rnd = int(p * two32), int(0.8 * two32), int(0.5 * two32)
    spec = F.array(*[F.lit(s) for s in specials])

    def u(h: Column, k: int) -> Column:
        return F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("bigint")

    def draw(x: Column, i: Column) -> Column:
        h = hash_key(F.lit(seed), F.lit(epoch), F.col(key), i)
        sel = (~F.array_contains(spec, x)) & (u(h, 0) < F.lit(t_sel))
        return F.struct(
            sel.alias("sel"),
            F.when(sel & (u(h, 1) < F.lit(t_rep)), F.lit(MASK_ID))
             .when(sel & (u(h, 2) < F.lit(t_rnd)), (u(h, 3) % F.lit(vocab_len)).cast("int"))
             .otherwise(x).alias("inp"),
            F.when(sel, x).otherwise(F.lit(IGNORE_LABEL)).alias("lab"))

    d = df.withColumn("__m", F.transform(ids_col, draw))
    return (d.withColumn("masked_ids", F.transform("__m", lambda s: s["inp"]))
             .withColumn("labels", F.transform("__m", lambda s: s["lab"]))
             .drop("__m"))
