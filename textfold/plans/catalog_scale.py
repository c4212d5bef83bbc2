"""Registered queries of the operators that replace a driver fit, a full sort, an unsplittable file or a whole-row exchange, with SQL oracles."""

from __future__ import annotations

import io
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from .. import sources
from ..operators import epochs, filters, folds, ridge, scoring, subword, tokens, user_model
from ..session import table_path
from ..sources import layout, once
from .catalog import K, SEED, SQL_LABELLED, docs, folded, labelled, query, sql_folds, table
from .catalog_cycles import SQL_CYCLE_ROWS
from .catalog_models import SQL_SCORED, SQL_TOKENS, VOCAB, VOCAB_LEN, doc_tokens, folded_tokens, model_weights, vocab


def fresh(spark, name: str) -> str:
    return table_path(spark, f"{name}-{uuid.uuid4().hex}")


# ---------------------------------------------------------------- A: files

@query("csv_quoted_records", """
SELECT doc_id, replace(replace(text, 'e', '"'), 'o', chr(10)) AS quoted, ' ' || replace(text, 'a', ',') || ' ' AS spaced, n_chars FROM documents
""")
def q_csv_quoted_records(spark, d):
    """A3: documents whose texts hold quotes, line breaks, commas and outer blanks, written as CSV and read by splits."""
    path = fresh(spark, "quoted-csv")
    rows = table(spark, d, "documents").select("doc_id", F.translate("text", "eo", '"\n').alias("quoted"), F.concat(
        F.lit(" "), F.translate("text", "a", ","), F.lit(" ")).alias("spaced"), "n_chars")
    sources.write_table(rows, path, fmt="csv")
    return sources.read_labeled_csv(spark, path, "doc_id bigint, quoted string, spaced string, n_chars bigint")


ROWS_PER_FILE = 20


@query("sized_fold_files", f"""
WITH {SQL_LABELLED}, {sql_folds('labelled', 'label', 'row_id')}
SELECT CAST(kfold AS BIGINT) AS fold, CAST(label AS BIGINT) AS label, count(*) AS n_rows, CAST(sum(n_chars) AS BIGINT) AS n_chars,
       CAST(ceil(count(*) / {int(ROWS_PER_FILE * layout.FILL)}.0) AS BIGINT) AS n_files
FROM folded GROUP BY 1, 2
""")
def q_sized_fold_files(spark, d):
    """Rows by fold and label in as many files as they need; counted again from the files."""
    path = fresh(spark, "sized")
    f = folded(spark, d).select("row_id", "n_chars", F.col("kfold").alias("fold"), "label")
    layout.write_sized(f, path, ["fold", "label"], rows_per_file=ROWS_PER_FILE)
    back = spark.read.parquet(path).withColumn("file", F.col("_metadata.file_path"))
    return back.groupBy(F.col("fold").cast("bigint").alias("fold"), F.col("label").cast("bigint").alias("label")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("n_chars").alias("n_chars"), F.countDistinct("file").alias("n_files"))


@query("built_once", """
SELECT lang, count(*) AS n_docs, CAST(sum(n_chars) AS BIGINT) AS n_chars, CAST(1 AS BIGINT) AS n_tables FROM documents GROUP BY lang
""")
def q_built_once(spark, d):
    """Two builders of one table at the same time, and a third one later; one table is there in the end."""
    path = fresh(spark, "once")

    def build():
        return table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_chars").alias("n_chars"))

    with ThreadPoolExecutor(2) as pool:
        for done in [pool.submit(once.build_once, spark, build, path) for _ in range(2)]:
            done.result()
    built = once.build_once(spark, build, path)
    files = spark.read.parquet(f"{path}/table-*").select(F.col("_metadata.file_path").alias("p"))
    n = files.select(F.countDistinct(F.regexp_extract("p", "/(table-[^/]*)/", 1))).scalar()
    return built.select("lang", "n_docs", "n_chars", n.alias("n_tables"))


# ---------------------------------------------------------------- D, E

@query("dedup_digest", """
SELECT min(doc_id) AS doc_id, lang, max(n_chars) AS n_chars FROM documents GROUP BY text, lang
""")
def q_dedup_digest(spark, d):
    """D3: of documents with equal text and language the first; texts are compared where digests repeat."""
    kept = filters.dedup_by_digest(table(spark, d, "documents"), "doc_id", ["text", "lang"])
    return kept.select("doc_id", "lang", "n_chars")


EPOCHS = [0, 1, 2]


def _sql_permutation() -> str:
    """One row per document and epoch: the place is permuted until it is inside, by a recursive query."""
    n_keys = 8 * epochs.ROUNDS
    keys = ", ".join("(" + ", ".join([str(e), *map(str, epochs.round_keys(SEED, e))]) + ")" for e in EPOCHS)

    def mixed(x: str, r: int, at: int) -> str:
        k = [f"k{8 * r + at + i}" for i in range(4)]
        y = f"(({x} * {k[0]} + {k[1]}) % {epochs.PRIME})"
        return f"((({y} * {y}) % {epochs.PRIME} * {k[2]} + {k[3]}) % {epochs.PRIME})"
    steps = ["w.v // c.b AS x0", "w.v % c.b AS y0"]
    for r in range(epochs.ROUNDS):
        steps += [f"(x{r} + {mixed(f'y{r}', r, 0)}) % c.a AS x{r + 1}", f"(y{r} + {mixed(f'x{r + 1}', r, 4)}) % c.b AS y{r + 1}"]
    return f"""
WITH RECURSIVE base AS (SELECT doc_id, CAST(row_number() OVER (ORDER BY md5('{SEED}|' || CAST(doc_id AS VARCHAR)), CAST(doc_id AS VARCHAR)) - 1 AS BIGINT) AS place
                        FROM documents),
n0 AS (SELECT count(*) AS n, greatest(CAST(ceil(sqrt(count(*))) AS BIGINT), 1) AS a FROM documents),
c AS (SELECT n, a, (n + a - 1) // a AS b FROM n0),
keys(epoch, {', '.join(f'k{i}' for i in range(n_keys))}) AS (VALUES {keys}),
w AS (SELECT doc_id, CAST(epoch AS BIGINT) AS epoch, place AS v, 0 AS step FROM base CROSS JOIN keys
      UNION ALL
      SELECT doc_id, epoch, x{epochs.ROUNDS} * b + y{epochs.ROUNDS} AS v, step + 1 AS step FROM (
        SELECT w.doc_id, w.epoch, w.step, c.b, {', '.join(steps)}
        FROM w CROSS JOIN c JOIN keys ON keys.epoch = w.epoch WHERE w.step = 0 OR w.v >= c.n) s)
SELECT doc_id, epoch, v AS position FROM w CROSS JOIN c WHERE step > 0 AND v < n
"""


@query("epoch_permutations", _sql_permutation())
def q_epoch_permutations(spark, d):
    """Three epochs' orders from one ranking, without an exchange per epoch."""
    ranked = folds.shuffle_positions(docs(spark, d).select("doc_id", "row_id"), SEED)
    e = epochs.epoch_positions(ranked, SEED, EPOCHS)
    return e.select("doc_id", F.col("epoch").cast("bigint").alias("epoch"), F.col("epoch_position").alias("position"))


# ---------------------------------------------------------------- F, G, I

@query("encode_subword")
def q_encode_subword(spark, d):
    """every whole document as subword ids of a byte-level vocabulary file (compared with its library in the tests)."""
    from public_tokenizers import path

    e = subword.encode_subword(docs(spark, d), "text", subword.load_merges(spark, path("byte_bpe_50k.json")), key="doc_id")
    return e.select("doc_id", F.size("input_ids").cast("bigint").alias("n_tokens"), F.array_join("input_ids", " ").alias("input_ids"))


def open_token_sums(content: bytes):
    """A user's model file: whole-number weights per (id, output) and a constant per output."""
    import numpy as np

    with np.load(io.BytesIO(content)) as f:
        weights, constant = f["weights"], f["constant"]

    def predict(ids, lengths):
        return weights[ids].sum(axis=1) + constant  # the padding id weighs nothing
    return predict


def _token_sum_model(spark, d) -> bytes:
    """The naive Bayes weights of all folds as such a file; (vocabulary x folds) numbers."""
    import numpy as np

    w = model_weights(spark, d, folded_tokens(spark, d)).filter("model = 'nb'").join(F.broadcast(vocab(spark, d).select("token", "id")), "token", "left").select("fold", "id", "w", "token")
    weights, constant = np.zeros((VOCAB_LEN, K), np.int64), np.zeros(K, np.int64)
    for r in w.collect():
        if r["token"] == scoring.BIAS_TOKEN:
            constant[r["fold"]] = r["w"]
        else:
            weights[r["id"], r["fold"]] = r["w"]
    out = io.BytesIO()
    np.savez_compressed(out, weights=weights, constant=constant)
    return out.getvalue()


@query("scores_user_model", f"""
WITH {SQL_SCORED}
SELECT CAST(row_id AS BIGINT) AS doc_id, model, CAST(fold AS BIGINT) AS fold, logit_milli FROM lscored WHERE model = 'nb'
""")
def q_scores_user_model(spark, d):
    """G1: every labelled row by a model file with an output per fold, in batches of bounded tokens; then G2's check of the keys."""
    path = f"{fresh(spark, 'model')}/token-sums.npz"
    user_model.write_file(spark, path, _token_sum_model(spark, d))
    rows = labelled(spark, d).withColumn("toks", tokens.tokenize(F.col("text")))
    ids = tokens.encode(rows, vocab(spark, d), "toks", vocab_size_bound=VOCAB)
    p = user_model.score_with(ids, user_model.Shipped(spark, path), open_token_sums, [("nb", f) for f in range(K)])
    p = scoring.drop_padding(p)
    return p.select(F.col("row_id").cast("bigint").alias("doc_id"), "model", F.col("fold").cast("bigint").alias("fold"),
                    F.col("logit").cast("bigint").alias("logit_milli"))


COUNTED = 6  # the most frequent tokens, whose rates are features
PENALTY = 1.0


def _sql_ridge() -> str:
    """Normal equations as sums, elimination column by column, and back substitution, one row per fold."""
    d = COUNTED + 2  # constant, number of tokens, rates
    rate = [f"(len(list_filter(a.toks, lambda t: t = tv.t{j})) * 1000) // greatest(len(a.toks), 1) AS x{2 + j}" for j in range(COUNTED)]
    sums = [f"CAST(sum(x{i} * x{j}) AS DOUBLE) + {PENALTY if i == j and i else 0.0}::DOUBLE AS m{i}_{j}" for i in range(d) for j in range(d)]
    sums += [f"CAST(sum(x{i} * y) AS DOUBLE) AS m{i}_{d}" for i in range(d)]
    ctes = [f"e0 AS (SELECT r.i AS fold, {', '.join(sums)} FROM feat, range({K}) r(i) WHERE kfold <> r.i GROUP BY r.i)"]
    for k in range(d):
        cols = [f"m{i}_{j} - m{i}_{k} / m{k}_{k} * m{k}_{j} AS m{i}_{j}" if i > k and j > k else f"m{i}_{j}" for i in range(d) for j in range(d + 1)]
        ctes.append(f"e{k + 1} AS (SELECT fold, {', '.join(cols)} FROM e{k})")
    back = [f"(m{i}_{d}{''.join(f' - m{i}_{j} * w{j}' for j in range(i + 1, d))}) / m{i}_{i} AS w{i}" for i in reversed(range(d))]
    return f"""
WITH {SQL_CYCLE_ROWS}, {SQL_TOKENS},
tv AS (SELECT {', '.join(f'max(token) FILTER (WHERE id = {tokens.N_SPECIAL + j}) AS t{j}' for j in range(COUNTED))} FROM vocab),
feat AS (SELECT f.doc_id, f.kfold, f.n_chars AS y, 1 AS x0, len(a.toks) AS x1, {', '.join(rate)}
         FROM rfolded f JOIN alltoks a ON a.doc_id = f.doc_id CROSS JOIN tv),
{', '.join(ctes)},
w AS (SELECT fold, {', '.join(back)} FROM e{d})
SELECT doc_id, CAST(kfold AS BIGINT) AS fold, round({' + '.join(f'x{i} * w{i}' for i in range(d))}, 2) AS prediction
FROM feat JOIN w ON w.fold = feat.kfold
"""


@query("oof_ridge", _sql_ridge())
def q_oof_ridge(spark, d):
    """Out-of-fold predictions of a ridge regression per fold, from one pass of exact products."""
    top = [r["token"] for r in tokens.build_vocab(doc_tokens(spark, d), "toks", COUNTED).orderBy("id").collect()]
    lab = labelled(spark, d)
    f = folds.assign_folds_regression(lab.select("row_id", "n_chars"), "n_chars", k=K, seed=SEED)
    rows = lab.select("doc_id", "row_id", tokens.tokenize(F.col("text")).alias("toks")).join(f, "row_id")
    n = F.size("toks")

    def rate(word: str) -> F.Column:
        count = F.size(F.filter("toks", lambda t: t == F.lit(word)))
        return F.call_function("div", (count * 1000).cast("bigint"), F.greatest(n, F.lit(1)).cast("bigint"))
    features = F.array(n.cast("double"), *[rate(word).cast("double") for word in top])
    rows = rows.select("doc_id", "kfold", "n_chars", features.alias("x"))
    models = ridge.fit_ridge(rows, F.col("x"), F.col("n_chars"), 1 + COUNTED, K, PENALTY)
    p = ridge.predict_ridge(rows, F.col("x"), models)
    return p.select("doc_id", F.col("kfold").cast("bigint").alias("fold"), F.round("prediction", 2).alias("prediction"))
