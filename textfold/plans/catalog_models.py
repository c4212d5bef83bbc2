"""Registered token, scoring, ensemble and metric queries (F, G, H, E9) with SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.hashing import hash_key
from ..functions.numeric import bce_with_logits, decide, sigmoid
from ..functions.text import TOKEN_PATTERN
from ..operators import batching, ensemble, metrics, scoring, tokens
from .catalog import K, SEED, SQL_LABELLED, SQL_PAIRS, docs, folded, labelled, pairs, query, sql_folds, stored, table

VOCAB = 2000
VOCAB_LEN = VOCAB + tokens.N_SPECIAL
# Sequence lengths used by the reference (passages 256, sentence pairs 128).
MAX_LEN = 256
PAIR_MAX_LEN = 128
P = TOKEN_PATTERN


def ids_text(c) -> F.Column:
    return F.array_join(c, " ")


def r6(c) -> F.Column:
    return F.round(c, 6)


# ---------------------------------------------------------------- Spark building blocks

def doc_tokens(spark, d) -> DataFrame:
    return docs(spark, d).withColumn("toks", tokens.tokenize(F.col("text")))


def vocab(spark, d) -> DataFrame:
    return tokens.fit_vocab(doc_tokens(spark, d), "toks", VOCAB)


def encoded_docs(spark, d) -> DataFrame:
    e = tokens.encode(doc_tokens(spark, d), vocab(spark, d), "toks", vocab_size_bound=VOCAB)
    return e.withColumn("doc_id", F.col("row_id").cast("bigint"))


def folded_tokens(spark, d) -> DataFrame:
    """Labelled rows with their folds and tokens; fitting and out-of-fold scoring both read them."""
    return stored(folded(spark, d).select("row_id", "kfold", "label", tokens.tokenize(F.col("text")).alias("toks")), "folded-tokens")


def model_weights(spark, d, rows: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    f = folded(spark, d).withColumn("toks", tokens.tokenize(F.col("text"))) if rows is None else rows
    return scoring.fit_token_weights(f, "toks", "label", vocab(spark, d) if known is None else known, k=K, models=("nb", "presence"))


def score_rows(spark, d, rows: DataFrame) -> DataFrame:
    """Every row x every (model, fold): ``row_id, model, fold, logit_milli, logit``."""
    w = model_weights(spark, d)
    bound = (VOCAB + 1) * K
    return scoring.score_models(rows, "toks", w, binary_models=("presence",), weights_bound=2 * bound)


def labelled_scores(spark, d) -> DataFrame:
    """Every labelled row by every (model, fold)."""
    return scores_of(spark, d, folded_tokens(spark, d))


def scores_of(spark, d, f: DataFrame) -> DataFrame:
    return scoring.score_models(f.select("row_id", "toks"), "toks", model_weights(spark, d, f), binary_models=("presence",),
                                weights_bound=2 * (VOCAB + 1) * K)


def extra_rows(spark, d) -> DataFrame:
    """Unlabelled documents: the pseudo-labelling corpus."""
    lab = table(spark, d, "labels").select("doc_id")
    return doc_tokens(spark, d).join(lab, "doc_id", "left_anti")


def extra_scores(spark, d) -> DataFrame:
    return score_rows(spark, d, extra_rows(spark, d).select("row_id", "toks"))


def oof(spark, d) -> DataFrame:
    """OOF predictions with labels: ``row_id, model, fold, logit, label``. Metrics by batches read them twice."""
    f = folded_tokens(spark, d)
    return stored(scoring.score_own_fold(f, "toks", model_weights(spark, d, f), binary_models=("presence",), keep=["label"],
                                         weights_bound=2 * (VOCAB + 1) * K), "oof")


# ---------------------------------------------------------------- SQL building blocks

SQL_TOKENS = f"""
alltoks AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS row_id, regexp_extract_all(text, '{P}') AS toks FROM documents),
vocab AS (SELECT token, cnt, CAST(row_number() OVER (ORDER BY cnt DESC, token) - 1 + 5 AS INTEGER) AS id
          FROM (SELECT token, count(*) AS cnt FROM (SELECT unnest(toks) AS token FROM alltoks)
                GROUP BY token ORDER BY cnt DESC, token LIMIT {VOCAB})),
enc AS (SELECT a.doc_id, a.row_id, coalesce(e.ids, []::INTEGER[]) AS ids FROM alltoks a LEFT JOIN (
          SELECT row_id, list(coalesce(v.id, 1) ORDER BY pos) AS ids
          FROM (SELECT row_id, unnest(toks) AS token, generate_subscripts(toks, 1) AS pos FROM alltoks) t
          LEFT JOIN vocab v ON v.token = t.token GROUP BY row_id) e ON e.row_id = a.row_id)
"""

SQL_MODEL = f"""
{SQL_LABELLED}, {sql_folds('labelled', 'label', 'row_id')}, {SQL_TOKENS},
ftoks AS (SELECT f.row_id, f.label, f.kfold, a.toks FROM folded f JOIN alltoks a ON a.doc_id = f.doc_id),
occ AS (SELECT * FROM (SELECT row_id, label, kfold, unnest(toks) AS token FROM ftoks)
        WHERE token IN (SELECT token FROM vocab)),
pres AS (SELECT DISTINCT row_id, label, kfold, token FROM occ),
grid AS (SELECT i AS fold, token FROM vocab, range({K}) r(i)),
ndocs AS (SELECT i AS fold, count(*) FILTER (WHERE label = 0 AND kfold <> i) AS n0,
                 count(*) FILTER (WHERE label = 1 AND kfold <> i) AS n1 FROM folded, range({K}) r(i) GROUP BY i),
cnt AS (SELECT g.fold, g.token, count(o.token) FILTER (WHERE o.label = 0) AS c0, count(o.token) FILTER (WHERE o.label = 1) AS c1
        FROM grid g LEFT JOIN occ o ON o.token = g.token AND o.kfold <> g.fold GROUP BY g.fold, g.token),
dcnt AS (SELECT g.fold, g.token, count(o.token) FILTER (WHERE o.label = 0) AS c0, count(o.token) FILTER (WHERE o.label = 1) AS c1
         FROM grid g LEFT JOIN pres o ON o.token = g.token AND o.kfold <> g.fold GROUP BY g.fold, g.token),
tot AS (SELECT fold, sum(c0) AS N0, sum(c1) AS N1 FROM cnt GROUP BY fold),
vsz AS (SELECT count(*) AS V FROM vocab),
weights AS (
  SELECT 'nb' AS model, c.fold, c.token,
         CAST(round((ln((c.c1 + 1) / (t.N1 + v.V)) - ln((c.c0 + 1) / (t.N0 + v.V))) * 1000) AS BIGINT) AS w
  FROM cnt c JOIN tot t ON t.fold = c.fold, vsz v
  UNION ALL
  SELECT 'presence' AS model, c.fold, c.token,
         CAST(round((ln((c.c1 + 1) / (n.n1 + 2)) - ln((c.c0 + 1) / (n.n0 + 2))) * 1000) AS BIGINT) AS w
  FROM dcnt c JOIN ndocs n ON n.fold = c.fold),
bias AS (SELECT m.model, n.fold, CAST(round(ln(n.n1 / n.n0) * 1000) AS BIGINT) AS b
         FROM ndocs n, (VALUES ('nb'), ('presence')) m(model))
"""


def sql_scored(rows_cte: str, out: str) -> str:
    """Score rows ``{rows_cte}(row_id, toks)`` with every (model, fold) into ``{out}``."""
    return f"""
{out}_tf AS (SELECT row_id, token, count(*) AS tf FROM (SELECT row_id, unnest(toks) AS token FROM {rows_cte}) GROUP BY ALL),
{out}_sum AS (SELECT s.row_id, w.model, w.fold,
                     sum(CASE WHEN w.model = 'presence' THEN 1 ELSE s.tf END * w.w) AS sm
              FROM {out}_tf s JOIN weights w ON w.token = s.token GROUP BY ALL),
{out} AS (SELECT r.row_id, b.model, CAST(b.fold AS INTEGER) AS fold,
                 CAST(b.b + coalesce(s.sm, 0) AS BIGINT) AS logit_milli,
                 CAST(b.b + coalesce(s.sm, 0) AS BIGINT) / 1000.0 AS logit
          FROM {rows_cte} r CROSS JOIN bias b
          LEFT JOIN {out}_sum s ON s.row_id = r.row_id AND s.model = b.model AND s.fold = b.fold)
"""


SQL_SCORED = f"""
{SQL_MODEL},
lrows AS (SELECT l.row_id, a.toks FROM labelled l JOIN alltoks a ON a.doc_id = l.doc_id),
{sql_scored('lrows', 'lscored')},
xrows AS (SELECT a.row_id, a.toks FROM alltoks a WHERE a.doc_id NOT IN (SELECT doc_id FROM labels)),
{sql_scored('xrows', 'xscored')},
oof AS (SELECT s.row_id, s.model, s.fold, s.logit, f.label FROM lscored s JOIN folded f ON f.row_id = s.row_id AND f.kfold = s.fold)
"""


# ---------------------------------------------------------------- F: tokens

@query("vocab_topk", f"""
WITH {SQL_TOKENS}
SELECT token, CAST(id AS BIGINT) AS id, cnt AS count FROM vocab
""")
def q_vocab(spark, d):
    v = tokens.build_vocab(doc_tokens(spark, d), "toks", VOCAB)
    return v.select("token", F.col("id").cast("bigint"), "count")


@query("encode", f"""
WITH {SQL_TOKENS}
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_tokens, array_to_string(ids, ' ') AS input_ids FROM enc
""")
def q_encode(spark, d):
    """every document's whole token sequence as vocabulary ids (no truncation)."""
    e = encoded_docs(spark, d)
    return e.select("doc_id", F.size("input_ids").cast("bigint").alias("n_tokens"),
                    ids_text(F.col("input_ids")).alias("input_ids"))


@query("pad_to", f"""
WITH {SQL_TOKENS},
x AS (SELECT doc_id, list_concat([2], ids[1:{MAX_LEN - 2}], [3]) AS s FROM enc)
SELECT doc_id, array_to_string(list_resize(s, {MAX_LEN}, 0), ' ') AS input_ids,
       array_to_string(list_resize(list_transform(s, lambda v: 1), {MAX_LEN}, 0), ' ') AS attention_mask
FROM x
""")
def q_pad_to(spark, d):
    """``[CLS] ids [SEP]`` truncated and padded to the model length, with the attention mask."""
    e = encoded_docs(spark, d)
    ids, mask = tokens.pad_to(tokens.with_specials(F.col("input_ids"), MAX_LEN), MAX_LEN)
    return e.select("doc_id", ids_text(ids).alias("input_ids"), ids_text(mask).alias("attention_mask"))


@query("special_mask", f"""
WITH {SQL_TOKENS},
x AS (SELECT doc_id, list_resize(list_concat([2], ids[1:{MAX_LEN - 2}], [3]), {MAX_LEN}, 0) AS s FROM enc)
SELECT doc_id, array_to_string(list_transform(s, lambda v: CASE WHEN v IN (0, 1, 2, 3, 4) THEN 1 ELSE 0 END), ' ') AS special_mask
FROM x
""")
def q_special_mask(spark, d):
    e = encoded_docs(spark, d)
    ids, _ = tokens.pad_to(tokens.with_specials(F.col("input_ids"), MAX_LEN), MAX_LEN)
    return e.select("doc_id", ids_text(tokens.special_mask(ids)).alias("special_mask"))


@query("token_length", f"""
WITH {SQL_PAIRS}
SELECT row_id, CAST(len(regexp_extract_all(text_a, '{P}')) + len(regexp_extract_all(text_b, '{P}')) + 3 AS BIGINT) AS n_tokens
FROM pairs
""")
def q_token_length(spark, d):
    p = pairs(spark, d)
    n = tokens.token_length(tokens.tokenize(F.col("text_a")), tokens.tokenize(F.col("text_b")))
    return p.select("row_id", n.cast("bigint").alias("n_tokens"))


@query("pad_batches", f"""
WITH {SQL_TOKENS},
x AS (SELECT doc_id, list_concat([2], ids[1:{MAX_LEN - 2}], [3]) AS s,
             row_number() OVER (ORDER BY md5('{SEED}|1|' || row_id), row_id) - 1 AS position FROM enc),
b AS (SELECT *, CAST(floor(position / 8) AS BIGINT) AS batch FROM x),
m AS (SELECT *, max(len(s)) OVER (PARTITION BY batch) AS batch_len FROM b)
SELECT doc_id, batch, CAST(batch_len AS BIGINT) AS batch_len, CAST(batch_len - len(s) AS BIGINT) AS pad_count,
       array_to_string(list_resize(s, batch_len, 0), ' ') AS padded_ids
FROM m
""")
def q_pad_batches(spark, d):
    e = encoded_docs(spark, d).withColumn("s", tokens.with_specials(F.col("input_ids"), MAX_LEN))
    e = e.withColumn("k", hash_key(F.lit(SEED), F.lit(1), F.col("row_id")))
    b = batching.assign_batches(e, "k", 8)
    p = tokens.pad_batches(b, "s", "batch")
    return p.select("doc_id", "batch", F.col("batch_len").cast("bigint"), F.col("pad_count").cast("bigint"),
                    ids_text(F.col("padded_ids")).alias("padded_ids"))


SQL_PAIR_ENC = f"""
{SQL_PAIRS}, {SQL_TOKENS},
ptoks AS (SELECT row_id, regexp_extract_all(text_a, '{P}') AS ta, regexp_extract_all(text_b, '{P}') AS tb FROM pairs),
pa AS (SELECT p.row_id, coalesce(e.ids, []::INTEGER[]) AS a FROM ptoks p LEFT JOIN (
         SELECT row_id, list(coalesce(v.id, 1) ORDER BY pos) AS ids
         FROM (SELECT row_id, unnest(ta) AS token, generate_subscripts(ta, 1) AS pos FROM ptoks) t
         LEFT JOIN vocab v ON v.token = t.token GROUP BY row_id) e ON e.row_id = p.row_id),
pb AS (SELECT p.row_id, coalesce(e.ids, []::INTEGER[]) AS b FROM ptoks p LEFT JOIN (
         SELECT row_id, list(coalesce(v.id, 1) ORDER BY pos) AS ids
         FROM (SELECT row_id, unnest(tb) AS token, generate_subscripts(tb, 1) AS pos FROM ptoks) t
         LEFT JOIN vocab v ON v.token = t.token GROUP BY row_id) e ON e.row_id = p.row_id),
pl AS (SELECT pa.row_id, a, b, len(a) AS la, len(b) AS lb FROM pa JOIN pb ON pa.row_id = pb.row_id),
pt AS (SELECT *, least(la, greatest({PAIR_MAX_LEN - 3} - lb, {(PAIR_MAX_LEN - 3 + 1) // 2})) AS a2,
                 least(lb, greatest({PAIR_MAX_LEN - 3} - la, {(PAIR_MAX_LEN - 3) // 2})) AS b2 FROM pl)
"""


@query("encode_pair", f"""
WITH {SQL_PAIR_ENC}
SELECT row_id,
  array_to_string(list_resize(list_concat([2], a[1:a2], [3], b[1:b2], [3]), {PAIR_MAX_LEN}, 0), ' ') AS input_ids,
  array_to_string(list_resize(list_concat(list_resize([]::INTEGER[], a2 + 2, 0), list_resize([]::INTEGER[], b2 + 1, 1)), {PAIR_MAX_LEN}, 0), ' ') AS token_type_ids,
  array_to_string(list_resize(list_resize([]::INTEGER[], a2 + b2 + 3, 1), {PAIR_MAX_LEN}, 0), ' ') AS attention_mask
FROM pt
""")
def q_encode_pair(spark, d):
    p = pairs(spark, d).withColumn("ta", tokens.tokenize(F.col("text_a"))).withColumn(
        "tb", tokens.tokenize(F.col("text_b")))
    v = vocab(spark, d)
    both = tokens.encode_columns(p, v, {"ta": "a", "tb": "b"})
    e = tokens.encode_pair(both, "a", "b", PAIR_MAX_LEN)
    return e.select("row_id", ids_text(F.col("input_ids")).alias("input_ids"),
                    ids_text(F.col("token_type_ids")).alias("token_type_ids"),
                    ids_text(F.col("attention_mask")).alias("attention_mask"))


@query("mlm_mask", f"""
WITH {SQL_TOKENS},
x AS (SELECT doc_id, row_id, list_resize(list_concat([2], ids[1:{MAX_LEN - 2}], [3]), {MAX_LEN}, 0) AS s FROM enc),
p AS (SELECT doc_id, row_id, unnest(s) AS v, generate_subscripts(s, 1) - 1 AS i FROM x),
h AS (SELECT *, md5('{SEED}|0|' || row_id || '|' || CAST(i AS VARCHAR)) AS hx FROM p),
u AS (SELECT *, v NOT IN (0, 1, 2, 3, 4) AND ('0x' || substr(hx, 1, 8))::BIGINT < {int(0.15 * 2**32)} AS sel,
             ('0x' || substr(hx, 9, 8))::BIGINT AS u1, ('0x' || substr(hx, 17, 8))::BIGINT AS u2,
             ('0x' || substr(hx, 25, 8))::BIGINT AS u3 FROM h),
m AS (SELECT doc_id, i,
             CASE WHEN sel AND u1 < {int(0.8 * 2**32)} THEN 4
                  WHEN sel AND u2 < {int(0.5 * 2**32)} THEN CAST(u3 % {VOCAB_LEN} AS INTEGER)
                  ELSE v END AS inp,
             CASE WHEN sel THEN v ELSE -100 END AS lab FROM u)
SELECT doc_id, array_to_string(list(inp ORDER BY i), ' ') AS masked_ids, array_to_string(list(lab ORDER BY i), ' ') AS labels
FROM m GROUP BY doc_id
""")
def q_mlm_mask(spark, d):
    e = encoded_docs(spark, d)
    ids, _ = tokens.pad_to(tokens.with_specials(F.col("input_ids"), MAX_LEN), MAX_LEN)
    m = tokens.mlm_mask(e.withColumn("s", ids), "s", SEED, 0, VOCAB_LEN)
    return m.select("doc_id", ids_text(F.col("masked_ids")).alias("masked_ids"), ids_text(F.col("labels")).alias("labels"))


def _sql_block_shuffle(bs: int, blk: int | None) -> str:
    within = (f"(r // {blk}) * {blk} + row_number() OVER (PARTITION BY r // {blk} ORDER BY n_chars DESC, r) - 1"
              if blk else "row_number() OVER (ORDER BY n_chars DESC, r) - 1")
    return f"""
WITH r AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY md5('{SEED}|' || CAST(doc_id AS VARCHAR)), CAST(doc_id AS VARCHAR)) - 1 AS r,
                  count(*) OVER () AS n FROM documents),
b AS (SELECT *, n - n % {bs} AS nf FROM r),
s AS (SELECT *, {within} AS g FROM b WHERE r < nf),
bat AS (SELECT DISTINCT g // {bs} AS bb FROM s),
bo AS (SELECT bb, row_number() OVER (ORDER BY md5('{SEED}|' || CAST(bb AS VARCHAR)), CAST(bb AS VARCHAR)) - 1 AS o FROM bat)
SELECT s.doc_id, CAST(bo.o AS BIGINT) AS batch, CAST(bo.o * {bs} + s.g % {bs} AS BIGINT) AS position
FROM s JOIN bo ON s.g // {bs} = bo.bb
UNION ALL SELECT doc_id, CAST(nf // {bs} AS BIGINT) AS batch, CAST(r AS BIGINT) AS position FROM b WHERE r >= nf
"""


@query("block_shuffle", _sql_block_shuffle(7, 28))
def q_block_shuffle(spark, d):
    dd = docs(spark, d).withColumn("k", hash_key(F.lit(SEED), F.col("row_id")))
    b = batching.block_shuffle(dd, 7, "n_chars", "k", sort_bs_num=4, shuffle=True, seed=SEED)
    return b.select("doc_id", "batch", "position")


@query("block_shuffle_global", _sql_block_shuffle(7, None))
def q_block_shuffle_global(spark, d):
    dd = docs(spark, d).withColumn("k", hash_key(F.lit(SEED), F.col("row_id")))
    b = batching.block_shuffle(dd, 7, "n_chars", "k", sort_bs_num=None, shuffle=True, seed=SEED)
    return b.select("doc_id", "batch", "position")


# ---------------------------------------------------------------- G: scoring and ensembles

@query("scores", f"""
WITH {SQL_SCORED}
SELECT CAST(row_id AS BIGINT) AS doc_id, model, CAST(fold AS BIGINT) AS fold, logit_milli FROM lscored
""")
def q_scores(spark, d):
    s = labelled_scores(spark, d)
    return s.select(F.col("row_id").cast("bigint").alias("doc_id"), "model", F.col("fold").cast("bigint"),
                    "logit_milli")


@query("oof_accuracy", f"""
WITH {SQL_SCORED}
SELECT model, CAST(fold AS BIGINT) AS fold, round(avg(CASE WHEN (logit > 0) = (label = 1) THEN 1 ELSE 0 END), 6) AS accuracy,
       count(*) AS n_rows
FROM oof GROUP BY model, fold
""")
def q_oof_accuracy(spark, d):
    a = metrics.accuracy(oof(spark, d), "label")
    return a.select("model", F.col("fold").cast("bigint"), r6(F.col("accuracy")).alias("accuracy"), "n_rows")


@query("cv_summary", f"""
WITH {SQL_SCORED},
acc AS (SELECT model, fold, avg(CASE WHEN (logit > 0) = (label = 1) THEN 1 ELSE 0 END) AS accuracy FROM oof GROUP BY model, fold)
SELECT model, round(avg(accuracy), 6) AS mean_accuracy, string_agg(printf('%.6f', accuracy), ',' ORDER BY fold) AS per_fold,
       count(*) AS n_folds
FROM acc GROUP BY model
""")
def q_cv_summary(spark, d):
    a = metrics.accuracy(oof(spark, d), "label")
    s = metrics.cv_summary(a, "accuracy", by=["model"])
    return s.select("model", r6(F.col("mean_accuracy")).alias("mean_accuracy"), "per_fold", "n_folds")


@query("extra_scores", f"""
WITH {SQL_SCORED}
SELECT CAST(row_id AS BIGINT) AS doc_id, model, CAST(fold AS BIGINT) AS fold, logit_milli FROM xscored
""")
def q_extra_scores(spark, d):
    s = extra_scores(spark, d)
    return s.select(F.col("row_id").cast("bigint").alias("doc_id"), "model", F.col("fold").cast("bigint"),
                    "logit_milli")


@query("to_wide", f"""
WITH {SQL_SCORED}
SELECT CAST(row_id AS BIGINT) AS doc_id, CAST(fold AS BIGINT) AS fold,
       max(logit) FILTER (WHERE model = 'nb') AS nb, max(logit) FILTER (WHERE model = 'presence') AS presence
FROM xscored GROUP BY row_id, fold
""")
def q_to_wide(spark, d):
    w = ensemble.to_wide(extra_scores(spark, d), ["nb", "presence"])
    return w.select(F.col("row_id").cast("bigint").alias("doc_id"), F.col("fold").cast("bigint"), "nb", "presence")


@query("fold_labels", f"""
WITH {SQL_SCORED}
SELECT CAST(row_id AS BIGINT) AS doc_id, CAST(fold AS BIGINT) AS fold, round(avg(logit), 6) AS target
FROM xscored GROUP BY row_id, fold
""")
def q_fold_labels(spark, d):
    f = ensemble.fold_labels(extra_scores(spark, d))
    return f.select(F.col("row_id").cast("bigint").alias("doc_id"), F.col("fold").cast("bigint"),
                    r6(F.col("target")).alias("target"))


def _blend_weights(spark) -> DataFrame:
    # The two-model blend weights.
    return spark.createDataFrame([("nb", 0.33), ("presence", 0.67)], "model string, w double")


SQL_BLEND = "blend AS (SELECT * FROM (VALUES ('nb', 0.33::DOUBLE), ('presence', 0.67::DOUBLE)) t(model, w))"


@query("fold_labels_weighted", f"""
WITH {SQL_SCORED}, {SQL_BLEND}
SELECT CAST(row_id AS BIGINT) AS doc_id, CAST(fold AS BIGINT) AS fold, round(sum(w * logit), 6) AS target
FROM xscored JOIN blend USING (model) GROUP BY row_id, fold
""")
def q_fold_labels_weighted(spark, d):
    f = ensemble.fold_labels(extra_scores(spark, d), weights=_blend_weights(spark))
    return f.select(F.col("row_id").cast("bigint").alias("doc_id"), F.col("fold").cast("bigint"),
                    r6(F.col("target")).alias("target"))


@query("final_labels", f"""
WITH {SQL_SCORED},
pm AS (SELECT row_id, model, avg(logit) AS m FROM xscored GROUP BY row_id, model)
SELECT CAST(row_id AS BIGINT) AS doc_id, round(avg(m), 6) AS target FROM pm GROUP BY row_id
""")
def q_final_labels(spark, d):
    f = ensemble.final_labels(extra_scores(spark, d))
    return f.select(F.col("row_id").cast("bigint").alias("doc_id"), r6(F.col("target")).alias("target"))


@query("final_labels_weighted", f"""
WITH {SQL_SCORED}, {SQL_BLEND},
pm AS (SELECT row_id, model, avg(logit) AS m FROM xscored GROUP BY row_id, model)
SELECT CAST(row_id AS BIGINT) AS doc_id, round(sum(w * m), 6) AS target FROM pm JOIN blend USING (model) GROUP BY row_id
""")
def q_final_labels_weighted(spark, d):
    f = ensemble.final_labels(extra_scores(spark, d), weights=_blend_weights(spark))
    return f.select(F.col("row_id").cast("bigint").alias("doc_id"), r6(F.col("target")).alias("target"))


@query("attach_labels", f"""
WITH {SQL_SCORED},
fl AS (SELECT row_id, fold, avg(logit) AS target FROM xscored GROUP BY row_id, fold)
SELECT d.doc_id, d.lang, d.source, d.n_chars, CAST(fl.fold AS BIGINT) AS fold, round(fl.target, 6) AS target
FROM documents d JOIN fl ON fl.row_id = CAST(d.doc_id AS VARCHAR)
""")
def q_attach_labels(spark, d):
    src = docs(spark, d).select("row_id", "doc_id", "lang", "source", "n_chars")
    a = ensemble.attach_labels(src, ensemble.fold_labels(extra_scores(spark, d)))
    return a.select("doc_id", "lang", "source", "n_chars", F.col("fold").cast("bigint"),
                    r6(F.col("target")).alias("target"))


@query("avg_pseudo", f"""
WITH {SQL_SCORED},
fl AS (SELECT row_id, fold, avg(logit) AS target FROM xscored GROUP BY row_id, fold)
SELECT CAST(row_id AS BIGINT) AS doc_id,
       round(CASE WHEN count(target) = {K} AND count(*) = {K} THEN sum(target) / {K} END, 6) AS target
FROM fl GROUP BY row_id
""")
def q_avg_pseudo(spark, d):
    a = ensemble.average_pseudo(ensemble.fold_labels(extra_scores(spark, d)), n_folds=K)
    return a.select(F.col("row_id").cast("bigint").alias("doc_id"), r6(F.col("target")).alias("target"))


SQL_VOTE = """
votes AS (SELECT row_id, CAST(avg(CASE WHEN logit > 0 THEN 1 ELSE 0 END) > 0.5 AS INTEGER) AS vote,
                 CAST(avg(1 / (1 + exp(-logit))) > 0.5 AS INTEGER) AS soft_vote,
                 avg(1 / (1 + exp(-logit))) AS mean_prob,
                 CAST(min(CASE WHEN logit > 0 THEN 1 ELSE 0 END) = max(CASE WHEN logit > 0 THEN 1 ELSE 0 END) AS INTEGER) AS unanimous,
                 count(*) AS n_models
          FROM xscored GROUP BY row_id)
"""


@query("vote", f"""
WITH {SQL_SCORED}, {SQL_VOTE}
SELECT CAST(row_id AS BIGINT) AS doc_id, vote, soft_vote, round(mean_prob, 6) AS mean_prob, unanimous, n_models FROM votes
""")
def q_vote(spark, d):
    v = ensemble.vote(extra_scores(spark, d))
    return v.select(F.col("row_id").cast("bigint").alias("doc_id"), "vote", "soft_vote",
                    r6(F.col("mean_prob")).alias("mean_prob"), "unanimous", "n_models")


@query("unanimity", f"""
WITH {SQL_SCORED}, {SQL_VOTE}
SELECT CAST(sum(unanimous) AS BIGINT) AS n_unanimous, count(*) AS n_rows FROM votes
""")
def q_unanimity(spark, d):
    u = ensemble.unanimity(extra_scores(spark, d))
    return u.select(F.col("n_unanimous").cast("bigint"), "n_rows")


@query("agreement", f"""
WITH {SQL_SCORED}, {SQL_VOTE}
SELECT CAST(sum(CASE WHEN vote = soft_vote THEN 1 ELSE 0 END) AS BIGINT) AS n_equal, count(*) AS n_rows FROM votes
""")
def q_agreement(spark, d):
    v = ensemble.vote(extra_scores(spark, d))
    return v.agg(F.sum((F.col("vote") == F.col("soft_vote")).cast("bigint")).alias("n_equal"), F.count(F.lit(1)).alias("n_rows"))


SQL_MODEL_VOTES = f"""
{SQL_SCORED},
mv AS (SELECT row_id, model, CAST(avg(CASE WHEN logit > 0 THEN 1 ELSE 0 END) > 0.5 AS INTEGER) AS vote
       FROM xscored GROUP BY row_id, model),
lens AS (SELECT row_id, len(toks) + 2 AS n_tokens FROM xrows)
"""


def _model_votes(spark, d):
    rows = stored(extra_rows(spark, d).select("row_id", "toks"), "extra-tokens")
    s = stored(score_rows(spark, d, rows).select("row_id", "model", "logit"), "extra-scores")
    nb = ensemble.vote(s.filter(F.col("model") == "nb"))
    pr = ensemble.vote(s.filter(F.col("model") == "presence"))
    lens = rows.select("row_id", tokens.token_length(F.col("toks")).alias("n_tokens"))
    return nb, pr, lens


@query("agreement_len", f"""
WITH {SQL_MODEL_VOTES}
SELECT CASE WHEN l.n_tokens <= 256 THEN '<=256' ELSE '>256' END AS bucket,
       CAST(sum(CASE WHEN a.vote = b.vote THEN 1 ELSE 0 END) AS BIGINT) AS n_equal, count(*) AS n_rows
FROM mv a JOIN mv b ON a.row_id = b.row_id AND a.model = 'nb' AND b.model = 'presence'
JOIN lens l ON l.row_id = a.row_id
GROUP BY 1
""")
def q_agreement_len(spark, d):
    nb, pr, lens = _model_votes(spark, d)
    a = ensemble.agreement_by_length(nb, pr, lens, "vote", edge=256)
    return a.select("bucket", F.col("n_equal").cast("bigint"), "n_rows")


@query("route_by_length", f"""
WITH {SQL_MODEL_VOTES}
SELECT CAST(l.row_id AS BIGINT) AS doc_id, CASE WHEN l.n_tokens <= 256 THEN a.vote ELSE b.vote END AS vote
FROM lens l JOIN mv a ON a.row_id = l.row_id AND a.model = 'nb' JOIN mv b ON b.row_id = l.row_id AND b.model = 'presence'
""")
def q_route_by_length(spark, d):
    nb, pr, lens = _model_votes(spark, d)
    r = ensemble.route_by_length(nb, pr, lens, "vote", edge=256)
    return r.select(F.col("row_id").cast("bigint").alias("doc_id"), "vote")


# ---------------------------------------------------------------- H: metrics

@query("rmse", f"""
WITH {SQL_SCORED}
SELECT model, CAST(fold AS BIGINT) AS fold, round(avg(pow(label - 1 / (1 + exp(-logit)), 2)), 6) AS mse,
       round(sqrt(avg(pow(label - 1 / (1 + exp(-logit)), 2))), 6) AS rmse
FROM oof GROUP BY model, fold
""")
def q_rmse(spark, d):
    o = oof(spark, d).withColumn("p", sigmoid(F.col("logit"))).withColumn("y", F.col("label").cast("double"))
    r = metrics.rmse(o, "p", "y", by=["model", "fold"])
    return r.select("model", F.col("fold").cast("bigint"), r6(F.col("mse")).alias("mse"), r6(F.col("rmse")).alias("rmse"))


@query("batch_rmse", f"""
WITH {SQL_SCORED},
b AS (SELECT *, (row_number() OVER (PARTITION BY model, fold ORDER BY md5('{SEED}|' || row_id), row_id) - 1) // 16 AS batch FROM oof),
s AS (SELECT model, fold, batch, sum(pow(label - 1 / (1 + exp(-logit)), 2)) AS sse FROM b GROUP BY ALL)
SELECT model, CAST(fold AS BIGINT) AS fold, round(sqrt(avg(sse)), 6) AS batch_rmse FROM s GROUP BY model, fold
""")
def q_batch_rmse(spark, d):
    o = oof(spark, d).withColumn("p", sigmoid(F.col("logit"))).withColumn("y", F.col("label").cast("double"))
    o = o.withColumn("k", hash_key(F.lit(SEED), F.col("row_id")))
    r = metrics.batch_rmse(o, "p", "y", 16, "k", by=["model", "fold"])
    return r.select("model", F.col("fold").cast("bigint"), r6(F.col("batch_rmse")).alias("batch_rmse"))


SQL_BCE = "(greatest(logit, 0) - logit * label + ln(1 + exp(-abs(logit))))"


@query("bce", f"""
WITH {SQL_SCORED}
SELECT model, CAST(fold AS BIGINT) AS fold, round(avg({SQL_BCE}), 6) AS bce FROM oof GROUP BY model, fold
""")
def q_bce(spark, d):
    r = metrics.bce(oof(spark, d), "logit", "label", by=["model", "fold"])
    return r.select("model", F.col("fold").cast("bigint"), r6(F.col("bce")).alias("bce"))


@query("batch_bce", f"""
WITH {SQL_SCORED},
b AS (SELECT *, (row_number() OVER (PARTITION BY model, fold ORDER BY md5('{SEED}|' || row_id), row_id) - 1) // 16 AS batch FROM oof),
s AS (SELECT model, fold, batch, sum({SQL_BCE}) AS sb, count(*) AS nb FROM b GROUP BY ALL)
SELECT model, CAST(fold AS BIGINT) AS fold, round(sqrt(sum(sb * nb) / sum(nb)), 6) AS batch_bce FROM s GROUP BY model, fold
""")
def q_batch_bce(spark, d):
    o = oof(spark, d).withColumn("k", hash_key(F.lit(SEED), F.col("row_id")))
    r = metrics.batch_bce(o, "logit", "label", 16, "k", by=["model", "fold"])
    return r.select("model", F.col("fold").cast("bigint"), r6(F.col("batch_bce")).alias("batch_bce"))


def validation_log(spark, d) -> DataFrame:
    """A validation log derived from OOF predictions: epoch 0 evaluates the presence model,
    epoch 1 the NB model, one evaluation per validation row every 25 steps."""
    o = oof(spark, d)
    o = o.withColumn("epoch", F.when(F.col("model") == "presence", 0).otherwise(1))
    o = o.withColumn("k", hash_key(F.lit(SEED), F.col("epoch"), F.col("row_id")))
    from .ordering import hash_rank

    o = hash_rank(o, "k", tiebreak="row_id", by=["fold", "epoch"], out="p", groups_bound=2 * K)
    return o.select("fold", "epoch", ((F.col("p") + 1) * 25 - 1).alias("step"),
                    r6(bce_with_logits(F.col("logit"), F.col("label").cast("double"))).alias("loss"),
                    (decide(F.col("logit")) == F.col("label")).cast("double").alias("accuracy"))


@query("best_checkpoint", f"""
WITH {SQL_SCORED},
lg AS (SELECT fold, CASE WHEN model = 'presence' THEN 0 ELSE 1 END AS epoch, row_id, label, logit FROM oof),
lg2 AS (SELECT fold, epoch, (row_number() OVER (PARTITION BY fold, epoch ORDER BY md5('{SEED}|' || epoch || '|' || row_id), row_id)) * 25 - 1 AS step,
               round({SQL_BCE}, 6) AS loss, CASE WHEN (logit > 0) = (label = 1) THEN 1.0 ELSE 0.0 END AS accuracy FROM lg),
cand AS (
  SELECT 'a' AS rule, fold, epoch, step, loss AS metric, loss AS k FROM lg2 WHERE step BETWEEN 400 AND 600
  UNION ALL SELECT 'b', fold, epoch, step, loss, loss FROM lg2 WHERE epoch > 0 AND (step + 1) % 100 = 0
  UNION ALL SELECT 'c', fold, epoch, step, accuracy, -accuracy FROM lg2 WHERE step >= 400 AND (step + 1) % 1000 = 0
  UNION ALL SELECT 'd', fold, epoch, step, loss, loss FROM lg2 WHERE (step + 1) % 100 = 0),
best AS (SELECT *, row_number() OVER (PARTITION BY rule, fold ORDER BY k, epoch, step) AS rn FROM cand)
SELECT rule, CAST(fold AS BIGINT) AS fold, CAST(epoch AS BIGINT) AS epoch, CAST(step AS BIGINT) AS step, round(metric, 6) AS metric
FROM best WHERE rn = 1
""")
def q_best_checkpoint(spark, d):
    rules = {rule: "accuracy" if rule == "c" else "loss" for rule in "abcd"}
    b = metrics.best_checkpoints(validation_log(spark, d), rules, centre=500, radius=100)
    return b.select("rule", F.col("fold").cast("bigint").alias("fold"), F.col("epoch").cast("bigint").alias("epoch"),
                    F.col("step").cast("bigint").alias("step"), r6(F.col("metric")).alias("metric"))


# ---------------------------------------------------------------- I: fold models and pseudo-label cycles (rows-only)


def _sql_student(p: str, mix: str) -> str:
    """CTEs ``{p}_sw(fold, token, w)`` and ``{p}_sb(fold, b)``: a per-fold naive-Bayes student
    fitted on ``{mix}(fold, row_id, label, mult)``, ``mult`` = copies of the row."""
    return f"""
{p}_mocc AS (SELECT m.fold, m.label, m.mult, t.token
             FROM {mix} m JOIN (SELECT row_id, unnest(toks) AS token FROM alltoks) t ON t.row_id = m.row_id
             WHERE t.token IN (SELECT token FROM vocab)),
{p}_grid AS (SELECT i AS fold, token FROM vocab, range({K}) r(i)),
{p}_cnt AS (SELECT g.fold, g.token, coalesce(sum(o.mult) FILTER (WHERE o.label = 0), 0) AS c0,
                   coalesce(sum(o.mult) FILTER (WHERE o.label = 1), 0) AS c1
            FROM {p}_grid g LEFT JOIN {p}_mocc o ON o.fold = g.fold AND o.token = g.token GROUP BY g.fold, g.token),
{p}_tot AS (SELECT fold, sum(c0) AS N0, sum(c1) AS N1 FROM {p}_cnt GROUP BY fold),
{p}_n AS (SELECT fold, sum(mult) FILTER (WHERE label = 0) AS n0, sum(mult) FILTER (WHERE label = 1) AS n1
          FROM {mix} GROUP BY fold),
{p}_sw AS (SELECT c.fold, c.token,
                  CAST(round((ln((c.c1 + 1) / (t.N1 + v.V)) - ln((c.c0 + 1) / (t.N0 + v.V))) * 1000) AS BIGINT) AS w
           FROM {p}_cnt c JOIN {p}_tot t ON t.fold = c.fold, vsz v),
{p}_sb AS (SELECT fold, CAST(round(ln(n1 / n0) * 1000) AS BIGINT) AS b FROM {p}_n)
"""


def _sql_student_eval(p: str) -> str:
    """Accuracy of student ``p`` on the labelled rows of its own fold."""
    return f"""
lt AS (SELECT row_id, token, count(*) AS tf FROM (SELECT row_id, unnest(toks) AS token FROM lrows) GROUP BY ALL),
ssum AS (SELECT t.row_id, w.fold, sum(t.tf * w.w) AS sm FROM lt t JOIN {p}_sw w ON w.token = t.token GROUP BY ALL),
ls AS (SELECT f.row_id, f.kfold, f.label, sb.b + coalesce(ss.sm, 0) AS lm
       FROM folded f JOIN {p}_sb sb ON sb.fold = f.kfold LEFT JOIN ssum ss ON ss.row_id = f.row_id AND ss.fold = f.kfold)
SELECT CAST(kfold AS BIGINT) AS fold, round(avg(CASE WHEN (lm > 0) = (label = 1) THEN 1 ELSE 0 END), 6) AS accuracy,
       count(*) AS n_rows
FROM ls GROUP BY kfold
"""


def _sql_student_accuracy(mix_ctes: str) -> str:
    """Oracle for one cycle: student fitted on ``mix``, evaluated per fold."""
    return f"WITH {SQL_SCORED},\n{mix_ctes},\n{_sql_student('s1', 'mix')},\n{_sql_student_eval('s1')}"


SQL_MIX_FOLD_WISE = f"""
ps AS (SELECT fold, row_id, CASE WHEN avg(logit_milli) > 0 THEN 1 ELSE 0 END AS label
       FROM xscored WHERE model = 'nb' GROUP BY fold, row_id),
mix AS (SELECT fold, row_id, label, 1 AS mult FROM ps
        UNION ALL
        SELECT r.i AS fold, f.row_id, f.label, {3} AS mult FROM folded f, range({K}) r(i) WHERE f.kfold <> r.i)
"""

SQL_MIX_AVERAGED = f"""
fl AS (SELECT row_id, fold, avg(logit_milli) AS target FROM xscored WHERE model = 'nb' GROUP BY row_id, fold),
avgp AS (SELECT row_id, CASE WHEN count(target) = {K} AND count(*) = {K} THEN sum(target) / {K} END AS target
         FROM fl GROUP BY row_id),
mix AS (SELECT r.i AS fold, p.row_id, CASE WHEN p.target > 0 THEN 1 ELSE 0 END AS label, 1 AS mult
        FROM avgp p, range({K}) r(i) WHERE p.target IS NOT NULL)
"""


def _student_accuracy(train: DataFrame, weights: DataFrame) -> DataFrame:
    """OOF accuracy of per-fold students on the labelled rows of their own fold."""
    s = scoring.score_linear(train.select("row_id", "toks"), "toks", weights, weights_bound=(VOCAB + 1) * K)
    a = metrics.oof_accuracy(s, train, "label", by=())
    return a.select(F.col("fold").cast("bigint"), r6(F.col("accuracy")).alias("accuracy"), "n_rows")


def _cycle_inputs(spark, d):
    train = folded_tokens(spark, d)
    extra = stored(extra_rows(spark, d).select("row_id", "toks"), "extra-tokens")
    v = vocab(spark, d)
    return train, extra, model_weights(spark, d, train, v).filter(F.col("model") == "nb"), v


@query("oof_ml")
def q_oof_ml(spark, d):
    from ..operators import cycles

    f = folded(spark, d).withColumn("toks", tokens.tokenize(F.col("text")))
    p = cycles.fit_folds(f, "toks", "label", k=K)
    return p.select(F.col("row_id").cast("bigint").alias("doc_id"), F.col("fold").cast("bigint"), "logit")


@query("pseudo_cycle", _sql_student_accuracy(SQL_MIX_FOLD_WISE))
def q_pseudo_cycle(spark, d):
    from ..operators import cycles

    train, extra, teacher, v = _cycle_inputs(spark, d)
    return _student_accuracy(train, cycles.pseudo_cycle(train, extra, teacher, v, k=K))


@query("pseudo_single", _sql_student_accuracy(SQL_MIX_AVERAGED))
def q_pseudo_single(spark, d):
    from ..operators import cycles

    train, extra, teacher, v = _cycle_inputs(spark, d)
    return _student_accuracy(train, cycles.pseudo_single(train, extra, teacher, v, k=K))


SQL_RUN_CYCLES = f"""WITH {SQL_SCORED},
{SQL_MIX_FOLD_WISE},
{_sql_student('s1', 'mix')},
x2_tf AS (SELECT row_id, token, count(*) AS tf FROM (SELECT row_id, unnest(toks) AS token FROM xrows) GROUP BY ALL),
x2_sum AS (SELECT t.row_id, w.fold, sum(t.tf * w.w) AS sm FROM x2_tf t JOIN s1_sw w ON w.token = t.token GROUP BY ALL),
x2 AS (SELECT r.row_id, b.fold, b.b + coalesce(s.sm, 0) AS logit_milli
       FROM xrows r CROSS JOIN s1_sb b LEFT JOIN x2_sum s ON s.row_id = r.row_id AND s.fold = b.fold),
fl2 AS (SELECT row_id, fold, avg(logit_milli) AS target FROM x2 GROUP BY row_id, fold),
avgp2 AS (SELECT row_id, CASE WHEN count(target) = {K} AND count(*) = {K} THEN sum(target) / {K} END AS target
          FROM fl2 GROUP BY row_id),
mix2 AS (SELECT r.i AS fold, p.row_id, CASE WHEN p.target > 0 THEN 1 ELSE 0 END AS label, 1 AS mult
         FROM avgp2 p, range({K}) r(i) WHERE p.target IS NOT NULL),
{_sql_student('s2', 'mix2')},
{_sql_student_eval('s2')}"""


@query("run_cycles", SQL_RUN_CYCLES)
def q_run_cycles(spark, d):
    from ..operators import cycles

    train, extra, teacher, v = _cycle_inputs(spark, d)
    w = cycles.run_cycles(["fold_wise", "averaged"], train, extra, teacher, v, k=K)
    return _student_accuracy(train, w)


@query("scores_checked", f"""
WITH {SQL_SCORED}
SELECT model, count(*) AS n_predictions, CAST({K} * (SELECT count(*) FROM labelled) AS BIGINT) AS n_expected,
       CAST({K} * (SELECT count(*) FROM labelled) - count(*) AS BIGINT) AS n_missing, CAST(0 AS BIGINT) AS n_repeated
FROM lscored WHERE NOT (fold = 1 AND CAST(row_id AS BIGINT) % 10 = 0) GROUP BY model
""")
def q_scores_checked(spark, d):
    """Padding rows (every seventh prediction comes twice) are dropped, and what lacks (one fold of every tenth
    row) is counted."""
    f = folded_tokens(spark, d)
    s = scores_of(spark, d, f).select("row_id", "model", "fold", "logit")
    doc = F.col("row_id").cast("bigint")
    s = s.filter(~((F.col("fold") == 1) & (doc % 10 == 0)))
    padded = s.select("*", F.explode(F.sequence(F.lit(1), F.when(doc % 7 == 0, 2).otherwise(1))).alias("copy")).drop("copy")
    return scoring.completeness(scoring.drop_padding(padded), f.select("row_id"), K)
