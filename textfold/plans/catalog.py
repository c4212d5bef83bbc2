"""Registered queries over the driver tables, each paired with an independent SQL oracle.

Every query reads whole tables (no id subsets, no row caps) and returns a flat
DataFrame: integers as bigint, doubles rounded to 6 digits, arrays joined to
strings, so the SQL restatement can be compared value by value.

Stand-ins (see FIXTURES.md): passage = ``documents.text``; regression target =
``documents.n_chars``; class label = ``labels.quality``; category = ``labels.toxic``;
sentence pairs = a user turn followed by the assistant turn in ``conversations``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.hashing import hash_key
from ..functions.text import TOKEN_PATTERN
from ..operators import batching, filters, folds, textprep
from .partitioning import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

SEED = 42
K = 5


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


# ---------------------------------------------------------------- inputs

# Unique keys of the driver tables that carry per-row work (conversations: a conversation may be
# huge, so key by turn too). Small side tables such as labels are joined by broadcast, unspread.
TABLE_KEYS = {"documents": ["doc_id"], "conversations": ["conv_id", "turn"],
              "orders": ["o_orderkey"], "events": ["event_id"], "benchmark": ["item_id"]}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{d}/{name}.parquet")
    keys = TABLE_KEYS.get(name)
    return spread(df, keys) if keys else df


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").withColumn("row_id", F.col("doc_id").cast("string"))


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents; of rows with one text and label only that with the smallest ``row_id``, so that no copy is in
    another fold (D3 before the folds). The labels to keep are found by digests; texts meet them in one join."""
    lab = table(spark, d, "labels").select("doc_id", F.col("quality").alias("label"), "toxic")
    rows = docs(spark, d)
    digests = rows.select("doc_id", "row_id", F.md5("text").alias("digest")).join(lab.select("doc_id", "label"), "doc_id")
    first = digests.groupBy("digest", "label").agg(F.min("row_id").cast(rows.schema["doc_id"].dataType).alias("doc_id"))
    kept = rows.join(lab.join(first.select("doc_id"), "doc_id", "left_semi"), "doc_id")
    return kept.select("row_id", *[c for c in kept.columns if c != "row_id"])


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """A user turn followed by the assistant turn; keyed ``conv_id:turn`` (join on both keys: no skew)."""
    c = table(spark, d, "conversations")
    u = c.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("text_a"))
    a = c.filter(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"),
                                                      F.col("text").alias("text_b"))
    p = u.join(a, ["conv_id", "turn"])
    return p.withColumn("row_id", F.concat_ws(":", "conv_id", "turn"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder, for rows that several jobs of a query read."""
    path = _fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def folded(spark: SparkSession, d: str) -> DataFrame:
    return folds.assign_folds(labelled(spark, d), "label", k=K, seed=SEED)


SQL_PAIRS = """
pairs AS (
  SELECT u.conv_id, u.turn, CAST(u.conv_id AS VARCHAR) || ':' || CAST(u.turn AS VARCHAR) AS row_id,
         u.text AS text_a, a.text AS text_b
  FROM conversations u JOIN conversations a
    ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  WHERE u.role = 'user')
"""


def sql_folds(src: str, stratum: str, key: str, out: str = "folded", k: int = K, seed: int = SEED) -> str:
    """Stratified k-fold restated with plain window functions (one partition per class)."""
    return f"""
{out}_keyed AS (SELECT *, md5('{seed}|' || {key}) AS __k FROM {src}),
{out}_cls AS (SELECT {stratum} AS __c, count(*) AS __n, min(__k) AS __first FROM {out}_keyed GROUP BY {stratum}),
{out}_cls2 AS (SELECT __c, __n, coalesce(sum(__n) OVER (ORDER BY __first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS __s
               FROM {out}_cls),
{out}_alloc AS (SELECT __c, i, floor((__s + __n - 1 - i) / {k}) - floor((__s - 1 - i) / {k}) AS q
                FROM {out}_cls2, range({k}) r(i)),
{out}_cum AS (SELECT __c, i, sum(q) OVER (PARTITION BY __c ORDER BY i) - q AS lo,
                     sum(q) OVER (PARTITION BY __c ORDER BY i) AS hi FROM {out}_alloc),
{out}_rank AS (SELECT *, row_number() OVER (PARTITION BY {stratum} ORDER BY __k, {key}) - 1 AS __r FROM {out}_keyed),
{out} AS (SELECT r.* EXCLUDE (__k, __r), CAST(c.i AS INTEGER) AS kfold
          FROM {out}_rank r JOIN {out}_cum c ON r.{stratum} IS NOT DISTINCT FROM c.__c AND r.__r >= c.lo AND r.__r < c.hi
          WHERE (SELECT max(__n) FROM {out}_cls) >= {k})
"""


SQL_LABELLED = """
labelled AS (SELECT d.doc_id, CAST(d.doc_id AS VARCHAR) AS row_id, d.text, d.lang, d.source, d.n_chars,
                    l.quality AS label, l.toxic
             FROM documents d JOIN labels l ON d.doc_id = l.doc_id
             QUALIFY row_number() OVER (PARTITION BY d.text, l.quality ORDER BY CAST(d.doc_id AS VARCHAR)) = 1)
"""


# ---------------------------------------------------------------- E: folds, shuffles, batches

@query("folds_label", f"""
WITH {SQL_LABELLED}, {sql_folds('labelled', 'label', 'row_id')}
SELECT doc_id, label, CAST(kfold AS BIGINT) AS kfold FROM folded
""")
def q_folds_label(spark, d):
    return folded(spark, d).select("doc_id", "label", F.col("kfold").cast("bigint").alias("kfold"))


@query("folds_events", f"""
WITH ev AS (SELECT event_id, event_type, CAST(event_id AS VARCHAR) AS row_id FROM events),
{sql_folds('ev', 'event_type', 'row_id')}
SELECT event_id, event_type, CAST(kfold AS BIGINT) AS kfold FROM folded
""")
def q_folds_events(spark, d):
    ev = table(spark, d, "events").select("event_id", "event_type",
                                          F.col("event_id").cast("string").alias("row_id"))
    f = folds.assign_folds(ev, "event_type", k=K, seed=SEED)
    return f.select("event_id", "event_type", F.col("kfold").cast("bigint").alias("kfold"))


@query("fold_split", f"""
WITH {SQL_LABELLED}, {sql_folds('labelled', 'label', 'row_id')}
SELECT doc_id, CAST(i AS BIGINT) AS fold, CASE WHEN kfold = i THEN 'val' ELSE 'train' END AS part
FROM folded, range({K}) r(i)
""")
def q_fold_split(spark, d):
    a = folds.all_folds(folded(spark, d), k=K)
    return a.select("doc_id", F.col("fold").cast("bigint").alias("fold"), "part")


@query("fold_range", f"""
WITH {SQL_LABELLED}, {sql_folds('labelled', 'label', 'row_id')}
SELECT doc_id, CAST(kfold AS BIGINT) AS kfold FROM folded WHERE kfold >= 2
""")
def q_fold_range(spark, d):
    return folds.fold_range(folded(spark, d), 2).select("doc_id", F.col("kfold").cast("bigint").alias("kfold"))


@query("shuffle_order", f"""
SELECT doc_id, row_number() OVER (ORDER BY md5('{SEED}|' || CAST(doc_id AS VARCHAR)), CAST(doc_id AS VARCHAR)) - 1 AS position
FROM documents
""")
def q_shuffle_order(spark, d):
    return folds.shuffle_positions(docs(spark, d), SEED).select("doc_id", "position")


@query("epoch_order", f"""
SELECT doc_id, row_number() OVER (ORDER BY md5('{SEED}|3|' || CAST(doc_id AS VARCHAR)), CAST(doc_id AS VARCHAR)) - 1 AS position
FROM documents
""")
def q_epoch_order(spark, d):
    return folds.epoch_order(docs(spark, d), SEED, 3).select("doc_id", "position")


@query("batches", f"""
SELECT doc_id, position, CAST(floor(position / 32) AS BIGINT) AS batch FROM (
  SELECT doc_id, row_number() OVER (ORDER BY md5('{SEED}|1|' || CAST(doc_id AS VARCHAR)), CAST(doc_id AS VARCHAR)) - 1 AS position
  FROM documents)
""")
def q_batches(spark, d):
    dd = docs(spark, d).withColumn("k", hash_key(F.lit(SEED), F.lit(1), F.col("row_id")))
    return batching.assign_batches(dd, "k", 32).select("doc_id", "position", "batch")


@query("sturges_bins", """
SELECT count(*) AS n_rows, CAST(floor(1 + log2(count(*))) AS BIGINT) AS n_bins FROM documents
""")
def q_sturges(spark, d):
    dd = docs(spark, d)
    return dd.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", folds.sturges_bins(dd).cast("bigint").alias("n_bins"))


SQL_CUT = """
stats AS (SELECT min(n_chars)::DOUBLE AS mn, max(n_chars)::DOUBLE AS mx, floor(1 + log2(count(*))) AS k FROM documents),
binned AS (SELECT d.*, CAST(CASE WHEN s.mx = s.mn THEN ceil(s.k / 2.0) - 1
                     ELSE greatest(ceil((d.n_chars - s.mn) * s.k / (s.mx - s.mn)) - 1, 0) END AS INTEGER) AS bin,
                  CAST(d.doc_id AS VARCHAR) AS row_id
           FROM documents d, stats s)
"""


@query("cut_bins", f"""
WITH {SQL_CUT}
SELECT doc_id, n_chars, CAST(bin AS BIGINT) AS bin FROM binned
""")
def q_cut(spark, d):
    dd = docs(spark, d)
    return folds.cut(dd, "n_chars", folds.sturges_bins(dd)).select(
        "doc_id", "n_chars", F.col("bin").cast("bigint").alias("bin"))


@query("folds_regression", f"""
WITH {SQL_CUT}, {sql_folds('binned', 'bin', 'row_id')}
SELECT doc_id, CAST(kfold AS BIGINT) AS kfold FROM folded
""")
def q_folds_regression(spark, d):
    f = folds.assign_folds_regression(docs(spark, d), "n_chars", k=K, seed=SEED)
    return f.select("doc_id", F.col("kfold").cast("bigint").alias("kfold"))


@query("folds_regression_orders", f"""
WITH st AS (SELECT min(o_totalprice) AS mn, max(o_totalprice) AS mx, floor(1 + log2(count(*))) AS k FROM orders),
binned AS (SELECT o.o_orderkey, CAST(o.o_orderkey AS VARCHAR) AS row_id,
                  CAST(CASE WHEN st.mx = st.mn THEN ceil(st.k / 2.0) - 1
                       ELSE greatest(ceil((o.o_totalprice - st.mn) * st.k / (st.mx - st.mn)) - 1, 0) END AS INTEGER) AS bin
           FROM orders o, st),
{sql_folds('binned', 'bin', 'row_id')}
SELECT o_orderkey, CAST(kfold AS BIGINT) AS kfold FROM folded
""")
def q_folds_regression_orders(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice",
                                         F.col("o_orderkey").cast("string").alias("row_id"))
    f = folds.assign_folds_regression(o, "o_totalprice", k=K, seed=SEED)
    return f.select("o_orderkey", F.col("kfold").cast("bigint").alias("kfold"))


# ---------------------------------------------------------------- B: text preparation

@query("paragraphs", r"""
SELECT doc_id, CAST(generate_subscripts(p, 1) - 1 AS BIGINT) AS para_no, unnest(p) AS paragraph
FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)
""")
def q_paragraphs(spark, d):
    p = textprep.split_paragraphs(docs(spark, d).select("doc_id", "text"), "text", sep="\n")
    return p.select("doc_id", F.col("para_no").cast("bigint").alias("para_no"), "paragraph")


@query("drop_title", r"""
SELECT doc_id, CASE WHEN strpos(text, chr(10)) = 0 THEN '' ELSE substr(text, strpos(text, chr(10)) + 1) END AS body
FROM documents
""")
def q_drop_title(spark, d):
    return docs(spark, d).select("doc_id", textprep.drop_first_line(F.col("text")).alias("body"))


@query("chunks", """
SELECT doc_id, CAST(i AS BIGINT) AS chunk_no, substring(text, i * 1000 + 1, 1000) AS chunk
FROM documents, LATERAL unnest(range(0, CAST(ceil(length(text) / 1000.0) AS BIGINT))) u(i)
WHERE length(text) > 0
""")
def q_chunks(spark, d):
    c = textprep.chunk_text(docs(spark, d).select("doc_id", "text"), "text", 1000)
    return c.select("doc_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), "chunk")


@query("chunk_stream", """
WITH d AS (SELECT doc_id, text, length(text) AS len,
                  CAST(coalesce(sum(length(text)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS g
           FROM documents),
chars AS (SELECT w, d.doc_id, d.text, d.g, d.len,
                 greatest(w * 1000, d.g) AS st, least((w + 1) * 1000, d.g + d.len) AS en
          FROM d, LATERAL unnest(range(d.g // 1000, (d.g + d.len - 1) // 1000 + 1)) u(w)
          WHERE d.len > 0)
SELECT CAST(w AS BIGINT) AS chunk_no, string_agg(substring(text, st - g + 1, en - st), '' ORDER BY st) AS chunk
FROM chars GROUP BY w
""")
def q_chunk_stream(spark, d):
    from .ordering import range_buckets, with_range_bucket

    dd = docs(spark, d).select("doc_id", "text")
    splits, _ = range_buckets(dd.select("doc_id"), ["doc_id"])
    dd = with_range_bucket(dd, "doc_id", splits, out="b")
    c = textprep.chunk_stream(dd, "text", F.col("b"), [F.col("doc_id")], size=1000, groups_bound=1,
                              buckets_bound=len(splits) + 1)
    return c.select(F.col("chunk_no").cast("bigint").alias("chunk_no"), "chunk")


@query("quotes", """
SELECT doc_id, replace(replace(text, '`', ''''), '''''', '"') AS text FROM documents
""")
def q_quotes(spark, d):
    return textprep.quotes(docs(spark, d).select("doc_id", "text"), "text")


@query("union_corpora", """
SELECT 'chunks' AS source, substring(text, i * 1000 + 1, 1000) AS excerpt
FROM documents, LATERAL unnest(range(0, CAST(ceil(length(text) / 1000.0) AS BIGINT))) u(i)
WHERE length(text) > 0
UNION ALL
SELECT 'benchmark' AS source, replace(replace(text, '`', ''''), '''''', '"') AS excerpt FROM benchmark
""")
def q_union_corpora(spark, d):
    ch = textprep.chunk_text(docs(spark, d).select("doc_id", "text"), "text", 1000).select(
        F.col("chunk").alias("excerpt"))
    bm = textprep.quotes(table(spark, d, "benchmark"), "text").select(F.col("text").alias("excerpt"))
    return textprep.union_corpora({"chunks": ch, "benchmark": bm})


@query("coerce_text", """
SELECT d.doc_id, coalesce(CAST(l.quality AS VARCHAR), 'nan') AS quality_text
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
""")
def q_coerce_text(spark, d):
    lab = table(spark, d, "labels").select("doc_id", "quality")
    j = table(spark, d, "documents").select("doc_id").join(lab, "doc_id", "left")
    return textprep.coerce_text(j, ["quality"]).select("doc_id", F.col("quality").alias("quality_text"))


# ---------------------------------------------------------------- C / D: filters and set operations

@query("pairs_nonempty", f"""
WITH {SQL_PAIRS}
SELECT row_id, text_a, text_b FROM pairs WHERE length(text_a) > 0 AND length(text_b) > 0
""")
def q_pairs_nonempty(spark, d):
    return filters.non_empty(pairs(spark, d), ["text_a", "text_b"]).select("row_id", "text_a", "text_b")


@query("drop_nulls", """
SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
WHERE l.quality IS NOT NULL AND l.toxic IS NOT NULL
""")
def q_drop_nulls(spark, d):
    lab = table(spark, d, "labels").select("doc_id", "quality", "toxic")
    j = table(spark, d, "documents").select("doc_id").join(lab, "doc_id", "left")
    return filters.drop_nulls(j)


@query("length_band", f"""
WITH {SQL_PAIRS},
t AS (SELECT row_id, len(regexp_extract_all(text_a, '{TOKEN_PATTERN}')) + len(regexp_extract_all(text_b, '{TOKEN_PATTERN}')) + 3 AS n_tokens
      FROM pairs)
SELECT row_id, CAST(n_tokens AS BIGINT) AS n_tokens FROM t WHERE n_tokens > 32 AND n_tokens <= 128
""")
def q_length_band(spark, d):
    from ..operators.tokens import token_length, tokenize

    p = pairs(spark, d).withColumn("n_tokens", token_length(tokenize(F.col("text_a")), tokenize(F.col("text_b"))))
    return filters.length_between(p, "n_tokens", 32, 128).select("row_id", F.col("n_tokens").cast("bigint"))


@query("exclude_category", f"""
WITH {SQL_LABELLED}
SELECT doc_id, toxic AS category FROM labelled WHERE toxic IS DISTINCT FROM 1
""")
def q_exclude_category(spark, d):
    lab = labelled(spark, d).select("doc_id", F.col("toxic").alias("category"))
    return filters.exclude_category(lab, 1, "category")


@query("head_fraction", """
SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS r, count(*) OVER () AS n FROM documents)
WHERE r < floor(n / 100)
""")
def q_head_fraction(spark, d):
    return filters.head_fraction(docs(spark, d).select("doc_id"), 100, ["doc_id"])


@query("tag_source", """
SELECT doc_id, 0 AS category FROM documents WHERE lang = 'en'
UNION ALL SELECT doc_id, 1 AS category FROM documents WHERE lang <> 'en'
""")
def q_tag_source(spark, d):
    dd = table(spark, d, "documents")
    t = filters.tag_source({0: dd.filter(F.col("lang") == "en").select("doc_id"),
                            1: dd.filter(F.col("lang") != "en").select("doc_id")})
    return t.select("doc_id", F.col("category").cast("int"))


@query("mlm_pairs", f"""
WITH {SQL_PAIRS},
rev AS (SELECT a.text AS text_a, u.text AS text_b FROM conversations a JOIN conversations u
          ON u.conv_id = a.conv_id AND u.turn = a.turn + 1 AND u.role = 'user' WHERE a.role = 'assistant')
SELECT text_a, text_b FROM pairs UNION ALL SELECT text_a, text_b FROM rev
""")
def q_mlm_pairs(spark, d):
    c = table(spark, d, "conversations")
    a = c.filter(F.col("role") == "assistant").select("conv_id", "turn", F.col("text").alias("text_a"))
    u = c.filter(F.col("role") == "user").select("conv_id", (F.col("turn") - 1).alias("turn"),
                                                 F.col("text").alias("text_b"))
    unl = a.join(u, ["conv_id", "turn"])
    return filters.build_mlm_pairs(pairs(spark, d), unl)


@query("union_texts", """
SELECT text AS excerpt FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)
UNION ALL SELECT text AS excerpt FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
""")
def q_union_texts(spark, d):
    dd = table(spark, d, "documents").withColumnRenamed("text", "excerpt")
    lab = table(spark, d, "labels").select("doc_id")
    train = dd.join(lab, "doc_id", "left_semi")
    test = dd.join(lab, "doc_id", "left_anti")
    return filters.union_texts(train, test)


@query("dedup_docs", """
SELECT DISTINCT text, lang FROM documents
""")
def q_dedup_docs(spark, d):
    return filters.dedup(table(spark, d, "documents").select("text", "lang"))


@query("dedup_pairs", f"""
WITH {SQL_PAIRS}
SELECT DISTINCT text_a, text_b FROM pairs
""")
def q_dedup_pairs(spark, d):
    return filters.dedup(pairs(spark, d).select("text_a", "text_b"))


# ---------------------------------------------------------------- A: file round trips (written under the shared checkpoint folder)

def _fresh_path(spark: SparkSession, name: str) -> str:
    import uuid

    from ..session import table_path

    return table_path(spark, f"{name}-{uuid.uuid4().hex}")


@query("paragraph_file", """
SELECT text AS paragraph FROM documents
""")
def q_paragraph_file(spark, d):
    from .. import sources

    path = _fresh_path(spark, "paragraphs")
    table(spark, d, "documents").select("text").write.option("lineSep", "\n\n").text(path)
    return sources.read_paragraphs(spark, path).select(F.col("text").alias("paragraph"))


@query("csv_roundtrip", f"""
WITH {SQL_LABELLED}
SELECT doc_id, text, label FROM labelled
""")
def q_csv_roundtrip(spark, d):
    from .. import sources

    path = _fresh_path(spark, "labelled-csv")
    sources.write_table(labelled(spark, d).select("doc_id", "text", "label"), path, fmt="csv")
    return sources.read_labeled_csv(spark, path, "doc_id bigint, text string, label int")


@query("tsv_pairs", f"""
WITH {SQL_PAIRS}
SELECT replace(replace(text_a, chr(10), ' '), chr(9), ' ') AS text_a,
       replace(replace(text_b, chr(10), ' '), chr(9), ' ') AS text_b FROM pairs
""")
def q_tsv_pairs(spark, d):
    from .. import sources

    path = _fresh_path(spark, "pairs-tsv")
    flat = [F.translate(F.translate(F.col(c), "\n", " "), "\t", " ") for c in ("text_a", "text_b")]
    pairs(spark, d).select(F.concat_ws("\t", *flat).alias("value")).write.text(path)
    return sources.read_unlabeled_pairs(spark, path).select("text_a", "text_b")


@query("fold_label_files", f"""
WITH {SQL_LABELLED}, {sql_folds('labelled', 'label', 'row_id')}
SELECT doc_id, CAST(kfold AS BIGINT) AS fold, CAST(label AS DOUBLE) AS target FROM folded
""")
def q_fold_label_files(spark, d):
    from .. import sources

    path = _fresh_path(spark, "fold-labels")
    f = folded(spark, d).select("doc_id", F.col("kfold").alias("fold"), F.col("label").cast("double").alias("target"))
    sources.write_fold_labels(f, path)
    back = spark.read.parquet(path)
    return back.select("doc_id", F.col("fold").cast("bigint"), "target")


# ---------------------------------------------------------------- H on the regression line: per-fold training-mean baseline

def regression_oof(spark: SparkSession, d: str) -> DataFrame:
    """Regression folds (E4) on ``n_chars``; every row is predicted by the mean target of the
    training rows of its fold (``kfold <> f``), from a k-row statistics table."""
    from ..operators import metrics  # noqa: F401

    f = folds.assign_folds_regression(docs(spark, d).select("row_id", "doc_id", "n_chars"), "n_chars", k=K, seed=SEED)
    st = f.groupBy("kfold").agg(F.sum("n_chars").alias("s"), F.count(F.lit(1)).alias("n"))
    ts, tn = st.select(F.sum("s")).scalar(), st.select(F.sum("n")).scalar()
    means = st.select("kfold", ((ts - F.col("s")) / (tn - F.col("n"))).alias("pred"))  # k rows
    return f.join(F.broadcast(means), "kfold").withColumn("y", F.col("n_chars").cast("double"))


SQL_REG_OOF = f"""
{SQL_CUT}, {sql_folds('binned', 'bin', 'row_id')},
st AS (SELECT kfold, sum(n_chars) AS s, count(*) AS n FROM folded GROUP BY kfold),
m AS (SELECT kfold, ((SELECT sum(s) FROM st) - s) / ((SELECT sum(n) FROM st) - n) AS pred FROM st),
o AS (SELECT f.row_id, f.kfold, CAST(f.n_chars AS DOUBLE) AS y, m.pred FROM folded f JOIN m ON m.kfold = f.kfold)
"""


@query("rmse_regression", f"""
WITH {SQL_REG_OOF}
SELECT CAST(kfold AS BIGINT) AS fold, count(*) AS n_rows, round(sqrt(avg(pow(y - pred, 2))), 6) AS rmse
FROM o GROUP BY kfold
""")
def q_rmse_regression(spark, d):
    from ..operators import metrics

    o = regression_oof(spark, d)
    r = metrics.rmse(o, "pred", "y", by=["kfold"])
    n = o.groupBy("kfold").agg(F.count(F.lit(1)).alias("n_rows"))
    return r.join(n, "kfold").select(F.col("kfold").cast("bigint").alias("fold"), "n_rows",
                                    F.round("rmse", 6).alias("rmse"))


@query("batch_rmse_regression", f"""
WITH {SQL_REG_OOF},
b AS (SELECT *, (row_number() OVER (PARTITION BY kfold ORDER BY md5('{SEED}|' || row_id), row_id) - 1) // 16 AS batch FROM o),
s AS (SELECT kfold, batch, sum(pow(y - pred, 2)) AS sse FROM b GROUP BY ALL)
SELECT CAST(kfold AS BIGINT) AS fold, round(sqrt(avg(sse)), 6) AS batch_rmse FROM s GROUP BY kfold
""")
def q_batch_rmse_regression(spark, d):
    from ..operators import metrics

    o = regression_oof(spark, d).withColumn("k", hash_key(F.lit(SEED), F.col("row_id")))
    r = metrics.batch_rmse(o, "pred", "y", 16, "k", by=["kfold"])
    return r.select(F.col("kfold").cast("bigint").alias("fold"), F.round("batch_rmse", 6).alias("batch_rmse"))


@query("line_files", r"""
SELECT unnest(string_split(text, chr(10))) AS line FROM documents
""")
def q_line_files(spark, d):
    """A2: the documents written as text files and read back line by line in a given file order;
    every line must come back exactly once, whatever the file splits."""
    from .. import sources

    path = _fresh_path(spark, "lines")
    table(spark, d, "documents").select("text").write.text(path)
    files = sorted(spark.read.text(path).inputFiles())
    lines = sources.read_lines(spark, files)
    return lines.select(F.col("text").alias("line"))
