"""Registered queries of the regression cycles (I1-I4, D4) and of the file and ingestion chains, with SQL oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from .. import sources
from ..functions.text import TOKEN_PATTERN
from ..operators import distill, filters, folds, scoring, tokens
from ..session import table_path
from .catalog import K, SEED, SQL_LABELLED, SQL_PAIRS, docs, folded, labelled, pairs, query, sql_folds, stored, table
from .ordering import ordered_prefix
from .partitioning import bucketed

TIMES = 3


def fresh(spark, name: str) -> str:
    return table_path(spark, f"{name}-{uuid.uuid4().hex}")


# ---------------------------------------------------------------- regression cycles: target n_chars, in thousandths

def _cycle_rows(spark, d, train_by_row: bool = False) -> tuple[DataFrame, DataFrame]:
    """Training and extra rows from one table of all documents' tokens, in buckets of ``row_id``: labels and folds come to it, texts are shuffled once.
    ``train_by_row``: the training rows in buckets too."""
    key = F.col("doc_id").cast("string").alias("row_id")
    texts = spark.read.parquet(f"{d}/documents.parquet").select(key, "n_chars", "text")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = texts.repartition(n, "row_id").select("row_id", "n_chars", F.md5("text").alias("digest"), F.array_distinct(tokens.tokenize(F.col("text"))).alias("toks"))
    rows = bucketed(rows, "row_id", "cycle_rows")
    labels = table(spark, d, "labels").select(key, F.col("quality").alias("label"))
    lab = rows.join(labels.hint("shuffle_hash"), "row_id")
    first = lab.groupBy("digest", "label").agg(F.min("row_id").alias("row_id")).select("row_id")  # as in ``labelled``
    lab = lab.join(first.hint("shuffle_hash"), "row_id", "left_semi").select("row_id", "n_chars", "toks")
    f = folds.assign_folds_regression(lab, "n_chars", k=K, seed=SEED)
    train = f.select("row_id", "toks", "kfold", (F.col("n_chars") * 1000).cast("bigint").alias("target"))
    extra = rows.join(labels.select("row_id").hint("shuffle_hash"), "row_id", "left_anti").select("row_id", "toks")
    return bucketed(train, "row_id", "cycle_train") if train_by_row else stored(train, "cycle-train"), extra


SQL_CYCLE_ROWS = f"""
{SQL_LABELLED},
st AS (SELECT min(n_chars)::DOUBLE AS mn, max(n_chars)::DOUBLE AS mx, floor(1 + log2(count(*))) AS k FROM labelled),
binned AS (SELECT d.row_id, d.doc_id, d.n_chars, d.text, CAST(CASE WHEN s.mx = s.mn THEN ceil(s.k / 2.0) - 1
                  ELSE greatest(ceil((d.n_chars - s.mn) * s.k / (s.mx - s.mn)) - 1, 0) END AS INTEGER) AS bin FROM labelled d, st s),
{sql_folds('binned', 'bin', 'row_id', 'rfolded')},
trow AS (SELECT row_id, kfold, n_chars * 1000 AS y, list_distinct(regexp_extract_all(text, '{TOKEN_PATTERN}')) AS toks FROM rfolded),
xrow AS (SELECT CAST(doc_id AS VARCHAR) AS row_id, list_distinct(regexp_extract_all(text, '{TOKEN_PATTERN}')) AS toks
         FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)),
ttok AS (SELECT row_id, kfold, y, unnest(toks) AS token FROM trow),
xtok AS (SELECT row_id, unnest(toks) AS token FROM xrow)
"""


def _sql_fit(m: str, labels: str | None, times: int | None, n_folds: int = K) -> str:
    """``{m}_v(fold, token, v)`` and ``{m}_b(fold, v)`` of a model fitted on pseudo labels and copies of training rows."""
    def part(train, pseudo, token):
        both = []
        if times:
            both.append(f"SELECT r.i AS fold{token.format('x')}, {times} * y AS s, {times} AS c FROM {train} x, range({n_folds}) r(i) WHERE kfold <> r.i")
        if labels:
            both.append(f"SELECT l.fold{token.format('x')}, l.t AS s, 1 AS c FROM {pseudo} x JOIN {labels} l USING (row_id)")
        return " UNION ALL ".join(both)
    return f"""
{m}_v AS (SELECT fold, token, CAST(sum(s) // sum(c) AS BIGINT) AS v FROM ({part('ttok', 'xtok', ', {}.token')}) GROUP BY fold, token),
{m}_b AS (SELECT fold, CAST(sum(s) // sum(c) AS BIGINT) AS v FROM ({part('trow', 'xrow', '')}) GROUP BY fold)"""


def _sql_predict(out: str, m: str, rows: str, toks: str) -> str:
    return f"""
{out} AS (SELECT r.row_id, b.fold, CAST((coalesce(t.s, 0) + b.v) // (coalesce(t.n, 0) + 1) AS BIGINT) AS p
  FROM {rows} r CROSS JOIN {m}_b b LEFT JOIN (SELECT x.row_id, v.fold, sum(v.v) AS s, count(*) AS n
    FROM {toks} x JOIN {m}_v v ON v.token = x.token GROUP BY x.row_id, v.fold) t ON t.row_id = r.row_id AND t.fold = b.fold)"""


def _sql_average(out: str, labels: str, n_folds: int) -> str:
    return f"""
{out} AS (SELECT a.row_id, r.i AS fold, a.t FROM (SELECT row_id, CAST(sum(t) // {K} AS BIGINT) AS t FROM {labels} GROUP BY row_id) a, range({n_folds}) r(i))"""


def _sql_validate(cycle: int, stage: str, pred: str) -> str:
    own = "AND p.fold = x.kfold" if stage == "folds" else ""
    fold = "x.kfold" if stage == "folds" else "-1"
    return f"""SELECT {cycle} AS cycle, '{stage}' AS stage, CAST({fold} AS BIGINT) AS fold, count(*) AS n_rows,
       round(sqrt(avg(pow((x.y - p.p) / 1000.0, 2))), 6) AS rmse FROM trow x JOIN {pred} p ON p.row_id = x.row_id {own} GROUP BY 3"""


SQL_CYCLE_1 = f"""WITH {SQL_CYCLE_ROWS},
{_sql_fit('t0', None, 1)}, {_sql_predict('t0_tr', 't0', 'trow', 'ttok')}, {_sql_predict('t0_x', 't0', 'xrow', 'xtok')},
lab1 AS (SELECT row_id, fold, p AS t FROM t0_x),
{_sql_fit('s1', 'lab1', TIMES)}, {_sql_predict('s1_tr', 's1', 'trow', 'ttok')}"""

SQL_CYCLE_2 = f"""{SQL_CYCLE_1}, {_sql_predict('s1_x', 's1', 'xrow', 'xtok')},
lab2 AS (SELECT a.row_id, a.fold, CAST(floor(0.0::DOUBLE + 0.33::DOUBLE * a.p + 0.67::DOUBLE * b.p) AS BIGINT) AS t
         FROM t0_x a JOIN s1_x b USING (row_id, fold)),
{_sql_average('one2', 'lab2', 1)}, {_sql_average('avg2', 'lab2', K)},
{_sql_fit('g2', 'one2', None, 1)}, {_sql_predict('g2_tr', 'g2', 'trow', 'ttok')},
{_sql_fit('s2', 'avg2', TIMES)}, {_sql_predict('s2_tr', 's2', 'trow', 'ttok')}"""

SQL_CYCLE_3 = f"""{SQL_CYCLE_2}, {_sql_predict('s2_x', 's2', 'xrow', 'xtok')},
lab3 AS (SELECT a.row_id, a.fold, (a.p + b.p + c.p) // 3 AS t FROM t0_x a JOIN s1_x b USING (row_id, fold) JOIN s2_x c USING (row_id, fold)),
{_sql_average('one3', 'lab3', 1)}, {_sql_average('avg3', 'lab3', K)},
{_sql_fit('g3', 'one3', None, 1)}, {_sql_predict('g3_tr', 'g3', 'trow', 'ttok')},
{_sql_fit('s3', 'avg3', TIMES)}, {_sql_predict('s3_tr', 's3', 'trow', 'ttok')}"""


def _rmse_row(c: DataFrame) -> DataFrame:
    return c.select("cycle", "stage", F.col("fold").cast("bigint").alias("fold"), "n_rows", F.round("rmse", 6).alias("rmse"))


@query("pseudo_cycle_reg", f"""{SQL_CYCLE_1}
{_sql_validate(0, 'folds', 't0_tr')} UNION ALL {_sql_validate(1, 'folds', 's1_tr')}""")
def q_pseudo_cycle_reg(spark, d):
    """The teacher's and its fold-wise students' RMSE on the rows of their own fold."""
    train, extra = _cycle_rows(spark, d)
    teacher = distill.fit(distill._train_adds(train, K, 1), K, fresh(spark, "teacher"))
    labels = distill.teach(extra, [teacher])
    student = distill.fold_wise_student(teacher.sums, extra, labels, K, TIMES, fresh(spark, "student"))
    both = [distill.validate(train, m, True).select(F.lit(i).alias("cycle"), F.lit("folds").alias("stage"), "fold", "n_rows", "rmse")
            for i, m in enumerate((teacher, student))]
    return _rmse_row(both[0].unionByName(both[1]))


@query("run_cycles_reg", f"""{SQL_CYCLE_3}
{_sql_validate(0, 'folds', 't0_tr')} UNION ALL {_sql_validate(1, 'folds', 's1_tr')}
UNION ALL {_sql_validate(2, 'single', 'g2_tr')} UNION ALL {_sql_validate(2, 'folds', 's2_tr')}
UNION ALL {_sql_validate(3, 'single', 'g3_tr')} UNION ALL {_sql_validate(3, 'folds', 's3_tr')}""")
def q_run_cycles_reg(spark, d):
    """All three cycles with 1, 2 weighted and 3 averaged teachers."""
    train, extra = _cycle_rows(spark, d)
    return _rmse_row(distill.run_cycles(train, extra, K, TIMES, f"cycles-{uuid.uuid4().hex}"))


WARM_EPOCHS = 2


def _sql_warm(m: str, n: str) -> str:
    """Model ``n`` after one epoch from model ``m``, whose predictions of the training rows are ``{m}_tr``."""
    return f"""
{n}_r AS (SELECT x.row_id, p.fold, x.y - p.p AS r FROM trow x JOIN {m}_tr p ON p.row_id = x.row_id WHERE x.kfold <> p.fold),
{n}_v AS (SELECT v.fold, v.token, CAST(v.v + coalesce(g.g, 0) AS BIGINT) AS v FROM {m}_v v LEFT JOIN (
  SELECT r.fold, t.token, CAST(sum(r.r) AS BIGINT) // (2 * count(*)) AS g FROM ttok t JOIN {n}_r r ON r.row_id = t.row_id GROUP BY r.fold, t.token) g
  ON g.fold = v.fold AND g.token = v.token),
{n}_b AS (SELECT b.fold, CAST(b.v + coalesce(g.g, 0) AS BIGINT) AS v FROM {m}_b b LEFT JOIN (
  SELECT fold, CAST(sum(r) AS BIGINT) // (2 * count(*)) AS g FROM {n}_r GROUP BY fold) g ON g.fold = b.fold),
{_sql_predict(f'{n}_tr', n, 'trow', 'ttok')}"""


def _sql_epoch(epoch: int) -> str:
    return _sql_validate(epoch, "folds", f"w{epoch}_tr").replace(" AS cycle, 'folds' AS stage", " AS epoch").replace("GROUP BY 3", "GROUP BY 2")


@query("warm_start_reg", f"""{SQL_CYCLE_1},
{_sql_average('one1', 'lab1', 1)}, {_sql_fit('g1', 'one1', None, 1)},
w0_v AS (SELECT CAST(i AS BIGINT) AS fold, t.token, coalesce(g.v, b.v) AS v FROM (SELECT token FROM g1_v UNION SELECT token FROM ttok) t
         CROSS JOIN g1_b b CROSS JOIN range({K}) r(i) LEFT JOIN g1_v g ON g.token = t.token),
w0_b AS (SELECT CAST(i AS BIGINT) AS fold, v FROM g1_b, range({K}) r(i)),
{_sql_predict('w0_tr', 'w0', 'trow', 'ttok')}, {', '.join(_sql_warm(f'w{e - 1}', f'w{e}') for e in range(1, WARM_EPOCHS + 1))}
{' UNION ALL '.join(_sql_epoch(e) for e in range(WARM_EPOCHS + 1))}""")
def q_warm_start_reg(spark, d):
    """Fold models that go on from the single student's weights; RMSE of each fold's rows before and after each epoch."""
    train, extra = _cycle_rows(spark, d, train_by_row=True)
    teacher = distill.fit(distill._train_adds(train, K, 1), K, fresh(spark, "teacher"))
    single = distill.single_student(extra, distill.teach(extra, [teacher]), K, fresh(spark, "single"))
    models = distill.warm_start(train, single, K, WARM_EPOCHS, fresh(spark, "warm"))
    out = None
    for epoch, m in enumerate(models):
        v = distill.validate(train, m, True).select(F.lit(epoch).alias("epoch"), F.col("fold").cast("bigint").alias("fold"), "n_rows",
                                                    F.round("rmse", 6).alias("rmse"))
        out = v if out is None else out.unionByName(v)
    return out


@query("mix_pseudo", f"""
WITH {SQL_LABELLED}, {sql_folds('labelled', 'label', 'row_id')},
x AS (SELECT CAST(doc_id AS VARCHAR) AS row_id, n_chars / 7.0 AS target FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))
SELECT row_id, round(target, 6) AS target, 0 AS copy_no FROM x
UNION ALL SELECT f.row_id, round(f.n_chars / 7.0, 6) AS target, CAST(c AS INTEGER) AS copy_no FROM folded f, range(1, 4) r(c) WHERE f.kfold <> 2
""")
def q_mix_pseudo(spark, d):
    """Pseudo-labelled rows with continuous targets and three copies of the training rows outside fold 2."""
    y = (F.col("n_chars") / 7.0).alias("target")
    named = table(spark, d, "labels").select("doc_id")
    extra = docs(spark, d).join(named, "doc_id", "left_anti").select("row_id", y)
    mixed = filters.mix_pseudo(extra, folded(spark, d).select("row_id", "kfold", y), 2, cols=("row_id", "target"))
    return mixed.select("row_id", F.round("target", 6).alias("target"), F.col("copy_no").cast("int").alias("copy_no"))


@query("duplicates_across_folds", f"""
WITH {SQL_LABELLED}, {sql_folds('labelled', 'label', 'row_id')}
SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_leaking FROM folded
""")
def q_duplicates_across_folds(spark, d):
    """D3 before E5: labelled rows, and texts with one label that are in more than one fold (none may be)."""
    per = folded(spark, d).groupBy("text", "label").agg(F.count(F.lit(1)).alias("n"), F.min("kfold").alias("a"), F.max("kfold").alias("b"))
    return per.agg(F.sum("n").alias("n_rows"), F.sum((F.col("a") != F.col("b")).cast("bigint")).alias("n_leaking"))


# ---------------------------------------------------------------- files: order and identity of records

LANGS = ("fr", "en", "de", "es", None)  # folders in an order that isn't alphabetical; the last one for all other documents, null included


def _write_folders(spark, d, name: str, sep: str | None) -> list[str]:
    base, out = fresh(spark, name), []
    dd = table(spark, d, "documents").withColumn("lang", F.when(F.col("lang").isin(list(LANGS[:-1])), F.col("lang")))
    for i, lang in enumerate(LANGS):
        path = f"{base}/{9 - i} {lang}+%"  # blanks and signs in the path; names sort the other way
        part = dd.filter(F.col("lang").eqNullSafe(F.lit(lang))).repartitionByRange(3, "doc_id").sortWithinPartitions("doc_id").select("text")
        w = part.write if sep is None else part.write.option("lineSep", sep)
        w.text(path)
        out.append(path)
    return out


def _numbered(records: DataFrame, order: str) -> DataFrame:
    """Records with their 0-based position among the records of their folder."""
    return ordered_prefix(records, F.col("file_no"), [F.col("file_no"), F.col(order)], by=["path_no"], out="position", groups_bound=len(LANGS))


_SQL_PATH_NO = f"CASE lang {' '.join(f'WHEN {x!r} THEN {i}' for i, x in enumerate(LANGS[:-1]))} ELSE {len(LANGS) - 1} END"


@query("ordered_paragraphs", f"""
WITH f AS (SELECT *, {_SQL_PATH_NO} AS path_no FROM documents)
SELECT path_no, row_number() OVER (PARTITION BY path_no ORDER BY doc_id) - 1 AS position, text FROM f
""")
def q_ordered_paragraphs(spark, d):
    """A1: paragraphs of several folders, each at its place."""
    p = sources.read_paragraphs(spark, _write_folders(spark, d, "paragraphs", "\n\n"))
    return _numbered(p, "para_no").select("path_no", "position", "text")


@query("ordered_lines", f"""
WITH l AS (SELECT {_SQL_PATH_NO} AS path_no, doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS i
           FROM documents)
SELECT path_no, row_number() OVER (PARTITION BY path_no ORDER BY doc_id, i) - 1 AS position, text FROM l
""")
def q_ordered_lines(spark, d):
    """A2: lines of several folders, each at its place."""
    return _numbered(sources.read_lines(spark, _write_folders(spark, d, "lines", None)), "line_no").select("path_no", "position", "text")


@query("prediction_file", """
SELECT row_number() OVER (ORDER BY doc_id) - 1 AS position, CAST(n_chars % 97 AS BIGINT) AS prediction FROM documents
""")
def q_prediction_file(spark, d):
    """Predictions written in input order and read back with their position."""
    path = fresh(spark, "predictions")
    pred = table(spark, d, "documents").select("doc_id", (F.col("n_chars") % 97).alias("prediction"))
    sources.write_predictions(pred, path, "prediction", order=["doc_id"])
    return sources.read_predictions(spark, path, "bigint")


@query("saved_predictions", f"""
WITH {SQL_LABELLED}, {sql_folds('labelled', 'label', 'row_id')}
SELECT row_id, CASE WHEN toxic = 1 THEN 'large' ELSE 'base' END AS model, CAST(kfold AS BIGINT) AS fold, n_chars / 10.0 AS logit
FROM folded WHERE toxic IS NOT NULL AND toxic <> 1 AND kfold >= 3
""")
def q_saved_predictions(spark, d):
    """A10 with E10: predictions by model and fold, and a read that prunes to one model and two folds."""
    path = fresh(spark, "saved")
    p = folded(spark, d).filter(F.col("toxic").isNotNull()).select(
        "row_id", F.when(F.col("toxic") == 1, "large").otherwise("base").alias("model"), F.col("kfold").alias("fold"),
        (F.col("n_chars") / 10.0).alias("logit"))
    sources.save_predictions(p, path)
    back = sources.load_predictions(spark, path, models=["base"], folds=[3, 4])
    return back.select("row_id", "model", F.col("fold").cast("bigint").alias("fold"), "logit")


def _sql_flat(c: str) -> str:
    return f"replace(replace({c}, chr(10), ' '), chr(9), ' ')"


@query("pair_ingest", f"""
WITH {SQL_PAIRS},
raw AS (SELECT conv_id, turn, CASE WHEN conv_id % 11 = 0 THEN '' ELSE {_sql_flat('text_a')} END AS a, {_sql_flat('text_b')} AS b,
               CASE WHEN conv_id % 13 = 0 THEN 'x' ELSE CAST(conv_id % 2 AS VARCHAR) END AS label FROM pairs),
kept AS (SELECT DISTINCT a, b, label FROM raw WHERE a <> '' AND b <> ''),
lab AS (SELECT md5(a || chr(9) || b || chr(9) || label) AS row_id, a AS text_a, b AS text_b, CAST(label AS INTEGER) AS label FROM kept
        WHERE label IN ('0', '1')),
{sql_folds('lab', 'label', 'row_id')}
SELECT text_a, text_b, label, CAST(kfold AS BIGINT) AS kfold FROM folded
""")
def q_pair_ingest(spark, d):
    """3-field file (every row twice, some fields blank, some labels not numbers) to folds."""
    path = fresh(spark, "pairs3")
    flat = [F.translate(F.translate(F.col(c), "\n", " "), "\t", " ") for c in ("text_a", "text_b")]
    p = pairs(spark, d).select(F.when(F.col("conv_id") % 11 == 0, "").otherwise(flat[0]).alias("a"), flat[1].alias("b"),
                               F.when(F.col("conv_id") % 13 == 0, "x").otherwise((F.col("conv_id") % 2).cast("string")).alias("l"))
    p.unionAll(p).select(F.concat_ws("\t", "a", "b", "l").alias("value")).write.text(path)
    r = filters.non_empty(sources.read_pairs(spark, path), ["text_a", "text_b", "label"])
    r = filters.drop_nulls(filters.dedup(r.select("text_a", "text_b", "label", "label_int")), ["label_int"])
    r = r.withColumn("row_id", F.md5(F.concat_ws("\t", "text_a", "text_b", "label"))).drop("label").withColumnRenamed("label_int", "label")
    f = folds.assign_folds(r, "label", k=K, seed=SEED)
    return f.select("text_a", "text_b", "label", F.col("kfold").cast("bigint").alias("kfold"))


# ---------------------------------------------------------------- rows that hit the branch they are about

@query("quotes_marked", """
SELECT doc_id, replace(replace(replace(replace(text, 'e', '`'), 'o', ''''), '`', ''''), '''''', '"') AS text FROM documents
""")
def q_quotes_marked(spark, d):
    """B5 on texts whose letters e and o are turned into backticks and apostrophes."""
    from ..operators import textprep

    return textprep.quotes(docs(spark, d).select("doc_id", F.translate("text", "eo", "`'").alias("text")), "text")


@query("model_families", """
WITH p AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '/m/deberta-large/fold' WHEN 1 THEN '/m/roberta-base/fold' ELSE '/m/albert/fold' END
                  || CAST(doc_id % 5 AS VARCHAR) AS path, n_chars FROM documents)
SELECT CASE WHEN path LIKE '%deberta%' THEN 'deberta' WHEN path LIKE '%roberta%' THEN 'roberta' ELSE 'other' END AS family,
       count(*) AS n_predictions, CAST(sum(n_chars) AS BIGINT) AS total FROM p GROUP BY 1
""")
def q_model_families(spark, d):
    """G18 on the model paths of predictions."""
    kind = F.when(F.col("doc_id") % 3 == 0, "/m/deberta-large/fold").when(F.col("doc_id") % 3 == 1, "/m/roberta-base/fold").otherwise("/m/albert/fold")
    p = table(spark, d, "documents").select(F.concat(kind, (F.col("doc_id") % 5).cast("string")).alias("path"), "n_chars")
    return p.groupBy(scoring.model_family(F.col("path")).alias("family")).agg(F.count(F.lit(1)).alias("n_predictions"),
                                                                             F.sum("n_chars").alias("total"))
