"""Queries of the subpackage, one per operator, over whole tables; and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from public_tokenizers import path as tokenizer_path

from . import (edit_decontam, jaccard_join, language_spans, license_scan, multi_index, pareto_mix, repair_output, superkmer,
               token_counts, token_groups, turn_repair, warc, wrapper_extract)
from .shared import scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_repair_output(spark, sf_dir):
    """Token ids written as Re-Pair grammars in doc_id order, and read back."""
    return repair_output.write_and_read(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


@query
def op2_license_scan(spark, sf_dir):
    """Licence notices by conditional compression."""
    return license_scan.scan_licenses(_table(spark, sf_dir, "documents"))


@query
def op3_superkmer_dedup(spark, sf_dir):
    """Words of windows that start in an earlier document removed (super-k-mer buckets)."""
    return superkmer.remove_repeats(_table(spark, sf_dir, "documents")).drop("kept")


ORACLE["op3_superkmer_dedup"] = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
windows AS (
  SELECT doc_id, i, list_slice(w, i, i + 12) AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words)),
earliest AS (SELECT win, min(doc_id) AS first_doc FROM windows GROUP BY win),
hit AS (
  SELECT DISTINCT doc_id, i + j AS pos
  FROM (SELECT doc_id, i FROM windows JOIN earliest USING (win) WHERE first_doc < doc_id), range(0, 13) AS r(j)),
gone AS (SELECT doc_id, list(pos) AS pos FROM hit GROUP BY doc_id),
kept AS (
  SELECT doc_id, len(w) AS n_words, coalesce(len(pos), 0) AS n_removed, g.pos AS pos, w FROM words LEFT JOIN gone g USING (doc_id)),
flat AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM (
    SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM words) x
  WHERE NOT EXISTS (SELECT 1 FROM hit h WHERE h.doc_id = x.doc_id AND h.pos = x.i)
  GROUP BY doc_id)
SELECT doc_id, n_words, n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM kept LEFT JOIN flat USING (doc_id)
"""


@query
def op4_multi_index(spark, sf_dir):
    """The 5 nearest of each vector whose id is divisible by 50, by an inverted multi-index."""
    vectors = _table(spark, sf_dir, "embeddings")
    return multi_index.search(vectors, vectors.filter("vec_id % 50 = 0"))


@query
def op5_language_spans(spark, sf_dir):
    """Language of each document, learned from those that aren't held out."""
    docs = _table(spark, sf_dir, "documents")
    labelled = language_spans.label_languages(docs, language_spans.fit(docs))
    return labelled.select("doc_id", language_spans.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


@query
def op6_wrapper_extract(spark, sf_dir):
    """Main text of each page by templates of its host."""
    return wrapper_extract.extract_pages(_table(spark, sf_dir, "pages"))


@query
def op7_edit_decontam(spark, sf_dir):
    """Benchmark items within their edit budget in documents."""
    return edit_decontam.find_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@query
def op8_pareto_mix(spark, sf_dir):
    """Sources mixed to target weights by Pareto order sampling."""
    return pareto_mix.mix_sources(_table(spark, sf_dir, "documents"))


@query
def op9_token_counts(spark, sf_dir):
    """Tokens of each document by the sentencepiece model."""
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


@query
def op10_jaccard_join(spark, sf_dir):
    """Components of documents whose shingle sets are similar."""
    return jaccard_join.link_documents(_table(spark, sf_dir, "documents"))


@query
def op11_token_groups(spark, sf_dir):
    """Tokens of two tokenizers in groups of equal bytes, and how often their id pairs occur corpus-wide."""
    return token_groups.align_documents(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


@query
def op12_warc(spark, sf_dir):
    """A record per page written as WARC archives, and read back by byte ranges."""
    path = scratch(spark, "warc")
    warc.write_warc(_table(spark, sf_dir, "pages"), path)
    return warc.page_records(warc.read_warc(spark, path))


@query
def op13_turn_repair(spark, sf_dir):
    """Damaged conversations and their cheapest repair, by a run-length dynamic programme."""
    return turn_repair.repair_report(_table(spark, sf_dir, "conversations"))


def _pareto_sql(seed: int = pareto_mix.SEED, fills: int = pareto_mix.FILLS) -> str:
    """The mix with plain windows: each source is sorted as a whole."""
    key = "odds, u, doc_id, size"
    rounds = ""
    for i in range(fills):
        rounds += f"""
c{i} AS (SELECT *, (NOT t) AND size <= {'open' if i else "'inf'::DOUBLE"} AND sum(CASE WHEN NOT t AND size <= {'open' if i else "'inf'::DOUBLE"}
           THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY {key}) <= open AS now FROM r{i}),
r{i + 1} AS (SELECT * EXCLUDE (t, open, now), t OR now AS t, open - sum(CASE WHEN now THEN size ELSE 0 END) OVER (PARTITION BY source) AS open FROM c{i}),"""
    return f"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
wt AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, CAST(source_size * 3 AS DOUBLE) AS f FROM src),
lv AS (SELECT *, f / weight AS fills_at, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(f) OVER o, 0)) /
         (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level FROM wt
       WINDOW o AS (ORDER BY f / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
tg AS (SELECT *, least(f, weight * (SELECT arg_min(level, fills_at) FROM lv WHERE level <= fills_at)) AS target FROM lv),
tg2 AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS certain FROM tg),
tg3 AS (SELECT source, source_size, target, certain, target - certain * source_size AS open,
               CASE WHEN source_size > 0 THEN (target - certain * source_size) / source_size ELSE 0 END AS p FROM tg2),
d AS (SELECT s.doc_id, s.source, s.size, t.source_size, t.target, t.certain, t.open, t.p,
             (CAST(('0x' || substr(md5('{seed}|' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13))::BIGINT AS DOUBLE) + 0.5) / 4503599627370496.0 AS u
      FROM sized s JOIN tg3 t ON s.source IS NOT DISTINCT FROM t.source),
r0 AS (SELECT *, (u / (1 - u)) / (p / (1 - p)) AS odds, FALSE AS t FROM d WHERE p > 0 AND size > 0),{rounds}
x AS (SELECT source, min(struct_pack(a := odds, b := u, c := doc_id, e := size)) AS k FROM r{fills}
      WHERE NOT t AND size > open AND size < 2 * open GROUP BY source),
got AS (SELECT doc_id, r.source, size, u FROM r{fills} r LEFT JOIN x ON x.source IS NOT DISTINCT FROM r.source
        WHERE t OR struct_pack(a := odds, b := u, c := doc_id, e := size) = x.k)
SELECT doc_id, source, CAST(size AS BIGINT) AS size, source_size, target, CAST(copies AS BIGINT) AS copies, CAST(size * copies AS BIGINT) AS taken
FROM (SELECT d.*, CASE WHEN size > 0 THEN certain + CASE WHEN EXISTS (SELECT 1 FROM got g WHERE g.doc_id = d.doc_id AND g.size = d.size
  AND g.source IS NOT DISTINCT FROM d.source) THEN 1 ELSE 0 END ELSE 0 END AS copies FROM d)
"""


ORACLE["op8_pareto_mix"] = _pareto_sql()
