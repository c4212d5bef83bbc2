"""The corpus pipeline: language ID, near duplicates, decontamination, mixing, token output.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``; ``run`` writes every stage's rows as Parquet into
the shared folder and hands them, read again, to the next one. All stages but the last return the columns
of documents. Documents without an id pass the near-duplicate stage as they are.
"""

from __future__ import annotations

from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession, functions as F

from textfold.llm import edit_decontam, jaccard_join, language_spans, pareto_mix, repair_output
from textfold.llm.shared import materialize

LEAST_LANGUAGE_SCORE = 0.5


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose letters are mostly in known languages, one or several, stay."""
    return language_spans.keep_languages(docs, language_spans.fit(docs), LEAST_LANGUAGE_SCORE)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of similar documents stays; of equal rows, one."""
    linked = jaccard_join.link_documents(docs)
    kept = linked.filter("doc_id = component_id").select("doc_id").distinct()
    repeated = docs.groupBy("doc_id").count().filter("count > 1 AND doc_id IS NOT NULL").limit(1).count()
    chosen = docs.join(kept, "doc_id", "left_semi")
    if repeated:
        chosen = chosen.dropDuplicates()
    return chosen.unionByName(docs.filter("doc_id IS NULL")).select(*docs.columns)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item within its edit budget go."""
    return edit_decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return pareto_mix.mixed(docs)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents as Re-Pair shards, read back: doc_id, start, n_tokens, ids_crc32, n_symbols."""
    return repair_output.write_and_read(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("language_id", keep_known_languages), ("ngram_jaccard_join", keep_one_of_near_copies),
          ("decontamination", drop_benchmark_passages), ("source_mix", mix_to_targets), ("token_output", write_token_ids)]
ORACLE_SQL = None  # language ID and Re-Pair output can't be stated in SQL; tests/llm has brute-force versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
