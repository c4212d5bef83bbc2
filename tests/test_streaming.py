import uuid

from pyspark.sql import functions as F

from textfold.operators import textprep
from textfold.streaming import prepare_stream, start_prepared_stream

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_stream_prepares_like_batch(spark, tmp_path):
    out = str(tmp_path / "prepared")
    s = prepare_stream(spark, SF, SCHEMA, glob="documents.parquet")
    q = start_prepared_stream(s, out, name=f"prep-{uuid.uuid4().hex}")
    q.awaitTermination(300)
    got = spark.read.parquet(out)
    batch = textprep.chunk_text(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), "text", 1000)
    assert got.count() == batch.count()
    a = {(r.doc_id, r.chunk_no, r.chunk) for r in got.select("doc_id", "chunk_no", "chunk").collect()}
    b = {(r.doc_id, r.chunk_no, r.chunk) for r in batch.collect()}
    assert a == b
    assert got.filter(F.col("n_tokens") <= 0).count() == 0
