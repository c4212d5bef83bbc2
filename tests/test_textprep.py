from pyspark.sql import functions as F

from textfold.operators import textprep


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_paragraphs_and_title(spark):
    text = "Title A\nfirst line\nsecond\n\nOnly title\n\n\nB body?\nrest"
    df = spark.createDataFrame([("d", text)], "row_id string, text string")
    p = textprep.split_paragraphs(df, "text").withColumn("body", textprep.drop_first_line(F.col("paragraph")))
    got = [r["body"] for r in p.orderBy("para_no").collect()]
    assert got == ["first line\nsecond", "", "B body?\nrest"]
    # Python semantics for the same input
    assert got == ["\n".join(x.split("\n")[1:]) for x in text.split("\n\n")]


def test_chunks(spark):
    df = spark.createDataFrame([("a", "first line\nsecond"), ("b", ""), ("c", "B body?\nrest"), ("e", "a😀b")],
                               "row_id string, text string")
    c = textprep.chunk_text(df, "text", 8)
    got = {(r["row_id"], r["chunk_no"]): r["chunk"] for r in c.collect()}
    assert got[("a", 0)] == "first li" and got[("a", 1)] == "ne\nsecon" and got[("a", 2)] == "d"
    assert not any(k[0] == "b" for k in got)
    assert got[("c", 0)] == "B body?\n" and got[("c", 1)] == "rest"
    c2 = {r["chunk_no"]: r["chunk"] for r in textprep.chunk_text(df.filter("row_id = 'e'"), "text", 2).collect()}
    assert c2 == {0: "a😀", 1: "b"}


def test_chunk_stream_crosses_rows(spark):
    df = spark.createDataFrame([(0, "ab\n"), (1, "cde\n")], "o long, text string")
    c = textprep.chunk_stream(df, "text", F.lit(0), [F.col("o")], size=4)
    got = sorted((r["chunk_no"], r["chunk"]) for r in c.collect())
    assert got == [(0, "ab\nc"), (1, "de\n")]


def test_chunk_stream_equals_python(spark):
    import random

    rnd = random.Random(7)
    texts = ["".join(rnd.choice("abc\n") for _ in range(rnd.randint(0, 40))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "o long, text string")
    c = textprep.chunk_stream(df, "text", F.floor(F.col("o") / 7), [F.col("o")], size=9)
    whole = "".join(texts)
    expect = [(i // 9, whole[i:i + 9]) for i in range(0, len(whole), 9)]
    assert sorted((r["chunk_no"], r["chunk"]) for r in c.collect()) == expect


def test_quotes_and_coerce(spark):
    df = spark.createDataFrame([("``He said `hi''",), ("'''",), (None,)], "text string")
    q = [r["text"] for r in textprep.quotes(df, "text").collect()]
    assert q[:2] == ['"He said \'hi"', "\"'"]
    c = [r["text"] for r in textprep.coerce_text(df, ["text"]).collect()]
    assert c[2] == "nan"
