import os

import pytest

from textfold import sources


def _write(path, text):
    with open(path, "w", newline="") as f:
        f.write(text)


def test_paragraphs_and_lines(spark, tmp_path):
    p = tmp_path / "para.txt"
    _write(p, "T1\nbody\n\nT2\n\n\nx\ny")
    got = [r.text for r in sources.read_paragraphs(spark, str(p)).orderBy("para_no").collect()]
    assert got == "T1\nbody\n\nT2\n\n\nx\ny".split("\n\n")
    a, b = tmp_path / "a.txt", tmp_path / "b.txt"
    _write(a, "one\ntwo\n")
    _write(b, "three\n")
    lines = sources.read_lines(spark, [str(b), str(a)]).orderBy("file_no", "line_no").collect()
    assert [r.text for r in lines] == ["three", "one", "two"]


def test_pairs_strict_and_drop(spark, tmp_path):
    p = tmp_path / "pairs.tsv"
    _write(p, "a\tb\t1\n\nNA\tq\"uo\t0\n")
    rows = sources.read_pairs(spark, str(p)).orderBy("row_id").collect()
    assert [(r.text_a, r.text_b, r.label) for r in rows] == [("a", "b", "1"), ("NA", 'q"uo', "0")]
    bad = tmp_path / "bad.tsv"
    _write(bad, "a\tb\t1\na\tb\n")
    with pytest.raises(Exception, match="expected 3 fields"):
        sources.read_pairs(spark, str(bad)).collect()
    assert sources.read_pairs(spark, str(bad), mode="drop").count() == 1


def test_round_trips(spark, tmp_path):
    pred = spark.createDataFrame([("r1", "m", f, float(f)) for f in range(3)], "row_id string, model string, fold int, logit double")
    out = str(tmp_path / "pred")
    sources.save_predictions(pred, out)
    assert sources.load_predictions(spark, out, models=["m"], folds=[1]).count() == 1
    csv = str(tmp_path / "t.csv")
    txt = spark.createDataFrame([("a \"quoted\"\nline", 1.5)], "excerpt string, target double")
    sources.write_table(txt, csv, fmt="csv")
    back = sources.read_labeled_csv(spark, csv, "excerpt string, target double").collect()
    assert back[0].excerpt == 'a "quoted"\nline'
    built = []

    def build():
        built.append(1)
        return txt

    path = str(tmp_path / "once")
    sources.materialize_once(spark, build, path)
    sources.materialize_once(spark, build, path)
    assert spark.read.parquet(path).count() == 1
    assert built == [1]


def test_interrupted_build_is_redone(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "part-0.parquet").write_text("half written")
    t = sources.materialize_once(spark, lambda: spark.range(3), str(tmp_path / "t"))
    assert t.count() == 3 and (tmp_path / "t" / "_SUCCESS").exists()


def test_folders_blanks_and_crlf(spark, tmp_path):
    d = tmp_path / "b dir+%20"
    d.mkdir()
    _write(d / "b.txt", "b1\r\nb2\r\n")
    _write(d / "a.txt", "a1\na2\n")
    _write(tmp_path / "z.txt", "z\n")
    rows = sources.read_lines(spark, [str(tmp_path / "z.txt"), str(d)]).orderBy("file_no", "line_no").collect()
    assert [(r.path_no, r.file_no, r.line_no, r.text) for r in rows] == [
        (0, 0, 0, "z"), (1, 1, 0, "a1"), (1, 1, 1, "a2"), (1, 2, 0, "b1"), (1, 2, 1, "b2")]
    text = "T\r\nx\r\n\r\nU\r\n\r\n\r\nv\n\nw\r\n\ny"
    _write(d / "c.txt", text)
    got = [r.text for r in sources.read_paragraphs(spark, str(d / "c.txt")).orderBy("para_no").collect()]
    assert got == text.replace("\r\n", "\n").split("\n\n")


def test_unlisted_file_raises(spark, tmp_path, monkeypatch):
    _write(tmp_path / "a.txt", "x\n")
    from textfold.sources import io
    monkeypatch.setattr(io, "file_table", lambda s, p: s.createDataFrame([("file:/other", 0, 0)], "file string, path_no int, file_no int"))
    with pytest.raises(Exception, match="not a listed file"):
        sources.read_lines(spark, [str(tmp_path / "a.txt")]).collect()


def test_prediction_order(spark, tmp_path):
    df = spark.createDataFrame([(i, float(i * i)) for i in range(25)], "position long, p double").repartition(5)
    sources.write_predictions(df, str(tmp_path / "p"), "p", order=["position"])
    got = sources.read_predictions(spark, str(tmp_path / "p")).orderBy("position").collect()
    assert [(r.position, r.prediction) for r in got] == [(i, float(i * i)) for i in range(25)]
    with pytest.raises(ValueError, match="numeric"):
        sources.write_predictions(df.withColumn("position", df.position.cast("string")), str(tmp_path / "q"), "p", order=["position"])
    with pytest.raises(Exception, match="two predictions"):
        sources.write_predictions(df.unionAll(df), str(tmp_path / "r"), "p", order=["position"])
