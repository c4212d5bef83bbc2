"""Sources and sinks.

Text sources keep a stable order key per record: the file's ordinal, the byte offset of the file split
(``_metadata.file_block_start``) and the record's rank inside that split. Splits are read sequentially, so the
key reproduces file order without reading a file in one task. The ordinal comes from a small table of the
files Spark itself lists (a path may be a folder, hold blanks or lack a scheme), joined on the file path; a
record of a file that is not in it raises.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from ..plans.ordering import ordered_prefix
from . import quoted_csv


def file_table(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``(file, path_no, file_no)``: the files below each given path in the order of the paths, then of the names."""
    rows = []
    for path_no, path in enumerate(paths):
        rows += [(f, path_no) for f in sorted(spark.read.text(path).inputFiles())]
    return spark.createDataFrame([(f, p, i) for i, (f, p) in enumerate(rows)], "file string, path_no int, file_no int") \
        .withColumn("file", _same_form(F.col("file")))


def _same_form(path: Column) -> Column:
    """A file path without percent encoding, with one slash after the scheme."""
    plain = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(plain, "^([a-z0-9]+:)/{2,}(?=/)", "$1")


def _ordered_records(spark: SparkSession, paths: Sequence[str], line_sep: str | None,
                     pieces: Callable[[Column], Column] | None = None) -> DataFrame:
    reader = spark.read
    if line_sep is not None:
        reader = reader.option("lineSep", line_sep)
    paths = list(paths)
    d = reader.text(paths).select(
        "value",
        _same_form(F.col("_metadata.file_path")).alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("__seq"))
    value = F.array("value") if pieces is None else pieces(F.col("value"))
    d = d.select("file", "block", "__seq", F.posexplode(value).alias("__piece", "value"))
    d = d.join(file_table(spark, paths), "file", "left")
    d = d.withColumn("file_no", F.coalesce("file_no", F.raise_error(F.concat(F.lit("not a listed file: "), F.col("file"))).cast("int")))
    # Record number inside its file: exact prefix over (file, split) blocks.
    d = ordered_prefix(d, F.col("block"), [F.col("__seq"), F.col("__piece")], by=["file_no"], out="line_no", groups_bound=None)
    return d.select("path_no", "file_no", "block", "line_no", F.col("value").alias("text"))


def read_paragraphs(spark: SparkSession, paths: str | Sequence[str], sep: str = "\n\n") -> DataFrame:
    """A1: blank-line separated paragraphs, splittable (the separator is the record delimiter).

    Equals Python's ``open(path).read().split('\\n\\n')``, runs of 3-4 newlines and CRLF line ends included: a
    record that still holds carriage returns is brought to newlines and split again.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)

    def pieces(value: Column) -> Column:
        lines = F.regexp_replace(F.regexp_replace(value, r"\r$", ""), r"\r\n?", "\n")
        return F.when(F.instr(value, "\r") > 0, F.split(lines, "\n\n", -1)).otherwise(F.array(value))
    return _ordered_records(spark, paths, sep, pieces if sep == "\n\n" else None).withColumnRenamed("line_no", "para_no")


def read_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """A2: lines of several files with order key ``(file_no, line_no)``: files in the given path order, then by name."""
    return _ordered_records(spark, [paths] if isinstance(paths, str) else paths, None)


def read_labeled_csv(spark: SparkSession, path: str | Sequence[str], schema: StructType | str) -> DataFrame:
    """A3: headed CSV with quoted multi-line text and an explicit schema, read by splits (``quoted_csv``)."""
    return quoted_csv.parse_records(quoted_csv.read_records(spark, path), schema).drop("file", "block", "record_no")


def read_pairs(spark: SparkSession, paths: str | Sequence[str], n_fields: int = 3, mode: str = "strict",
               names: Sequence[str] = ("text_a", "text_b", "label")) -> DataFrame:
    """A4/A5: tab-separated fields, no quoting, blank lines skipped.

    ``strict`` raises on a line without exactly ``n_fields`` fields (as a tuple unpack
    would); ``drop`` skips such lines. Fields stay literal text ('NA' stays 'NA').
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    d = _ordered_records(spark, paths, None).filter(F.length("text") > 0)
    d = d.withColumn("__f", F.split("text", "\t", -1))
    if mode == "strict":
        d = d.withColumn("__f", F.when(F.size("__f") != n_fields, F.raise_error(
            F.concat(F.lit(f"expected {n_fields} fields, line "), F.col("line_no").cast("string")))
        ).otherwise(F.col("__f")))
    elif mode == "drop":
        d = d.filter(F.size("__f") == n_fields)
    else:
        raise ValueError("mode must be 'strict' or 'drop'")
    cols = [F.col("__f")[i].alias(names[i]) for i in range(n_fields)]
    out = d.select(F.concat_ws(":", "file_no", "line_no").alias("row_id"), "file_no", "line_no", *cols)
    if n_fields >= 3 and "label" in names[:n_fields]:
        out = out.withColumn("label_int", F.expr("try_cast(label as int)"))
    return out


def read_unlabeled_pairs(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """A5: two tab-separated columns named ``text_a``, ``text_b``."""
    return read_pairs(spark, paths, n_fields=2, mode="strict", names=("text_a", "text_b"))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write a table (Parquet by default; CSV with header, doubled-quote escaping and outer blanks kept)."""
    w = df.write.mode(mode)
    if fmt == "csv":
        keep = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
        w.options(header=True, quote='"', escape='"', **keep).csv(path)
    else:
        w.format(fmt).save(path)


def write_predictions(df: DataFrame, path: str, col: str, order: Sequence[str] = ("file_no", "line_no")) -> None:
    """Header-less single-column CSV in input order (a range-partitioned sort on numeric order columns).

    The file has no key, so the order is all that ties a prediction to its row: order columns must be numeric (text
    would put 10 before 2) and a position that occurs twice raises.
    """
    kinds = dict(df.dtypes)
    text = [c for c in order if kinds[c] == "string"]
    if text:
        raise ValueError(f"order columns must be numeric: {text}")
    n = F.sum("__n").over(Window.partitionBy(*order))
    once = F.when(n > 1, F.raise_error(F.lit("two predictions for one position")).cast("int")).otherwise(F.lit(1))
    d = df.select(*order, col, F.lit(1).alias("__n")).withColumn("__once", once).filter("__once = 1")
    d.orderBy(*order).select(col).write.mode("overwrite").option("header", False).csv(path)


def read_predictions(spark: SparkSession, path: str, kind: str = "double") -> DataFrame:
    """The predictions with their 0-based input position."""
    d = read_lines(spark, [path])
    d = ordered_prefix(d, F.col("file_no"), [F.col("file_no"), F.col("line_no")], out="position", groups_bound=None)
    return d.select("position", F.col("text").cast(kind).alias("prediction"))


def write_fold_labels(df: DataFrame, path: str) -> None:
    """Labelled rows, one directory per fold (``fold=f``)."""
    df.write.mode("overwrite").partitionBy("fold").parquet(path)


def save_predictions(pred: DataFrame, path: str) -> None:
    """A10: long predictions partitioned by model and fold."""
    pred.write.mode("overwrite").partitionBy("model", "fold").parquet(path)


def load_predictions(spark: SparkSession, path: str, models: Sequence[str] | None = None,
                     folds: Sequence[int] | None = None) -> DataFrame:
    """A10: read predictions back; model/fold filters prune partitions."""
    d = spark.read.parquet(path)
    if models is not None:
        d = d.filter(F.col("model").isin(list(models)))
    if folds is not None:
        d = d.filter(F.col("fold").isin(list(folds)))
    return d


def materialize_once(spark: SparkSession, build: Callable[[], DataFrame], path: str) -> DataFrame:
    """Write the derived table only when it is absent, then read it.

    A table is there when its ``_SUCCESS`` file is. ``build`` is not called then. An unfinished folder, left by an
    interrupted first run, is no table: the new one is written aside and takes its place by a rename.
    """
    jvm = spark._jvm
    target, aside = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.unfinished-{uuid.uuid4().hex}")
    fs = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    done = jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    if not fs.exists(done):
        build().write.parquet(aside.toString())
        if not fs.exists(done):
            if fs.exists(target):
                fs.delete(target, True)
            fs.rename(aside, target)
    return spark.read.parquet(path)
