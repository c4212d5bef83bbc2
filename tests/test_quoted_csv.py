"""A3: quoted CSV by splits equals Spark's multiLine reader, whatever the size of the splits."""

import random

import pytest

from textfold import sources
from textfold.sources import quoted_csv

SCHEMA = "a string, b string, n int"


@pytest.fixture
def splits(spark):
    """Sets the size of a split."""
    keys = {"spark.sql.files.maxPartitionBytes": spark.conf.get("spark.sql.files.maxPartitionBytes"),
            "spark.sql.files.openCostInBytes": spark.conf.get("spark.sql.files.openCostInBytes")}

    def use(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield use
    for k, v in keys.items():
        spark.conf.set(k, v)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def whole(spark, path):
    """Spark's own reader, one task a file."""
    r = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True)
    return rows_of(r.schema(SCHEMA).csv(path))


def well_formed(rng, n):
    out = ["a,b,n"]
    for i in range(n):
        value = lambda: "".join(rng.choices(['"', "\n", ",", "x", "yz", " ", "é", "\n\n", '""', "long " * 9], k=rng.randrange(8)))
        quoted = lambda v: '"' + v.replace('"', '""') + '"'
        plain = lambda: rng.choice(["", "w", "some words", "é x", "7"])
        out.append(",".join([rng.choice([quoted(value()), plain()]), rng.choice([quoted(value()), plain()]), str(i)]))
        if rng.random() < .1:
            out.append("")
    return "\n".join(out) + rng.choice(["", "\n"])


@pytest.mark.parametrize("seed, size", [(1, 50), (2, 333), (3, 1000), (4, 1 << 20), (5, 17)])
def test_equals_the_multiline_reader(spark, tmp_path, splits, seed, size):
    rng = random.Random(seed)
    for f in range(3):
        (tmp_path / f"f{f}.csv").write_text(well_formed(rng, [0, 40, 90][f]), newline="")
    want = whole(spark, str(tmp_path))
    splits(size)
    records = quoted_csv.read_records(spark, str(tmp_path))
    if size < 1000:
        assert records.rdd.getNumPartitions() > 6  # more tasks than files
    assert rows_of(sources.read_labeled_csv(spark, str(tmp_path), SCHEMA)) == want and len(want) == 130


ODD = ['a,b,n\n5" disk,"x\ny",1\nq,"un"quoted, y",2\n', 'a,b,n\r\n"x\r\ny",z,1\r\n\r\nu,"v",2\r\n', '\n\n"head\ner",b,n\n1,2,3\n', "a,b,n", "",
       'a,b,n\n"never closed,1,2\nx,y,3', 'a,b,n\n"only\none\nrecord\nover\nmany\nlines",y,4', 'a,b,n\n"",,5\n,"",6\n', 'a,b,n\nx,"y" ,7\nx,y,8,9\nx\n']


@pytest.mark.parametrize("size", [3, 8, 1 << 20])
@pytest.mark.parametrize("case", range(len(ODD)))
def test_odd_files(spark, tmp_path, splits, case, size):
    path = tmp_path / "f.csv"
    path.write_text(ODD[case], newline="")
    want = whole(spark, str(path))
    splits(size)
    assert rows_of(sources.read_labeled_csv(spark, str(path), SCHEMA)) == want


def test_records_keep_their_order_and_round_trip(spark, tmp_path, splits):
    rows = [(f" {i}\n\"{i}\"," * (i % 4), ["", None, "x\n", '"'][i % 4], i) for i in range(200)]
    sources.write_table(spark.createDataFrame(rows, SCHEMA).coalesce(1), str(tmp_path / "t"), fmt="csv")
    splits(100)
    back = quoted_csv.parse_records(quoted_csv.read_records(spark, str(tmp_path / "t")), SCHEMA).orderBy("file", "block", "record_no")
    assert [(r.a, r.b, r.n) for r in back.collect()] == [(a or None, b or None, n) for a, b, n in rows]  # Spark reads an empty value as null
