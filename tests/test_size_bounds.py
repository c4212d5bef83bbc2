"""Work that must not change or grow with a table's size: templates, lines of quoted CSV, tasks of small files."""

import pickle
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from textfold.sources import layout, quoted_csv


def test_rare_nodes_stay_in_large_templates():
    from textfold.llm import wrapper_extract as w

    def page(i: int) -> str:
        rare = "<div class='rare'><p>once</p></div>" if i == 7 else ""
        return "<body>" + "".join(f"<div class='c{chr(97 + j // 26)}{chr(97 + j % 26)}'><p>{i}</p></div>" for j in range(260)) + rare + "</body>"
    packed = [zlib.compress(pickle.dumps(w.template_of(w.parse(page(i))))) for i in range(120)]
    table = w._fold_host(pa.table({"host": ["h"] * 120, "template": pa.array(packed, pa.binary())}))
    whole = pickle.loads(zlib.decompress(table["template"][0].as_py()))
    kids = {k[0]: k for k in whole[4][0][4]}
    assert len(kids) == 261 and kids["div", "rare"][1] == 1 and kids["div", "caa"][1] == 120


def test_alignment_among_common_children():
    from textfold.llm import wrapper_extract as w

    leaf = lambda k: [(k, ""), 1, 0, False, []]
    a, b = ["html", 1, 0, False, [leaf(k) for k in "pqxrys"]], ["html", 1, 0, False, [leaf(k) for k in "uxqvyw"]]
    assert w.match(a, b) in ([(1, 2), (4, 4)], [(2, 1), (4, 4)])
    assert w.weight(a, b) == 3


def test_states_after_lines_equal_a_loop():
    rng = np.random.default_rng(5)
    for n in (1, 2, 50):
        for _ in range(20):
            zero, one, state = rng.integers(0, 2, n), rng.integers(0, 2, n), int(rng.integers(0, 2))
            want, x = [], state
            for z, o in zip(zero, one):
                x = o if x else z
                want.append(x)
            assert quoted_csv._after(zero, one, state).tolist() == want


def test_small_files_are_written_by_few_tasks(spark, tmp_path):
    df = spark.range(6000).select(F.col("id").cast("string").alias("row_id"), (F.col("id") % 3).cast("int").alias("fold")).repartition(8)
    layout.write_sized(df, str(tmp_path / "t"), ["fold"], rows_per_file=20)
    files = spark.read.parquet(str(tmp_path / "t")).groupBy("fold", F.col("_metadata.file_name").alias("f")).count().collect()
    assert sum(r["count"] for r in files) == 6000 and max(r["count"] for r in files) <= 18
    assert [sum(r["fold"] == f for r in files) for f in range(3)] == [112] * 3  # ceil(2000 / 18)
    assert len({re.match(r"part-(\d+)", r["f"])[1] for r in files}) <= 8
