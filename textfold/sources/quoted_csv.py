"""A3: headed CSV with quoted multi-line text, read by splits.

A line break ends a record only outside quotes, and whether a split begins inside quotes depends on all that stands before it. So
a line is a function of the state it begins in (0 outside, 1 inside quotes) to the state it ends in, found in the JVM by
two patterns. A split is scanned once under both states: its lines' functions compose to the split's own. Composing these, one row per split,
in file order gives every split's true first state. A second scan cuts the splits into records in place; lines of records that go over
a split's end, at most two pieces a split, are read by a third scan that passes nothing else on, and glued. No text is shuffled
but those pieces. A record's text becomes columns by ``from_csv``, the parser of Spark's own reader.

The result is that of ``multiLine`` with quote and escape ``"``: a quote opens a value only at its beginning, a doubled quote is
one, text after a closing quote belongs to the value up to the next comma, empty lines are no records. A file's first line break says if its
lines end with LF or CRLF; in the latter case those inside quotes become LF, too. A value that is never closed ends with the file's last line. Positions: ``(file, block, record_no)`` is the order of the records.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..plans.local import to_local

# Splits listed in the state table, a row each, which every task gets.
MAX_SPLITS = 4_000_000

_QUOTED = '(?:[^"]|"")*+'  # what may stand between a value's quotes
_CLOSED = f'{_QUOTED}"[^,]*+'  # from inside quotes to the value's end
_VALUES = f'(?:(?:"{_CLOSED}|[^,"][^,]*+)?+,)*+'  # whole values, each with its comma
_OPEN = f'"{_QUOTED}\\z'


def _lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    value = F.col("value")
    quotes = F.instr(value, '"') > 0
    from_0 = quotes & value.rlike(f"^{_VALUES}{_OPEN}")
    from_1 = ~quotes | value.rlike(f"^{_QUOTED}\\z") | value.rlike(f"^{_CLOSED},{_VALUES}{_OPEN}")
    return spark.read.option("lineSep", "\n").text(list(paths)).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"), value,
        F.endswith(value, F.lit("\r")).alias("cr"), F.when(value == "", 2).when(value == "\r", 1).otherwise(0).alias("empty"), from_0.cast("int").alias("from_0"), from_1.cast("int").alias("from_1"))


def _runs(batch):
    """``(file, block, first row, end row)`` of the splits in a batch; lines of a split are next to each other."""
    files, blocks = batch["file"], batch["block"].to_numpy()
    codes = files.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(codes) != 0)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(blocks)]):
        if b > a:
            yield files[a].as_py(), int(blocks[a]), a, b


def _after(zero: np.ndarray, one: np.ndarray, state: int) -> np.ndarray:
    """The state after each line, from ``state``: that of the last line with one end for both states, turned by every line since that turns it."""
    at = np.arange(len(zero))
    fixed = np.maximum.accumulate(np.where(zero == one, at, -1))
    turns = np.cumsum((zero == 1) & (one == 0))
    known = fixed >= 0
    return np.where(known, zero[fixed], state) ^ ((turns - np.where(known, turns[fixed], 0)) & 1)


def _split_functions(batches):
    """Per split its composed function and, for both first states, the first and the last line that ends a record; if a record that
    isn't an empty line ends in it (in a file of LF lines, of CRLF lines); and if its first line ends with CR."""
    found: dict[tuple[str, int], list] = {}
    for batch in batches:
        zero, one, line, empty = (batch[c].to_numpy() for c in ("from_0", "from_1", "line", "empty"))
        for file, block, a, b in _runs(batch):
            s = found.setdefault((file, block), [0, 1, None, None, None, None, False, False, batch["cr"][a].as_py(), False, False])
            for first, state in ((2, 0), (4, 1)):
                after = _after(zero[a:b], one[a:b], s[state])
                s[state] = int(after[-1])
                ends = np.flatnonzero(after == 0)
                if len(ends):
                    s[first + 1] = int(line[a + ends[-1]])
                    if s[first] is None:
                        s[first] = int(line[a + ends[0]])
                    if not state:
                        there = empty[a:a + ends[-1] + 1]
                        s[6], s[7] = s[9] or bool((there < 2).any()), s[10] or bool((there == 0).any())
            s[9], s[10] = s[9] or bool((empty[a:b] < 2).any()), s[10] or bool((empty[a:b] == 0).any())
    rows = [(*k, *v[:9]) for k, v in found.items()]
    names = ["file", "block", "to_0", "to_1", "first_0", "last_0", "first_1", "last_1", "solid", "solid_cr", "cr"]
    types = [pa.string(), pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 4, *[pa.bool_()] * 3]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


def _states(table: pa.Table) -> pa.Table:
    """The splits of one file in order: true first state, the lines that end its first and last record, the split in which the record
    that is open at its beginning (``before``) began, if the file's header is its first whole record (1) or the one open at its end (2), and if
    the file's lines end with CRLF."""
    state, owner, header, out = 0, None, 0, []
    rows = sorted(table.to_pylist(), key=lambda r: r["block"])
    crlf = rows[0]["cr"]
    for r in rows:
        first, last, before = r[f"first_{state}"], r[f"last_{state}"], owner
        was, state = state, r[f"to_{state}"]
        if last is not None:
            owner = None
        begins = state == 1 and owner is None
        if begins:
            owner = r["block"]
        here = 0
        if not header:
            here = header = 1 if was == 0 and r["solid_cr" if crlf else "solid"] else 2 if begins else 0
        out.append((r["file"], r["block"], was, first, last, before, here, crlf))
    names = ["s_file", "s_block", "state", "first", "last", "before", "header", "crlf"]
    types = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()]
    return pa.Table.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)


def split_states(lines: DataFrame) -> DataFrame:
    """One row per split of ``lines``, as a local table (at most ``MAX_SPLITS`` rows)."""
    per = lines.select("file", "block", "line", "from_0", "from_1", "empty", "cr").mapInArrow(
        _split_functions, "file string, block bigint, to_0 int, to_1 int, first_0 bigint, last_0 bigint, first_1 bigint, last_1 bigint, "
        "solid boolean, solid_cr boolean, cr boolean")
    states = per.groupBy("file").applyInArrow(
        _states, "s_file string, s_block bigint, state int, first bigint, last bigint, before bigint, header int, crlf boolean")
    return to_local(states, MAX_SPLITS)


def _records(batches):
    """Records that begin and end in one split; the lines begin outside quotes."""
    where, state, number, open_ = None, 0, 0, None
    for batch in batches:
        zero, one, header, values = (*(batch[c].to_numpy() for c in ("from_0", "from_1", "header")), batch["value"])
        for file, block, a, b in _runs(batch):
            if (file, block) != where:
                where, state, number, open_ = (file, block), 0, 0, values.slice(0, 0)
            ends = np.flatnonzero(_after(zero[a:b], one[a:b], state) == 0) + 1
            state = int(not len(ends) or ends[-1] < b - a)
            lines = pa.concat_arrays([open_, values.slice(a, b - a)])
            offsets = np.concatenate(([0], ends + len(open_))).astype(np.int32)
            open_ = lines.slice(int(offsets[-1]))
            text = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), lines.slice(0, int(offsets[-1]))), "\n")
            text = text.filter(pc.not_equal(text, ""))
            n = len(text)
            if n:
                first = np.zeros(n, bool)
                first[0] = number == 0 and header[a] == 1
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(file, pa.string()), n), pa.repeat(pa.scalar(block, pa.int64()), n),
                                                  pa.array(np.arange(number, number + n)), text, pa.array(first)],
                                                 ["file", "block", "record_no", "text", "is_header"])
                number += n


def read_records(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``(file, block, record_no, text, is_header)``: the records of quoted CSV files, line breaks inside quotes kept, empty lines left out."""
    lines = _lines(spark, [paths] if isinstance(paths, str) else paths)
    at = lines.join(F.broadcast(split_states(lines)), (F.col("file") == F.col("s_file")) & (F.col("block") == F.col("s_block")))
    at = at.withColumn("value", F.when(F.col("crlf"), F.regexp_replace("value", "\r\\z", "")).otherwise(F.col("value")))
    # Lines up to `first` end a record that began before; the next line is outside quotes.
    inside = ((F.col("state") == 0) | (F.col("line") > F.col("first"))) & (F.col("line") <= F.col("last"))
    whole = at.filter(inside).select("file", "block", "header", "value", "from_0", "from_1").mapInArrow(
        _records, "file string, block bigint, record_no bigint, text string, is_header boolean")
    head = (F.col("state") == 1) & (F.col("first").isNull() | (F.col("line") <= F.col("first")))
    tail = F.col("last").isNull() | (F.col("line") > F.col("last"))
    pieces = at.filter(head | tail).select("file", "block", "line", "value", F.when(head, F.col("before")).otherwise(F.col("block")).alias("owner"),
                                           (~head & (F.col("header") == 2)).alias("h"))
    glued = pieces.groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("block", "line", "value"))).alias("p"), F.max("h").alias("h"))
    glued = glued.select("file", F.col("owner").alias("block"), F.lit(1 << 62).alias("record_no"),  # the last of its split
                         F.array_join(F.transform("p", lambda x: x["value"]), "\n").alias("text"), F.col("h").alias("is_header"))
    return whole.unionByName(glued)


def parse_records(records: DataFrame, schema: StructType | str, header: bool = True) -> DataFrame:
    """Columns of ``read_records``' records, besides ``file, block, record_no``; with ``header`` each file's first record is none."""
    ddl = schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    rows = records.filter(~F.col("is_header")) if header else records
    return rows.select("file", "block", "record_no", F.from_csv("text", ddl, {"quote": '"', "escape": '"'}).alias("r")).select("file", "block", "record_no", "r.*")
