"""Conversation structure repair: the cheapest edits that make roles alternate, by a run-length dynamic programme.

A row's symbol is its role's initial and its fault. Four states (nothing kept yet, after system, after user, after assistant) and
the edits Keep, Rerole, Delete and Insert give each symbol a 4 x 4 min-plus matrix, with the cheapest inserts before the row folded in.
Equal consecutive symbols are one run, and a run of n advances the costs by the binary powers of its matrix, which are computed once
and kept per symbol. The costs-to-go at run borders then decide each letter of the audit: a run is unrolled by halves down to short runs,
whose letters are remembered per (symbol, length, state, cost differences). Letters lead to one state each, so taking the least letter on
a cheapest path at every step gives the least audit of all cheapest ones.

Scale: rows travel as keys and digests of their texts. Equal rows are counted before they are shuffled, then sorted by range over
(conv_id, turn, role, digest), so a conversation with a third of all rows lies in many tasks, as segments of at most
``SEGMENT_ROWS`` rows. A segment is known to the others by its matrix; one pass backwards over a conversation's matrices gives the
costs after each segment, and one forwards over the segments' exits the state each begins in. Only kept rows meet their texts again, by a key
of their own. The digest of a whole repaired conversation alone is read in sequence, row after row.

Defined results: rows of one turn are ordered by role, then by the MD5 of the text; null roles and texts are one space; a null conv_id is a
conversation like others; a role that begins with other letters than s, u or a can't be kept; texts are equal if their MD5 is; further columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .shared import materialize, small_batches

# Costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

SEGMENT_ROWS = 100_000
SHORT_RUN = 64
INF = 1 << 40

START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)  # the state an inserted or reroled row leads to
ROLE = ("", "", "user", "assistant")
END = np.array([0, 2 * INSERT, INSERT, 0])  # the cheapest inserts after the last row
CLASSES = " sua"  # a symbol is 3 * class + fault; fault: 0 none, 1 truncated, 2 must be deleted
KEEPS = ((), ((START, SYSTEM),), ((START, USER), (SYSTEM, USER), (ASSISTANT, USER)), ((USER, ASSISTANT),))


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Min-plus product of a matrix with a matrix or a vector."""
    out = (a[:, :, None] + b[None]).min(1) if b.ndim == 2 else (a + b[None]).min(1)
    return np.minimum(out, INF)


def _edits(symbol: int) -> list[tuple[str, int, int, int]]:
    """``(letter, from, to, cost)`` of the edits of a row, inserts aside."""
    kind, fault = divmod(symbol, 3)
    out = [("D", s, s, DELETE) for s in range(4)]
    if fault < 2:
        more = TRUNCATED * fault
        out += [("K", s, t, more) for s, t in KEEPS[kind]] + [("R", s, NEXT[s], REROLE + more) for s in range(4)]
    return out


@lru_cache(None)
def transition(symbol: int) -> np.ndarray:
    """Costs from state to state over one row, inserts before it included."""
    inserts = np.full((4, 4), INF)
    for s in range(4):
        inserts[s, s] = 0
        inserts[s, NEXT[s]] = min(inserts[s, NEXT[s]], INSERT)
        inserts[s, NEXT[NEXT[s]]] = min(inserts[s, NEXT[NEXT[s]]], 2 * INSERT)
    own = np.full((4, 4), INF)
    for _, s, t, c in _edits(symbol):
        own[s, t] = min(own[s, t], c)
    return _times(inserts, own)


_powers: dict[int, list[np.ndarray]] = {}


def power(symbol: int, k: int) -> np.ndarray:
    """The transition of ``2 ** k`` equal rows."""
    known = _powers.setdefault(symbol, [transition(symbol)])
    while len(known) <= k:
        known.append(_times(known[-1], known[-1]))
    return known[k]


def advance(symbol: int, n: int, after: np.ndarray) -> np.ndarray:
    """Costs-to-go before a run of n rows, from those after it (a vector, or the columns of a matrix)."""
    k = 0
    while n:
        if n & 1:
            after = _times(power(symbol, k), after)
        n >>= 1
        k += 1
    return after


@lru_cache(1 << 16)
def _letters(symbol: int, n: int, state: int, after: tuple[int, ...]) -> tuple[str, int]:
    to_go = [np.array(after)]
    for _ in range(n):
        to_go.append(_times(transition(symbol), to_go[-1]))
    edits = [sorted(e for e in _edits(symbol) if e[1] == s) for s in range(4)]  # D before K before R
    out = []
    while n:
        here, then = to_go[n][state], to_go[n - 1]
        delete = edits[state][0]
        if delete[3] + then[state] == here:
            out.append("D")
            n -= 1
        elif INSERT + to_go[n][NEXT[state]] == here:
            out.append("I")
            state = NEXT[state]
        else:
            letter, _, state, _ = next(e for e in edits[state][1:] if e[3] + then[e[2]] == here)
            out.append(letter)
            n -= 1
    return "".join(out), state


def unroll(symbol: int, n: int, state: int, after: np.ndarray) -> tuple[str, int]:
    """Letters and last state of a run of n rows; ``after`` are the costs-to-go behind it."""
    if n <= SHORT_RUN:
        return _letters(symbol, n, state, tuple((after - after.min()).tolist()))
    half = 1 << ((n - 1).bit_length() - 1)
    first, state = unroll(symbol, half, state, advance(symbol, n - half, after))
    second, state = unroll(symbol, n - half, state, after)
    return first + second, state


def collapse(symbols) -> list[tuple[int, int]]:
    """Runs ``(symbol, n)`` of pairs ``(symbol, n)``."""
    runs: list[list[int]] = []
    for s, n in symbols:
        if runs and runs[-1][0] == s:
            runs[-1][1] += n
        elif n:
            runs.append([s, n])
    return [tuple(r) for r in runs]


def walk(runs: list[tuple[int, int]], state: int, after: np.ndarray) -> tuple[str, int]:
    """Audit and last state of a segment."""
    to_go = [after]
    for s, n in reversed(runs):
        to_go.append(advance(s, n, to_go[-1]))
    out = []
    for i, (s, n) in enumerate(runs):
        letters, state = unroll(s, n, state, to_go[len(runs) - 1 - i])
        out.append(letters)
    return "".join(out), state


# ---------------------------------------------------------------- rows to segments

def _symbols(rows: DataFrame) -> DataFrame:
    """One row per distinct (conv_id, turn, role, text): keys, digest, how often, flags, and if it is the first of its role and text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    blank = ~text.rlike("[^\\x20\\x09-\\x0D]")
    d = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
                    F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.unhex(F.md5(text)).alias("digest"),
                    blank.alias("blank"), (~blank & ~text.rlike("[.!?][\\x20\\x09-\\x0D]*\\z")).alias("open"))
    s = d.groupBy("conv_id", "turn", "role", "digest", "blank", "open").agg(F.count(F.lit(1)).alias("n"))
    first = s.filter("NOT blank").groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn")).alias("t"))
    first = first.select(F.col("conv_id").alias("f_conv"), F.col("role").alias("f_role"), F.col("digest").alias("f_digest"),
                         F.col("t.turn").alias("f_turn"), F.lit(True).alias("is_first"))
    at = (s["conv_id"].eqNullSafe(first["f_conv"]) & (s["role"] == first["f_role"]) & (s["digest"] == first["f_digest"])
          & s["turn"].eqNullSafe(first["f_turn"]))
    return s.join(first, at, "left").select("conv_id", "turn", "role", "digest", "blank", "open", "n", "is_first")


_SEGMENTS = pa.schema([("seg", pa.int64()), ("conv_id", pa.int64()), ("turns", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())),
                       ("digests", pa.list_(pa.binary())), ("symbols", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())),
                       ("matrix", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("sums", pa.list_(pa.int64()))])
_SEGMENTS_SQL = ("seg bigint, conv_id bigint, turns array<bigint>, roles array<string>, digests array<binary>, symbols array<bigint>, "
                 "counts array<bigint>, matrix array<bigint>, ends array<bigint>, sums array<bigint>")


def _row_runs(symbol: int, n: int):
    """The symbols of n equal rows: the first one's own, the others are duplicates (or blank like it)."""
    return ((symbol, 1), (symbol - symbol % 3 + 2, n - 1))


def _segment(seg: int, conv, rows: list[tuple]) -> list:
    """What others need of a segment: its matrix; first and last class and turn; sums."""
    turns, roles, digests, symbols, counts, faults = zip(*rows)
    runs = collapse(p for s, n in zip(symbols, counts) for p in _row_runs(s, n))
    matrix = np.full((4, 4), INF)
    matrix[range(4), range(4)] = 0
    for s, n in reversed(runs):
        matrix = advance(s, n, matrix)
    known = [t for t in turns if t is not None]
    classes = collapse((s // 3, n) for s, n in zip(symbols, counts))
    sums = [sum(f[i] for f in faults) for i in range(3)]
    illegal = sum(n - 1 for _, n in classes) + sum(_illegal(a, b) for (a, _), (b, _) in zip(classes, classes[1:]))
    ends = [symbols[0] // 3, symbols[-1] // 3, known[0] if known else None, known[-1] if known else None]
    return [seg, conv, list(turns), list(roles), list(digests), list(symbols), list(counts), matrix.reshape(-1).tolist(), ends,
            [len(set(known)), *sums, illegal]]


def _illegal(a: int, b: int) -> bool:
    return CLASSES[a] + CLASSES[b] not in ("su", "ua", "au")


def _segments(batches):
    seg, conv, rows, out = None, None, [], []

    def table():
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), _SEGMENTS)], schema=_SEGMENTS)

    for batch in batches:
        for r in zip(*(batch[c].to_pylist() for c in ("pid", "conv_id", "turn", "role", "digest", "blank", "open", "n", "is_first"))):
            pid, conv_id, turn, role, digest, blank, is_open, n, is_first = r
            if seg is None:
                seg, conv = pid << 32, conv_id
            elif conv_id != conv or len(rows) >= SEGMENT_ROWS:
                out.append(_segment(seg, conv, rows))
                seg, conv, rows = seg + 1, conv_id, []
                if len(out) >= 2000 or len(out[-1][2]) >= SEGMENT_ROWS:
                    yield table()
                    out = []
            kind = max(CLASSES.find(role[:1]), 0) if role else 0
            fault = 2 if blank or not is_first else int(is_open)
            faults = (n if blank else 0, 0 if blank else n - (1 if is_first else 0), int(bool(is_first) and is_open))
            rows.append((turn, role, digest, 3 * kind + fault, n, faults))
    if rows:
        out.append(_segment(seg, conv, rows))
    if out:
        yield table()


# ---------------------------------------------------------------- segments of a conversation to each other

def _backwards(batches):
    """Per conversation: numbers of the whole, and the costs-to-go behind each of its segments."""
    for batch in batches:
        out = []
        for conv, parts in zip(batch["conv_id"].to_pylist(), batch["parts"].to_pylist()):
            parts.sort(key=lambda p: p["seg"])
            after, behind = END, []
            for p in reversed(parts):
                behind.append(after.tolist())
                after = _times(np.array(p["matrix"]).reshape(4, 4), after)
            turns, *sums = (sum(p["sums"][i] for p in parts) for i in range(5))
            low = high = None
            for a, p in zip([None, *parts], parts):
                if a is not None:
                    sums[3] += _illegal(a["ends"][1], p["ends"][0])
                if p["ends"][2] is not None:
                    turns -= high == p["ends"][2]  # a turn that goes on in the next segment
                    low, high = p["ends"][2] if low is None else low, p["ends"][3]
            gaps = 0 if low is None else high - low + 1 - turns
            out.append((conv, [gaps, *sums, int(after[START])], [p["seg"] for p in parts], behind[::-1]))
        cols = list(zip(*out)) if out else [[]] * 4
        types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], ["conv_id", "whole", "segs", "behind"])


def _runs_of(batch, i: int) -> list[tuple[int, int]]:
    return collapse(p for s, n in zip(batch["symbols"][i].as_py(), batch["counts"][i].as_py()) for p in _row_runs(s, n))


def _exits(batches):
    """The last state of each segment, by the state it begins in."""
    for batch in batches:
        exits = [[walk(_runs_of(batch, i), s, np.array(batch["after"][i].as_py()))[1] for s in range(4)] for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([batch["conv_id"], batch["seg"], pa.array(exits, pa.list_(pa.int64()))], ["conv_id", "seg", "exits"])


def _forwards(batches):
    for batch in batches:
        segs, states = [], []
        for parts in batch["parts"].to_pylist():
            state = START
            for p in sorted(parts, key=lambda p: p["seg"]):
                segs.append(p["seg"])
                states.append(state)
                state = p["exits"][state]
        yield pa.RecordBatch.from_arrays([pa.array(segs, pa.int64()), pa.array(states, pa.int64())], ["seg", "state"])


_ROW = pa.struct([("pos", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("turn", pa.int64()), ("was", pa.string()), ("digest", pa.binary())])


def _replay(batches):
    """Each segment's audit and the rows that stay, with the role they get and the key of their text."""
    for batch in batches:
        audits, stay = [], []
        for i in range(batch.num_rows):
            state = batch["state"][i].as_py()
            audit, last = walk(_runs_of(batch, i), state, np.array(batch["after"][i].as_py()))
            if batch["is_last"][i].as_py():
                audit += "I" * (END[last] // INSERT)
            rows = zip(*(batch[c][i].as_py() for c in ("turns", "roles", "digests", "counts")))
            left, kept, row = 0, [], None
            for pos, letter in enumerate(audit):
                if letter == "I":
                    state = NEXT[state]
                    kept.append((pos, letter, ROLE[state], None, None, None))
                    continue
                if not left:
                    row = next(rows)
                    left = row[3]
                left -= 1
                if letter == "K":
                    state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[row[1][0]]
                    kept.append((pos, letter, row[1], row[0], row[1], row[2]))
                elif letter == "R":
                    state = NEXT[state]
                    kept.append((pos, letter, ROLE[state], row[0], row[1], row[2]))
            audits.append(audit)
            stay.append([dict(zip((f.name for f in _ROW), k)) for k in kept])
        yield pa.RecordBatch.from_arrays([batch["conv_id"], batch["seg"], pa.array(audits, pa.string()), pa.array(stay, pa.list_(_ROW))],
                                         ["conv_id", "seg", "audit", "kept"])


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows(conv_id, turn, role, text)`` to two tables.

    Conversations: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit. Rows of the repaired conversations: conv_id, seg, pos (these
    two give their order), edit, role, text.
    """
    small_batches(rows)
    keys = ["conv_id", "turn", "role", "digest"]
    ordered = _symbols(rows).repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("pid", F.spark_partition_id().cast("bigint"))
    segs = materialize(ordered.mapInArrow(_segments, _SEGMENTS_SQL), "turn-segments")
    part = F.struct("seg", "matrix", "ends", "sums")
    whole = materialize(segs.groupBy("conv_id").agg(F.collect_list(part).alias("parts")).mapInArrow(
        _backwards, "conv_id bigint, whole array<bigint>, segs array<bigint>, behind array<array<bigint>>"), "turn-conversations")
    each = whole.select(F.size("segs").alias("n"), F.posexplode(F.arrays_zip("segs", "behind")).alias("i", "x"))
    each = each.select(F.col("x.segs").alias("seg"), F.col("x.behind").alias("after"), (F.col("i") == F.col("n") - 1).alias("is_last"), "n")
    cut = segs.join(each.filter("n > 1"), "seg").select("conv_id", "seg", "symbols", "counts", "after").mapInArrow(
        _exits, "conv_id bigint, seg bigint, exits array<bigint>")
    begins = cut.groupBy("conv_id").agg(F.collect_list(F.struct("seg", "exits")).alias("parts")).select("parts").mapInArrow(
        _forwards, "seg bigint, state bigint")
    begins = each.join(begins, "seg", "left").withColumn("state", F.coalesce("state", F.lit(START).cast("bigint")))
    row = "struct<pos:bigint,edit:string,role:string,turn:bigint,was:string,digest:binary>"
    edited = materialize(segs.join(begins, "seg").select(*segs.columns[:7], "after", "state", "is_last").mapInArrow(
        _replay, f"conv_id bigint, seg bigint, audit string, kept array<{row}>"), "turn-edits")

    audits = edited.groupBy(F.col("conv_id").alias("a_conv")).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("seg", "audit"))), lambda s: s["audit"]), "").alias("audit"))
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    numbers = whole.join(audits, F.col("conv_id").eqNullSafe(F.col("a_conv"))).select(
        "conv_id", *[F.col("whole")[i].alias(c) for i, c in enumerate(names)], "audit")

    kept = edited.select("conv_id", "seg", F.explode("kept").alias("k")).select("conv_id", "seg", "k.*")
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    texts = rows.select(F.col("conv_id").cast("bigint").alias("t_conv"), F.col("turn").cast("bigint").alias("t_turn"),
                        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("t_role"), F.unhex(F.md5(text)).alias("t_digest"), text.alias("text"))
    texts = texts.dropDuplicates(["t_conv", "t_turn", "t_role", "t_digest"])
    same = (kept["conv_id"].eqNullSafe(texts["t_conv"]) & kept["turn"].eqNullSafe(texts["t_turn"])
            & (kept["was"] == texts["t_role"]) & (kept["digest"] == texts["t_digest"]))
    columns = ["conv_id", "seg", "pos", "edit", "role"]
    stay = kept.filter("edit <> 'I'").join(texts, same).select(*columns, "text")
    return numbers, stay.unionByName(kept.filter("edit = 'I'").select(*columns, F.lit("").alias("text")))


# ---------------------------------------------------------------- the query: damage, digest

def damage(rows: DataFrame) -> DataFrame:
    """By crc32(``conv_id:turn``) % 20: 0 drops a row, 1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4 makes its role user."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h: Column = F.crc32(F.encode(F.concat(known("conv_id"), F.lit(":"), known("turn")), "UTF-8")) % 20
    text = F.when(h == 1, F.lit("")).when(h == 2, F.translate(known("text"), ".!?", "")).otherwise(known("text"))
    role = F.when(h == 4, F.lit("user")).otherwise(known("role"))
    times = F.when(h == 0, F.lit(0)).when(h == 3, F.lit(2)).otherwise(F.lit(1))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times)).alias("c")).drop("c")


def _digests(batches):
    """SHA-256 of each conversation's ``role:text`` lines; rows come in order, one conversation after the other."""
    conv, sha, begun = None, None, False
    for batch in batches:
        ids, digests = [], []
        for c, role, text in zip(*(batch[n].to_pylist() for n in ("conv_id", "role", "text"))):
            if begun and c == conv:
                sha.update(b"\n")
            else:
                if begun:
                    ids.append(conv)
                    digests.append(sha.hexdigest())
                conv, sha, begun = c, hashlib.sha256(), True
            sha.update(f"{role}:{text}".encode())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.string())], ["r_conv", "repaired_sha256"])
    if begun:
        yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([sha.hexdigest()])], ["r_conv", "repaired_sha256"])


def repair_report(conversations: DataFrame) -> DataFrame:
    """Each conversation damaged and repaired: its numbers, audit and the digest of its repaired rows."""
    numbers, repaired = repair(damage(conversations))
    lines = repaired.repartition("conv_id").sortWithinPartitions("conv_id", "seg", "pos").select("conv_id", "role", "text")
    digests = lines.mapInArrow(_digests, "r_conv bigint, repaired_sha256 string")
    numbers = numbers.withColumnRenamed("conv_id", "n_conv")
    ids = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    all_ = ids.join(numbers, ids["conv_id"].eqNullSafe(numbers["n_conv"]), "left").drop("n_conv")
    all_ = all_.join(digests, all_["conv_id"].eqNullSafe(digests["r_conv"]), "left").drop("r_conv")
    zeros = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    # Rows that are all deleted, or none at all, leave nothing to hash.
    return all_.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"),
                       F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
