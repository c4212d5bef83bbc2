"""Conversation repair against an exhaustive dynamic programme over whole audits."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from textfold.llm import turn_repair

SCHEMA = "conv_id long, turn long, role string, text string, seg int, audit string"
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
FULL = {"u": "user", "a": "assistant"}


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        h = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        out += [(conv, turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    return out


def best(rows):
    """(cost, audit, lines) by trying every edit at every row; the least (cost, audit) per last initial."""
    states = {"": (0, "", ())}
    rows = [*rows, None]
    for row in rows:
        while True:  # inserts before the row
            more = dict(states)
            for s, (c, a, lines) in states.items():
                x = (c + 3, a + "I", (*lines, f"{FULL[NEXT[s]]}:"))
                more[NEXT[s]] = min(more.get(NEXT[s], x), x)
            if more == states:
                break
            states = more
        if row is None:
            break
        role, text, fault = row
        then = {}

        def put(s, x):
            then[s] = min(then.get(s, x), x)
        for s, (c, a, lines) in states.items():
            put(s, (c + 4, a + "D", lines))
            if fault in ("", "truncated"):
                more = 3 if fault else 0
                put(NEXT[s], (c + 3 + more, a + "R", (*lines, f"{FULL[NEXT[s]]}:{text}")))
                i = role[:1]
                if (s, i) in {("", "s"), ("", "u"), ("s", "u"), ("a", "u"), ("u", "a")}:
                    put(i, (c + more, a + "K", (*lines, f"{role}:{text}")))
        states = then
    return min(states[s] for s in ("", "a") if s in states)


def report(rows, table=None):
    out = []
    rows, ids = damaged(rows), {r[0] for r in (table or rows)}
    for conv in ids:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.md5(r[3].encode()).digest()))
        seen, faults, symbols = set(), [], []
        for _, _, role, text in mine:
            solid = re.sub(r"[\x20\x09-\x0d]", "", text)
            f = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append(f)
            symbols.append((role, text, f))
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") or "" in (a[2], b[2]) for a, b in zip(mine, mine[1:]))
        cost, audit, lines = best(symbols)
        out.append((conv, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows):
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, turn_repair.repair_report(df).collect()), key=str)


def rows(seed, convs=60, longest=12):
    rng = random.Random(seed)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "usher", "User"]
    texts = ["Yes.", "No!", "what", "", " \t", None, "Why?\n", "a.\x0b", "é…", "Yes. ", "x.y", "long " * 500 + "."]
    out = []
    for c in range(convs):
        for t in range(rng.randrange(longest)):
            out.append((c if c else None, rng.choice([t, t, t, 3, None, t * 2]), rng.choice(roles[:rng.choice([3, 5, 10])]),
                        rng.choice(texts) if rng.random() < .5 else f"text {rng.random()}."))
    return out + rng.sample(out, len(out) // 5)


@pytest.mark.parametrize("seed, segment", [(1, 100_000), (2, 2), (3, 1)])
def test_repair(spark, monkeypatch, seed, segment):
    monkeypatch.setattr(turn_repair, "SEGMENT_ROWS", segment)
    data = rows(seed)
    want = report(data, data)
    got = run(spark, data)
    assert got == want
    assert any(w[6] for w in want) and any("I" in w[7] for w in want) and any("R" in w[7] for w in want)


def test_tables(spark):
    assert run(spark, []) == []
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    plain = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, turn_repair.repair_report(df).collect()), key=str) == report(plain, plain)


def test_repaired_rows_and_one_hot_conversation(spark):
    data = [(1, t, ("user", "assistant")[t // 3 % 2], f"{t % 50}.") for t in range(3000)] + [(2, 1, "user", "Hi.")] * 500 + [(2, 2, "system", "x")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    numbers, lines = turn_repair.repair(df)
    got = {r["conv_id"]: r for r in numbers.collect()}
    assert got[2]["duplicate"] == 499 and got[2]["audit"] == "K" + "D" * 499 + "R" and got[2]["cost"] == 499 * 4 + 6
    text = [r for r in lines.orderBy("conv_id", "seg", "pos").collect() if r["conv_id"] == 1]
    assert re.fullmatch("s?(ua)*", "".join(r["role"][0] for r in text)) and len(got[1]["audit"]) >= 3000
    assert sum({"D": 4, "R": 3, "I": 3, "K": 0}[c] for c in got[1]["audit"]) == got[1]["cost"]


def test_powers_are_steps():
    rng = np.random.default_rng(0)
    for symbol in range(12):
        after = rng.integers(0, 20, 4)
        step = after
        for n in range(1, 140):
            step = turn_repair._times(turn_repair.transition(symbol), step)
            assert (turn_repair.advance(symbol, n, after) == step).all()
            for state in range(4) if n > 120 else ():
                whole = turn_repair.unroll(symbol, n, state, after)
                assert whole == turn_repair._letters(symbol, n, state, tuple((after - after.min()).tolist()))
