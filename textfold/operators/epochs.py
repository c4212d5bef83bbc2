"""E7 without a sort per epoch: a keyed bijection of positions.

Rows get their place in one shuffled order once. An epoch's order is a permutation of [0, n) that is computed from a row's place alone: the place
is written as two digits of base about the root of n, and rounds add to each digit, in turn, a keyed function of the other
one (modulo its base), which any key can undo. The two digits reach a little beyond n; a place that falls there is permuted again until it
is inside, which keeps the whole a bijection. No epoch moves a row or reads another one.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, functions as F

ROUNDS = 4
PRIME = (1 << 31) - 1
# Fewer than root(n) of the n + root(n) places lie outside, so a walk of this length is never seen; one that goes on raises.
WALKS = 32


def round_keys(seed: int, epoch: int) -> list[int]:
    """Eight numbers below ``PRIME`` for each round."""
    return [int(hashlib.md5(f"{seed}|{epoch}|{i}".encode()).hexdigest()[:8], 16) % (PRIME - 1) + 1 for i in range(8 * ROUNDS)]


def _mixed(x: Column, key: Column, at: int) -> Column:
    y = (x * key[at] + key[at + 1]) % PRIME
    return ((y * y % PRIME) * key[at + 2] + key[at + 3]) % PRIME


def permuted(place: Column, n: Column, seed: int, epoch: int) -> Column:
    """The epoch's position of ``place`` in [0, n); n is at most 2**61."""
    a = F.greatest(F.ceil(F.sqrt(n)).cast("bigint"), F.lit(1).cast("bigint"))
    b = F.call_function("div", n + a - 1, a)
    keys = round_keys(seed, epoch)
    rounds = F.array(*[F.array(*[F.lit(k).cast("bigint") for k in keys[8 * r:8 * r + 8]]) for r in range(ROUNDS)])

    def once(s: Column, key: Column) -> Column:
        x = (s["x"] + _mixed(s["y"], key, 0)) % s["a"]
        return F.struct(x.alias("x"), ((s["y"] + _mixed(x, key, 4)) % s["b"]).alias("y"), s["a"].alias("a"), s["b"].alias("b"))

    def walk(s: Column) -> Column:
        start = F.struct(F.call_function("div", s["v"], s["b"]).alias("x"), (s["v"] % s["b"]).alias("y"), s["a"].alias("a"), s["b"].alias("b"))
        v = F.aggregate(rounds, start, once, lambda e: e["x"] * e["b"] + e["y"])
        return F.struct(v.alias("v"), s["a"].alias("a"), s["b"].alias("b"), s["n"].alias("n"))

    begin = F.struct(place.cast("bigint").alias("v"), a.alias("a"), b.alias("b"), n.alias("n"))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), F.transform(F.array(begin), walk)[0],
                      lambda s, _: F.when(s["v"] < s["n"], s).otherwise(walk(s)), lambda s: s["v"])
    return F.transform(F.array(end), lambda v: F.when(v < n, v).otherwise(F.raise_error(F.lit("a position's walk didn't end")).cast("bigint")))[0]


def epoch_positions(ranked: DataFrame, seed: int, epochs: list[int], place: str = "position", out: str = "epoch_position") -> DataFrame:
    """Rows of ``ranked`` (each with its 0-based place in one order) once per epoch, with ``epoch`` and the position in it."""
    counted = ranked.withColumn("__n", ranked.select(F.count(F.lit(1))).scalar())
    each = F.array(*[F.struct(F.lit(e).alias("epoch"), permuted(F.col(place), F.col("__n"), seed, e).alias(out)) for e in epochs])
    return counted.withColumn("__e", F.explode(each)).select(*ranked.columns, "__e.*")
