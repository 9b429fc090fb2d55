"""A keyed permutation of 0 .. n - 1 as column arithmetic (H-5, H-7, H-9).

A Feistel network over the pairs (x div b, x mod b) of Z_a x Z_b, a and b about
the square root of n, maps a * b >= n numbers one to one; a number that lands at
n or beyond is mapped again until it lands below (cycle walking), which keeps the
map one to one on 0 .. n - 1.  At most a - 1 numbers exist beyond n, so one number
in about sqrt(n) walks at all.  Both directions are plain functions of (x, n,
seed): no order, no exchange, no state.  The draws are whole-number arithmetic, so
any SQL engine gives the same order.
"""

from __future__ import annotations

import hashlib
from math import isqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS = 4
#: 2^31 - 1: squares of smaller numbers fit 64 bits.
PRIME = 2_147_483_647
#: Steps of the walk tried before the rest of the longest possible walk.
FIRST_STEPS = 8


def sides(n: int) -> tuple[int, int]:
    """(a, b) with a * b >= n > a * b - a: a is the root of n, rounded up."""
    a = max(1, isqrt(max(0, n - 1)) + 1)
    return a, -(-n // a) if n > 0 else 1


def turn_keys(seed: int) -> list[tuple[int, int]]:
    """Two numbers below PRIME for every turn, from md5(seed | turn)."""
    out = []
    for turn in range(ROUNDS):
        h = hashlib.md5(f"{seed}|{turn}".encode()).hexdigest()
        out.append((int(h[:16], 16) % PRIME, int(h[16:], 16) % PRIME))
    return out


def _draw(x: Column, key1: Column, key2: Column) -> Column:
    """(x + key1)^2 + key2, squared again, modulo PRIME: 31 bits, in 64-bit numbers."""
    p = F.lit(PRIME)
    u = (x + key1) % p
    v = (u * u + key2) % p
    return v * v % p


def _network(x: Column, n: int, seed: int, back: bool) -> Column:
    """One pass over the whole of Z_a x Z_b, forward or back; a draw for a turn."""
    a, b = (F.lit(s).cast("long") for s in sides(n))
    turns = [F.struct(F.lit(t % 2 == 0).alias("even"), F.lit(k).cast("long").alias("k"), F.lit(m).cast("long").alias("m"))
             for t, (k, m) in enumerate(turn_keys(seed))]

    def pair(left: Column, right: Column) -> Column:
        return F.struct(left.alias("left"), right.alias("right"))

    def move(x: Column, d: Column, side: Column) -> Column:
        return F.pmod(x - d if back else x + d, side)

    def one(s: Column, t: Column) -> Column:
        return F.when(t["even"], pair(move(s["left"], _draw(s["right"], t["k"], t["m"]), a), s["right"])) \
                .otherwise(pair(s["left"], move(s["right"], _draw(s["left"], t["k"], t["m"]), b)))

    return F.aggregate(F.array(*(turns[::-1] if back else turns)),
                       pair(F.call_function("div", x, b), F.pmod(x, b)), one, lambda s: s["left"] * b + s["right"])


def _walk(x: Column, n: int, seed: int, back: bool) -> Column:
    a, b = sides(n)
    beyond = a * b - n  # a walk meets every number beyond n at most once
    first = min(beyond, FIRST_STEPS)

    def again(y: Column, _: Column) -> Column:
        return F.when(y < n, y).otherwise(_network(y, n, seed, back))

    def step(y: Column, i: Column) -> Column:
        out = F.when((i > 0) & (y < n), y)
        if beyond > first:
            last = F.when(y < n, F.lit(first + 1)).otherwise(F.lit(beyond))  # no constant: not built in the plan
            out = out.when(i > first, F.aggregate(F.sequence(F.lit(first + 1).cast("long"), last.cast("long")), y, again))
        return out.otherwise(_network(y, n, seed, back))

    x = F.when((x >= 0) & (x < n), x.cast("long"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(first + int(beyond > first))), x, step)


def permuted(x: Column, n: int, seed: int = 42) -> Column:
    """Where the seeded order of 0 .. n - 1 puts ``x``; NULL for NULL and for
    numbers outside the range.  n up to 2^60."""
    return _walk(x, n, seed, False)


def unpermuted(y: Column, n: int, seed: int = 42) -> Column:
    """Which number the seeded order has at place ``y``: the inverse."""
    return _walk(y, n, seed, True)
