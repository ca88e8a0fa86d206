"""Seeded random permutations of 0..n-1 as column expressions.

``permuted`` maps a place to a position by a Feistel network over a grid of
``a x b >= n`` cells: rounds add a seeded hash of one coordinate to the other,
so every key has its own permutation, and place i can be drawn without knowing
the places before it -- no rejection rounds, no distinct step, nothing written.

Cells beyond n are walked over: their image is permuted again until it lies
below n.  A cycle holds at most ``a * b - n`` such cells, which bounds the walk
exactly; ``grid`` looks for sides that leave few (mostly none or one).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from shotsmith.functions.hashing import seeded_draw, sql_seeded_hash

ROUNDS = 6
SIDES = 64     # sides tried, from the square root of n up


def grid(n: int) -> tuple[int, int]:
    """(a, b) with the least ``a * b >= n`` among ``SIDES`` nearly square grids."""
    root = math.isqrt(max(n, 1) - 1) + 1
    return min(((a, -(-n // a)) for a in range(root, root + SIDES)), key=lambda s: (s[0] * s[1], s[0]))


def permuted(place: Column, n: Column | int, a: Column | int, b: Column | int, seed: int,
             *parts: Column | str | int) -> Column:
    """Position (BIGINT) at ``place`` of the permutation of 0..n-1 that belongs to
    ``seed`` and ``parts``; ``a`` and ``b`` come from ``grid(n)``."""
    n, a, b = [(F.lit(x) if isinstance(x, int) else x).cast("bigint") for x in (n, a, b)]

    def turn(x, r):
        col = F.pmod(x, b)
        row = ((x - col) / b).cast("bigint")
        down = F.pmod(row + seeded_draw(seed, a, *parts, r, col), a) * b + col
        along = row * b + F.pmod(col + seeded_draw(seed, b, *parts, r, row), b)
        return F.when(r % 2 == 0, down).otherwise(along)

    def walk(x, step):
        return F.when((step > 0) & (x < n), x).otherwise(
            F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), x, turn))

    return F.aggregate(F.sequence(F.lit(0).cast("bigint"), a * b - n), place.cast("bigint"), walk)


def sql_grid(counts: str) -> str:
    """A query giving ``n, a, b`` of ``grid`` for the row counts ``n`` of a query."""
    return f"""SELECT n, a, (n + a - 1) // a AS b
FROM ({counts}) c, (SELECT unnest(range(0, {SIDES})) AS i) s, LATERAL (
  SELECT CAST(ceil(sqrt(c.n)) AS BIGINT) + s.i AS a) t
QUALIFY row_number() OVER (PARTITION BY n ORDER BY a * ((n + a - 1) // a), a) = 1"""


def sql_permuted(place: str, n: str, a: str, b: str, seed: int, *parts: str) -> str:
    """The same permutation as SQL text (for oracles)."""
    row, col = f"(x // {b})", f"(x % {b})"
    turn = (f"CASE WHEN r % 2 = 0 THEN (({row} + {sql_seeded_hash(seed, *parts, 'r', col)} % {a}) % {a}) * {b} + {col} "
            f"ELSE {row} * {b} + ({col} + {sql_seeded_hash(seed, *parts, 'r', row)} % {b}) % {b} END")
    once = f"list_reduce(list_concat([y], range(0, {ROUNDS})), lambda x, r: {turn})"
    return (f"list_reduce(list_concat([{place}], range(0, 1 + {a} * {b} - {n})), "
            f"lambda y, t: CASE WHEN t > 0 AND y < {n} THEN y ELSE {once} END)")
