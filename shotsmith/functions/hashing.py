"""Seeded, engine-independent pseudo-random numbers.

Every random choice is ``md5("seed:part:part...")``; its first 15 hex digits
read as a non-negative BIGINT.  Spark and other SQL engines compute the same
value, so random operators can be checked against an independent oracle and
re-run with the same result after a lost executor.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_key(seed: int, *parts: Column | str | int) -> Column:
    cols = [F.lit(str(seed))]
    for p in parts:
        if isinstance(p, Column):
            cols.append(p.cast("string"))
        elif isinstance(p, int):
            cols.append(F.lit(str(p)))
        else:
            cols.append(F.col(p).cast("string"))
    return F.concat_ws(":", *cols)


def seeded_hash(seed: int, *parts: Column | str | int) -> Column:
    """Uniform 60-bit BIGINT from md5 of the seeded key."""
    return F.conv(F.substring(F.md5(seeded_key(seed, *parts)), 1, 15), 16, 10) \
        .cast("bigint")


def seeded_draw(seed: int, n: Column | int, *parts: Column | str | int) -> Column:
    """Uniform draw in [0, n)."""
    n_col = F.lit(n) if isinstance(n, int) else n
    return F.pmod(seeded_hash(seed, *parts), n_col.cast("bigint"))


def sql_seeded_hash(seed: int, *parts: str) -> str:
    """The same hash as DuckDB/ANSI-ish SQL text (for oracles)."""
    key = " || ':' || ".join([f"'{seed}'"] + [f"CAST({p} AS VARCHAR)" for p in parts])
    return f"CAST(('0x' || substr(md5({key}), 1, 15)) AS BIGINT)"
