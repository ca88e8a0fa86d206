"""Seeded permutations of positions, against SQL and for their spread."""
import math
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from shotsmith.functions.permutation import grid, permuted, sql_grid, sql_permuted


@pytest.mark.parametrize("n", [1, 2, 3, 7, 30, 97, 399, 1000])
def test_every_position_once_as_in_sql(spark, n):
    a, b = grid(n)
    assert 0 <= a * b - n < 64
    assert duckdb.sql(sql_grid(f"SELECT CAST({n} AS BIGINT) AS n")).fetchall() == [(n, a, b)]
    got = [tuple(r) for r in spark.range(3).withColumnRenamed("id", "q").withColumn(
        "i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select(
        "q", "i", permuted(F.col("i"), n, a, b, 5, "q").alias("p")).collect()]
    for q in range(3):
        assert sorted(p for k, _, p in got if k == q) == list(range(n))
    want = duckdb.sql(f"""SELECT q, i, {sql_permuted('i', str(n), str(a), str(b), 5, 'q')}
        FROM range(0, 3) q(q), range(0, {n}) i(i)""").fetchall()
    assert sorted(got) == sorted(want)


def test_grid_of_large_counts():
    for n in (10 ** 6 + 3, 10 ** 9 + 7, 10 ** 12 + 39):
        a, b = grid(n)
        assert a * b >= n and a * b - n < 2 * math.isqrt(n)


def test_first_places_are_uniform(spark):
    """Chi-squared of the first and last place over keys, and of neighbours."""
    n, keys = 10, 4000
    rows = spark.range(keys).withColumnRenamed("id", "q").select(
        *[permuted(F.lit(i), n, *grid(n), 1, "q").alias(f"p{i}") for i in (0, 1, 9)]).collect()
    for c in ("p0", "p1", "p9"):
        chi = sum((x - keys / n) ** 2 / (keys / n) for x in Counter(r[c] for r in rows).values())
        assert chi < 33        # 9 degrees of freedom: beyond 1 in 7,000
    pairs = Counter((r["p0"], r["p1"]) for r in rows)
    assert len(pairs) == n * (n - 1)
    chi = sum((x - keys / 90) ** 2 / (keys / 90) for x in pairs.values())
    assert chi < 145           # 89 degrees of freedom
