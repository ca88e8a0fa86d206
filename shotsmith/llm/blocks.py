"""Blocks of vectors: a stated query set against all rows.

Rows are hashed by id into about ``sqrt(n) / 4`` blocks, so block size and block
count both grow slowly; queries are cut into blocks of ``QUERIES`` and meet
every data block of their dimension.  Each meeting returns its best k per
query, and a window with a partial top-k merges them.

A vector takes no part if its id, itself or a component is null or a component
is not finite.  Rows that repeat an id count once (the smallest vector).
Vectors of different length never meet.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from shotsmith.llm.common import write_once

QUERIES = 4096


def usable(rows: DataFrame, vec: Column) -> DataFrame:
    """(vec_id, v ARRAY<DOUBLE>, dim): one row per id, whole finite vectors."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), vec.cast("array<double>").alias("v"))
            .where("vec_id IS NOT NULL AND v IS NOT NULL").where(finite)
            .groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v")))


def search(vectors: DataFrame, is_query: Column, k: int, meet, score: str, best_first) -> DataFrame:
    """``meet(qid, Q, pid, P) -> (query_id, vec_id, score) arrays`` on every
    block pair; the k best per query by ``best_first`` (a sort column)."""
    held = write_once(vectors, "vectors")
    n = held.count()
    blocks = max(1, math.ceil(math.sqrt(n) / 4))
    data = held.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    chosen = held.where(is_query)
    qblocks = max(1, math.ceil(chosen.count() / QUERIES))
    chosen = chosen.withColumn("qblock", F.pmod(F.hash("vec_id"), F.lit(qblocks)).cast("int"))
    key = ["dim", "block", "qblock"]
    left = chosen.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = data.withColumn("qblock", F.explode(F.sequence(F.lit(0), F.lit(qblocks - 1))))

    def run(q, p):
        if not len(q) or not len(p):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        q, p = q.sort_values("vec_id"), p.sort_values("vec_id")
        a, b, s = meet(q["vec_id"].to_numpy(), np.stack(q["v"].to_numpy()),
                       p["vec_id"].to_numpy(), np.stack(p["v"].to_numpy()))
        return pd.DataFrame({"query_id": a, "vec_id": b, "score": s})

    got = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(
        run, f"query_id bigint, vec_id bigint, score {score}")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(best_first, "vec_id"))
    return got.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
