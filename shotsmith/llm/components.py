"""Connected components of an edge table, as Spark joins and aggregations.

Alternating large-star and small-star steps: every step links neighbours to
the smallest id they see.  Each round is written once to the shared folder, so
a lost executor never replays earlier rounds, and the loop ends by itself when
a round changes nothing.  The edges of a vertex are dealt to SALTS parts: each
part is aggregated and joined on its own, and only one row a part meets by vertex,
so a hot vertex is spread over the tasks.  At most FEW edges are joined in one task:
their rounds would cost more in tasks than in work.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotsmith.llm.common import write_once


SALTS = 32      # parts of one vertex's edges
FEW = 100_000   # edges (1.6 MB) that one task takes


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link the neighbours of every vertex to the smallest of its star."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    both = both.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    part = both.groupBy("u", "s").agg(F.min("v").alias("least"))
    low = part.groupBy("u").agg(F.least(F.min("least"), F.col("u")).alias("low"))
    out = both.join(part.select("u", "s").join(low, "u"), ["u", "s"])
    if large:
        out = out.where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    else:
        out = out.select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(
            low.select("u", F.col("low").alias("v")))
    return out.where("u <> v").distinct()


def lowest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vertices of edges (u, v), and the smallest id each can reach."""
    ids, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u):]
    root = np.arange(len(ids))
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            return ids, ids[root]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))     # roots hang on smaller ones
        while ((up := root[root]) != root).any():
            root = up


def _at_once(batches):
    got = [(pdf["u"].to_numpy(np.int64), pdf["v"].to_numpy(np.int64)) for pdf in batches]
    if got:
        ids, component = lowest(*map(np.concatenate, zip(*got)))
        yield pd.DataFrame({"id": ids, "component": component})


def components(edges: DataFrame) -> DataFrame:
    """(id, component): every vertex of ``edges`` (u, v) with the smallest id it
    can reach.  Self-loops and repeated edges are allowed."""
    now = write_once(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                     .where("u <> v").distinct(), "edges")
    if now.count() <= FEW:
        return write_once(now.coalesce(1).mapInPandas(_at_once, "id bigint, component bigint"), "components")
    state = None
    while True:
        now = write_once(_star(_star(now, True), False), "edges")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == state:
            break
        state = tuple(seen)
    found = now.groupBy("u").agg(F.min("v").alias("component"))
    roots = now.select(F.col("v").alias("u")).distinct().join(found, "u", "left_anti").select(
        "u", F.col("u").alias("component"))
    return found.unionByName(roots).withColumnRenamed("u", "id")
