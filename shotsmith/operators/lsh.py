"""M2, opt-in: approximate cosine top k by random-projection buckets.

``BucketedRandomProjectionLSH`` on unit vectors: a pair is scored if it shares
a bucket in at least one table, so neighbours can be missed; ``recall`` says how
many are.  Never the default.

Equal vectors are one row of the search (only the k + 1 smallest ids of a vector
can be among a query's first k, ties going to the smaller id), so a group of
copies costs one row, not all its pairs.  Zero, null and non-finite vectors take
no part.

How the pairs of a bucket are made depends on how many there are, counted from
the bucket sizes.  Narrow buckets are joined and their pairs made distinct
before vectors are fetched.  Where buckets hold a good part of all pairs (wide
ones: with many tables nearly every pair shares one) the rows meet in grid cells
(``blocks``) and a tile's scores count where the bucket numbers agree in a table.
Both score the same pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shotsmith.functions.vectors import dot, l2_norm, normalise
from shotsmith.operators.blocks import (BLOCK_ROWS, TopRows, grid_shape, ids_of, matrix_of,
                                        run_cells, tiles, to_cells)
from shotsmith.operators.cosine import TILE
from shotsmith.operators.ranking import rank_within
from shotsmith.session import checkpoint_dir

DENSE = 64      # joined pairs cost more than scoring all, if they are over 1 in so many

FOUND = "qn bigint, pn bigint, first bigint, score double"


def _units(df: DataFrame, id_col: str, vec: str) -> DataFrame:
    """(id, u, digest) of vectors with a finite norm above 0."""
    v = F.col(vec).cast("array<double>")
    norm = l2_norm(v)
    rows = df.where(F.col(vec).isNotNull()).where((norm > 0) & (norm < float("inf")))
    rows = rows.select(F.col(id_col).alias("id"), normalise(v).alias("u"))
    return rows.withColumn("digest", F.sha2(F.to_json("u"), 256))


def _score_met(asks: DataFrame, holds: DataFrame, k: int, dense: bool | None) -> DataFrame:
    """(qn, pn, first, score) of the rows (n, u, buckets[, ids]) that share a bucket
    in at least one table: all of them, or at least the best k of each."""
    def entries(rows: DataFrame, name: str) -> DataFrame:       # one row per vector and table
        return rows.select(F.col("n").alias(name), F.posexplode("buckets").alias("table", "bucket"))

    at = ["table", "bucket"]
    n_q, n_p = asks.count(), holds.count()
    if dense is None:
        sizes = entries(asks, "qn").groupBy(*at).agg(F.count(F.lit(1)).cast("double").alias("a")).join(
            entries(holds, "pn").groupBy(*at).agg(F.count(F.lit(1)).cast("double").alias("b")), at)
        dense = (sizes.agg(F.sum(F.col("a") * F.col("b"))).first()[0] or 0) * DENSE > n_q * n_p
    if not dense:
        met = entries(asks, "qn").join(entries(holds, "pn"), at).select("qn", "pn").distinct()
        return (met.join(asks.select(F.col("n").alias("qn"), F.col("u").alias("uq")), "qn")
                .join(holds.select(F.col("n").alias("pn"), F.col("u").alias("up"), F.col("ids")[0].alias("first")), "pn")
                .select("qn", "pn", "first", F.round(dot("uq", "up"), 6).alias("score")))

    cores = max(1, asks.sparkSession.sparkContext.defaultParallelism)
    cells = to_cells(asks, holds.withColumn("first", F.col("ids")[0]), "n", "first", ["n", "u", "buckets"],
                     *grid_shape(n_q, n_p, cores, k, BLOCK_ROWS))

    def kernel(queries, pool):
        qn, pn = (t.column("n").to_numpy() for t in (queries, pool))
        qm, pm = matrix_of(queries.column("u")), matrix_of(pool.column("u"))
        qb, pb = matrix_of(queries.column("buckets")).T.copy(), matrix_of(pool.column("buckets")).T.copy()
        best = TopRows(qn, ids_of(pool), k, False)
        for p_at in tiles(len(pm), TILE[1]):
            part, near = pm[p_at].T, pb[:, p_at]
            for q_at in tiles(len(qm), TILE[0]):
                share = np.zeros((len(q_at), len(p_at)), bool)
                for mine, other in zip(qb[:, q_at], near):
                    share |= mine[:, None] == other
                best.offer(q_at, p_at, np.where(share, qm[q_at] @ part, -np.inf))
        r, at, score = best.found()
        keep = np.isfinite(score)       # the others share no bucket
        r, at, score = r[keep], at[keep], score[keep]
        return pd.DataFrame({"qn": qn[r], "pn": pn[at], "first": best.p_ids[at], "score": score})

    return run_cells(cells, kernel, FOUND)


def cosine_lsh(queries: DataFrame, pool: DataFrame, k: int = 5, exclude_self: bool = False,
               q_id: str = "query_id", p_id: str = "cand_id", vec: str = "embedding",
               bucket: float = 0.1, tables: int = 10, seed: int = 123,
               dense: bool | None = None) -> DataFrame:
    """(query_id, rank, cand_id, score): at most k of each query's nearest.

    Wider buckets and more tables score more pairs and miss fewer neighbours.
    ``dense``: whether rows meet in grid cells (default: by the bucket sizes)."""
    checkpoint_dir(queries.sparkSession)
    q, p = _units(queries, q_id, vec), _units(pool, p_id, vec)
    first = p.withColumn("_r", F.row_number().over(Window.partitionBy("digest").orderBy("id"))) \
        .where(F.col("_r") <= k + 1)
    number = F.monotonically_increasing_id()        # of a written frame
    held = first.groupBy("digest").agg(F.first("u").alias("u"), F.sort_array(F.collect_list("id")).alias("ids"))
    held = held.select(number.alias("n"), "u", "ids").checkpoint(eager=True)
    asked = q.groupBy("digest").agg(F.first("u").alias("u"))
    asked = asked.select(number.alias("n"), "digest", "u").checkpoint(eager=True)
    model = BucketedRandomProjectionLSH(inputCol="vector", outputCol="buckets", bucketLength=bucket,
                                        numHashTables=tables, seed=seed)
    fitted = model.fit(held.limit(1).select(array_to_vector("u").alias("vector")))  # reads the length alone

    def hashed(rows: DataFrame) -> DataFrame:
        rows = fitted.transform(rows.withColumn("vector", array_to_vector("u"))).drop("vector")
        return rows.withColumn("buckets", F.array(*[vector_to_array(F.col("buckets")[i])[0] for i in range(tables)]))

    asks, holds = hashed(asked), hashed(held)
    pairs = _score_met(asks, holds, k + 1, dense)
    # k + 1 vectors hold k other ids, whichever of them is the query's own; tied
    # vectors go by their smallest id that can be taken
    best = rank_within(pairs, ["qn"], [F.col("score").desc(), F.col("first").asc()], k + 1).drop("rank")
    best = (best.join(held.select(F.col("n").alias("pn"), "ids"), "pn")
            .join(asked.select(F.col("n").alias("qn"), "digest"), "qn"))
    found = (q.select(F.col("id").alias("query_id"), "digest").join(best, "digest")
             .select("query_id", F.explode("ids").alias("cand_id"), "score"))
    if exclude_self:
        found = found.where(F.col("query_id") != F.col("cand_id"))
    return rank_within(found, ["query_id"], [F.col("score").desc(), F.col("cand_id").asc()], k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "cand_id", "score")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row (neighbours, found, recall): how many rows of an exact ranking an
    approximate one holds.  A candidate that ties with the last exact one counts."""
    last = exact.groupBy("query_id").agg(F.min("score").alias("_least"), F.count(F.lit(1)).alias("_k"))
    hits = found.join(last, "query_id").where(F.col("score") >= F.col("_least"))
    totals = last.agg(F.coalesce(F.sum("_k"), F.lit(0)).cast("bigint").alias("neighbours"))
    return totals.crossJoin(hits.agg(F.count(F.lit(1)).alias("found"))).withColumn(
        "recall", F.col("found") / F.col("neighbours"))
