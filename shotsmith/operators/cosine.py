"""Cosine ranking of a vector pool for every query vector.

Vectors are L2-normalised once per cell in numpy (norm clamped so a zero
vector scores 0), then every tile of a cell is one numpy matmul (``blocks``).
Scores are rounded to 6 decimals before ranking; ties go to the smaller id.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotsmith.operators.blocks import (BLOCK_ROWS, TopRows, grid_shape, ids_of, matrix_of,
                                        run_cells, tiles, to_cells, topk_rows, unit_rows)
from shotsmith.operators.ranking import rank_within

TILE = (256, 1024)      # query and pool rows of one product


def cosine_cell(k: int | None, exclude_self: bool):
    """The kernel of one cell."""
    def kernel(queries, pool):
        qi, pi = ids_of(queries), ids_of(pool)
        with np.errstate(all="ignore"):
            qm, pm = unit_rows(matrix_of(queries.column("v"))), unit_rows(matrix_of(pool.column("v")))
            if k is None:
                return topk_rows(qm @ pm.T, qi, pi, k, exclude_self)
            best = TopRows(qi, pi, k, exclude_self)
            for p_at in tiles(len(pi), TILE[1]):
                part = pm[p_at].T
                for q_at in tiles(len(qi), TILE[0]):
                    best.offer(q_at, p_at, qm[q_at] @ part)
        return best.frame()
    return kernel


def cosine_rank(queries: DataFrame, pool: DataFrame, k: int | None = 5,
                exclude_self: bool = False, q_id: str = "query_id", p_id: str = "cand_id",
                vec: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, cand_id, score) -- top k per query, or all (k=None)."""
    dbl = "array<double>"
    q = queries.select(F.col(q_id).alias("query_id"), F.col(vec).cast(dbl).alias("v"))
    p = pool.select(F.col(p_id).alias("cand_id"), F.col(vec).cast(dbl).alias("v"))
    n_q, n_pool = q.count(), p.count()
    cores = max(1, queries.sparkSession.sparkContext.defaultParallelism)
    cells = to_cells(q, p, "query_id", "cand_id", "v", *grid_shape(n_q, n_pool, cores, k, block_rows))
    scored = run_cells(cells, cosine_cell(k, exclude_self))
    ranked = rank_within(scored, ["query_id"],
                         [F.col("score").desc(), F.col("cand_id").asc()], k,
                         max_group_rows=n_pool)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"),
                         "cand_id", "score")
