"""Exact cosine top k that ships vectors only where bounds allow.

The pool is dealt to clusters around at most ``sqrt(n)`` of its own rows.  A
cluster's radius is the largest angle between its centre and a member, so by
the triangle inequality no member of it is nearer to a query than
``angle(query, centre) - radius``.

1. Every query meets the clusters of best bound until they hold k other rows;
   the k-th score found there is the query's floor.
2. Clusters whose bound is below the floor are dropped for the query before any
   vector is shipped; the query meets the rest.

The clusters are laid out on the columns of a grid (``blocks``), small ones side
by side, a large one over several; queries are hashed to its rows.  A query row
is shipped once to each column that holds a cluster it must meet (not once a
cluster), a pool row once to each grid row, and inside a cell a query meets its
clusters only.  Which clusters a query meets travels as a bit string.

Zero and non-finite vectors have no angle: they form a cluster that
is never dropped.  Rows without a vector take no part.  The rows equal those of
``cosine_rank``; how much is dropped depends on the data (nothing, where vectors
have no clusters).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotsmith.operators.blocks import (BLOCK_ROWS, TopRows, grid_shape, ids_of, matrix_of,
                                        run_cells, tiles, unit_rows)
from shotsmith.operators.cosine import TILE
from shotsmith.operators.ranking import rank_within
from shotsmith.session import checkpoint_dir, ship_package

CENTRE_BYTES = 32 * 1024 * 1024     # the centres sent to every task
ANGLE_SLACK = 1e-7                  # rounding of arccos near 1
SCORE_SLACK = 2e-6                  # scores are rounded to 6 decimals
MIX = np.uint64(0x9E3779B97F4A7C15)      # spreads ids over a cluster's slices
STEP_CELLS = 4_000_000              # query x centre cells of one numpy step


def _matrix(values, dim: int) -> np.ndarray:
    out = np.zeros((len(values), dim))
    for i, v in enumerate(values):
        out[i] = v
    return out


def _centres(pool: DataFrame, n: int, dim: int) -> np.ndarray:
    """At most sqrt(n) unit vectors of the pool, CENTRE_BYTES in all."""
    most = max(1, min(math.isqrt(max(n - 1, 0)) + 1, CENTRE_BYTES // (8 * dim)))
    rows = pool.orderBy(F.xxhash64("cand_id"), "cand_id").limit(most).select("v").collect()
    m = _matrix([r["v"] for r in rows], dim)
    m = m[np.isfinite(m).all(axis=1)]
    m = unit_rows(m)
    return m[np.abs(np.linalg.norm(m, axis=1) - 1) < 1e-6]


def _steps(batches, centres: np.ndarray):
    """(frame, unit vectors, angles to the centres, rows without an angle) of
    slices of the batches."""
    dim = centres.shape[1]
    size = max(1, STEP_CELLS // max(1, len(centres)))
    for pdf in batches:
        for at in range(0, len(pdf), size):
            part = pdf.iloc[at: at + size]
            m = _matrix(part["v"].tolist(), dim)
            with np.errstate(all="ignore"):
                u = unit_rows(m)
                apart = ~(np.abs(np.linalg.norm(u, axis=1) - 1) < 1e-6)
            u[apart] = 0.0
            yield part, u, np.arccos(np.clip(u @ centres.T, -1.0, 1.0)), apart


def _place(pool: DataFrame, centres: np.ndarray) -> DataFrame:
    """(cand_id, v, cluster, angle); cluster ``len(centres)`` holds rows without an angle."""
    sent = pool.sparkSession.sparkContext.broadcast(centres)    # CENTRE_BYTES at most

    def run(batches):
        for part, _, angle, apart in _steps(batches, sent.value):
            if angle.shape[1]:
                near = angle.argmin(axis=1)
                far = angle[np.arange(len(near)), near]
            else:
                near, far = np.zeros(len(part), np.int64), np.zeros(len(part))
            yield part.assign(cluster=np.where(apart, len(sent.value), near).astype(np.int32),
                              angle=np.where(apart, 0.0, far))

    return pool.mapInPandas(run, "cand_id bigint, v array<double>, cluster int, angle double")


def _choose(queries: DataFrame, centres: np.ndarray, radius: np.ndarray, held: np.ndarray,
            k: int, first: bool) -> DataFrame:
    """(query_id, v, clusters, met): ``queries`` (query_id, v[, floor]) with the bits
    of the clusters to meet, those of best bound (``first``) or all others the
    floor leaves, and the rows these hold."""
    sent = queries.sparkSession.sparkContext.broadcast((centres, radius, held))

    def run(batches):
        middle, reach, count = sent.value
        for part, _, angle, apart in _steps(batches, middle):
            bound = np.cos(np.maximum(0.0, angle - reach - ANGLE_SLACK))
            bound[apart] = 1.0
            # rows without an angle come last here, and are never dropped below
            order = np.argsort(np.hstack((-bound, np.full((len(part), 1), 2.0))), axis=1, kind="stable")
            before = np.cumsum(count[order], axis=1) - count[order]
            seeds = np.zeros(order.shape, bool)
            np.put_along_axis(seeds, order, before <= k, axis=1)
            if first:
                keep = seeds
            else:
                floor = part["floor"].to_numpy(np.float64)[:, None]
                keep = ~seeds & (np.hstack((bound, np.ones((len(part), 1)))) + SCORE_SLACK >= floor)
                keep[:, -1] = ~seeds[:, -1]
            keep &= count > 0
            yield pd.DataFrame({"query_id": part["query_id"], "v": part["v"],
                                "clusters": [r.tobytes() for r in np.packbits(keep, axis=1)],
                                "met": keep @ count})

    return queries.mapInPandas(run, "query_id bigint, v array<double>, clusters binary, met bigint").where("met > 0")


class _Layout:
    """Which grid columns hold which clusters: column ``first[c] + i`` has slice i of
    cluster c's ``slices[c]``."""

    def __init__(self, held: np.ndarray, n_cols: int):
        size = max(1, math.ceil(held.sum() / n_cols))
        self.slices = np.maximum(1, np.ceil(held / size)).astype(np.int64)
        # a large cluster has columns of its own, the others share them in turn
        self.first, col, used = np.zeros(len(held), np.int64), 0, 0
        for c, n in enumerate(held):
            if used and used + n > size:
                col, used = col + 1, 0
            self.first[c] = col
            if self.slices[c] > 1:
                col, used = col + int(self.slices[c]), 0
            else:
                used += n
        self.n_cols = col + 1 if used or not col else col

    def of_clusters(self, keep: np.ndarray) -> list[np.ndarray]:
        """The columns each row of cluster flags needs."""
        need = np.zeros((len(keep), self.n_cols), bool)
        for c in np.flatnonzero(keep.any(axis=0)):
            need[:, self.first[c]: self.first[c] + self.slices[c]] |= keep[:, c, None]
        return [np.flatnonzero(r).astype(np.int32) for r in need]


def _flags(bits, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(bits), np.uint8).reshape(len(bits), -1), axis=1, count=n).astype(bool)


def _meet(chosen: DataFrame, n_chosen: int, placed: DataFrame, held: np.ndarray, k: int,
          exclude_self: bool, block_rows: int) -> DataFrame:
    """(query_id, cand_id, score): each query's best k of each cell it meets."""
    spark = chosen.sparkSession
    cores = max(1, spark.sparkContext.defaultParallelism)
    n_rows, n_cols = grid_shape(n_chosen, int(held.sum()), cores, k, block_rows)
    layout = _Layout(held, n_cols)
    sent = spark.sparkContext.broadcast(layout)     # a number or two a cluster
    clusters = len(held)

    def deal(batches):
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["query_id"], "v": pdf["v"], "clusters": pdf["clusters"],
                                "cols": sent.value.of_clusters(_flags(pdf["clusters"], clusters))})

    def place(batches):
        for pdf in batches:
            c = pdf["cluster"].to_numpy()
            mixed = pdf["cand_id"].to_numpy().astype(np.uint64) * MIX >> np.uint64(33)
            yield pd.DataFrame({"id": pdf["cand_id"], "v": pdf["v"], "cluster": pdf["cluster"],
                                "p_block": (sent.value.first[c] + mixed.astype(np.int64) % sent.value.slices[c]).astype(np.int32)})

    none = F.lit(None)
    q = (chosen.mapInPandas(deal, "id bigint, v array<double>, clusters binary, cols array<int>")
         .select(F.pmod(F.xxhash64("id"), F.lit(n_rows)).cast("int").alias("q_block"),
                 F.explode("cols").alias("p_block"), F.lit(False).alias("of_pool"), "id", "v", "clusters",
                 none.cast("int").alias("cluster")))
    p = (placed.mapInPandas(place, "id bigint, v array<double>, cluster int, p_block int")
         .select(F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1))).alias("q_block"), "p_block",
                 F.lit(True).alias("of_pool"), "id", "v", none.cast("binary").alias("clusters"), "cluster"))
    cells = q.unionByName(p).repartitionByRange(n_rows * layout.n_cols, "q_block", "p_block")

    def kernel(queries, pool):
        qi, pi = ids_of(queries), ids_of(pool)
        flags = _flags(queries.column("clusters").to_pylist(), clusters)
        cluster = pool.column("cluster").to_numpy()
        best = TopRows(qi, pi, k, exclude_self)
        with np.errstate(all="ignore"):
            qm, pm = unit_rows(matrix_of(queries.column("v"))), unit_rows(matrix_of(pool.column("v")))
            order = np.argsort(cluster, kind="stable")      # ids ascend inside a cluster
            for members in np.split(order, np.flatnonzero(np.diff(cluster[order])) + 1):
                rows = np.flatnonzero(flags[:, cluster[members[0]]])
                for p_at in tiles(len(members), TILE[1]):
                    part = pm[members[p_at]].T
                    for q_at in tiles(len(rows), TILE[0]):
                        best.offer(rows[q_at], members[p_at], qm[rows[q_at]] @ part)
        return best.frame()

    return run_cells(cells, kernel)


def pruned_cosine_rank(queries: DataFrame, pool: DataFrame, k: int = 5,
                       exclude_self: bool = False, q_id: str = "query_id",
                       p_id: str = "cand_id", vec: str = "embedding",
                       block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """((query_id, rank, cand_id, score), (query_id, met)): the exact top k, and
    how many pool rows each query met."""
    spark = queries.sparkSession
    ship_package(spark)
    checkpoint_dir(spark)
    have = F.col("v").isNotNull()
    q = queries.select(F.col(q_id).alias("query_id"), F.col(vec).cast("array<double>").alias("v")).where(have)
    p = pool.select(F.col(p_id).alias("cand_id"), F.col(vec).cast("array<double>").alias("v")).where(have)
    probe = p.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    n = int(probe[0])
    dim = max(int((probe if n else q.agg(F.lit(0), F.max(F.size("v"))).first())[1] or 0), 1)
    centres = _centres(p, n, dim).reshape(-1, dim)
    placed = _place(p, centres).checkpoint(eager=True)
    # at most one row per centre
    stats = placed.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("far")).collect()
    radius, held = np.zeros(len(centres)), np.zeros(len(centres) + 1, np.int64)
    for r in stats:
        held[r["cluster"]] = r["n"]
        if r["cluster"] < len(centres):
            radius[r["cluster"]] = r["far"]
    placed = placed.drop("angle")

    start = _choose(q, centres, radius, held, k, first=True).checkpoint(eager=True)
    found = _meet(start, start.count(), placed, held, k, exclude_self, block_rows).checkpoint(eager=True)
    order = [F.col("score").desc(), F.col("cand_id").asc()]
    found = rank_within(found, ["query_id"], order, k)
    floor = found.where(F.col("rank") == k).select(
        F.col("query_id").alias("_q"), F.col("score").alias("_s"))
    floored = q.join(floor, q["query_id"] == F.col("_q"), "left").select(
        "query_id", "v", F.coalesce("_s", F.lit(float("-inf"))).alias("floor"))
    rest = _choose(floored, centres, radius, held, k, first=False).checkpoint(eager=True)
    found = found.drop("rank").unionByName(
        _meet(rest, rest.count(), placed, held, k, exclude_self, block_rows))
    ranked = rank_within(found, ["query_id"], order, k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "cand_id", "score")
    met = start.select("query_id", "met").unionByName(rest.select("query_id", "met"))
    return ranked, met.groupBy("query_id").agg(F.sum("met").cast("bigint").alias("met"))
