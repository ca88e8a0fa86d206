"""Block pairing for exact all-pairs similarity (M2 cosine, M4 token F1).

Exact top-k similarity has to look at every (query, candidate) pair; the
question is only how.  Queries are hashed to rows and the pool to columns of a
grid; every query row is sent to each cell of its grid row, every pool row to
each cell of its column, and one task works one cell.  Cells hold up to
``CELL_BLOCKS * block_rows`` rows a side, so what is shuffled is the input
times the number of grid rows or columns (one, up to that many rows), nothing
passes through the driver, and a task's memory does not grow with the tables.

Inside a cell the matrix products are made tile by tile (``TopRows`` keeps the
best k of each query so far and looks only at scores that reach its k-th), so
pair rows never exist as Spark rows.  A final ``row_number <= k`` per query
(WindowGroupLimit) merges the winners of the cells.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotsmith.session import ship_package


BLOCK_ROWS = 2048
CELL_BLOCKS = 24            # blocks a side of one grid cell
CELL_PAIRS = 1 << 16        # pairs below which a cell is not cut to occupy more cores
CELL_FOUND = 4_000_000      # rows one cell puts out at most
BROADCAST_BYTES = 256 * 1024 * 1024
SCORE_DECIMALS = 6
ROUND_SLACK = 6e-7          # a score this far below a rounded one may round up to it
STRICT = 4e-7               # a score less than this above a rounded one rounds to it at most
NORM_EPS = 1e-12
NONE = np.iinfo(np.int64).max

PAIR_SCHEMA = "query_id bigint, cand_id bigint, score double"


def grid_shape(n_q: int, n_p: int, cores: int, k: int | None, block_rows: int) -> tuple[int, int]:
    """(grid rows, grid columns).  A full ranking puts out all pairs of a cell, so
    its cells are one block a side; otherwise small tables are cut by query until
    there are a few cells a core."""
    cell = block_rows if k is None else CELL_BLOCKS * block_rows
    q_cell = cell if k is None else min(cell, max(block_rows, CELL_FOUND // max(1, k)))
    cols = max(1, math.ceil(n_p / cell))
    some = min(math.ceil(3 * cores / cols), math.ceil(n_q * n_p / CELL_PAIRS / cols), n_q)
    return max(1, math.ceil(n_q / q_cell), some), cols


def _cut(df: DataFrame, id_col: str, n: int) -> F.Column:
    return F.pmod(F.xxhash64(F.col(id_col)), F.lit(n)).cast("int")


def to_cells(queries: DataFrame, pool: DataFrame, q_id: str, p_id: str, payload: str | list[str],
             n_rows: int, n_cols: int) -> DataFrame:
    """(q_block, p_block, of_pool, id, *payload): all rows of every cell.

    The cells are range-partitioned, about one a task; adaptive execution keeps a
    numbered repartition as is (a plain shuffle would be merged into a few tasks,
    being small in bytes though heavy in work downstream).
    """
    payload = [payload] if isinstance(payload, str) else payload

    def every(n: int) -> F.Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    q = queries.select(_cut(queries, q_id, n_rows).alias("q_block"), F.lit(False).alias("of_pool"),
                       F.col(q_id).alias("id"), *payload).withColumn("p_block", every(n_cols))
    p = pool.select(_cut(pool, p_id, n_cols).alias("p_block"), F.lit(True).alias("of_pool"),
                    F.col(p_id).alias("id"), *payload).withColumn("q_block", every(n_rows))
    return q.unionByName(p).repartitionByRange(n_rows * n_cols, "q_block", "p_block")


def run_cells(cells: DataFrame, kernel: Callable, schema: str = PAIR_SCHEMA) -> DataFrame:
    """``kernel(queries, pool)`` on the two Arrow tables of every cell that has
    both, each in id order; it returns one pandas frame."""
    import pyarrow as pa
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema
    out_schema = to_arrow_schema(StructType.fromDDL(schema))

    def run(table):
        table = table.sort_by([("id", "ascending")])
        at = table.column("of_pool")
        pool = table.filter(at)
        queries = table.filter(pa.compute.invert(at))
        if not pool.num_rows or not queries.num_rows:
            return out_schema.empty_table()
        return pa.Table.from_pandas(kernel(queries, pool), schema=out_schema, preserve_index=False)

    ship_package(cells.sparkSession)
    return cells.groupBy("q_block", "p_block").applyInArrow(run, schema)


def ids_of(table) -> np.ndarray:
    return table.column("id").to_numpy().astype(np.int64)


def matrix_of(column) -> np.ndarray:
    """A list column of equally long vectors as one matrix; a null component is NaN."""
    import pyarrow.compute as pc
    sizes = pc.list_value_length(column)
    if sizes.null_count or len(pc.unique(sizes)) > 1:
        raise ValueError("vectors are null or differ in length")
    flat = pc.list_flatten(column).to_numpy().astype(np.float64, copy=False)
    return flat.reshape(len(column), -1)


def unit_rows(m: np.ndarray) -> np.ndarray:
    """Rows scaled to unit L2 norm; the norm is clamped so zero rows stay zero."""
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.maximum(n, NORM_EPS)


def topk_rows(scores: np.ndarray, q_ids: np.ndarray, p_ids: np.ndarray, k: int | None,
              exclude_self: bool, descending_ids: bool = False) -> pd.DataFrame:
    """Top k per query row of a score block: score DESC, then id ASC.  A NaN
    score counts as minus infinity: the candidate ranks last and stays."""
    s = np.round(scores, SCORE_DECIMALS)
    s = np.where(np.isnan(s), -np.inf, s)
    self_pair = (q_ids[:, None] == p_ids[None, :]) if exclude_self else np.zeros(s.shape, bool)
    tie = -p_ids if descending_ids else p_ids
    order = np.lexsort((np.broadcast_to(tie, s.shape), -s, self_pair), axis=-1)
    if k is not None:
        order = order[:, :k]
    top = np.take_along_axis(s, order, axis=1)
    qs = np.repeat(q_ids, order.shape[1])
    ps = p_ids[order.ravel()]
    vals = top.ravel()
    keep = ~np.take_along_axis(self_pair, order, axis=1).ravel()
    return pd.DataFrame({"query_id": qs[keep], "cand_id": ps[keep], "score": vals[keep]})


class TopRows:
    """The best k pool rows of every query row, gathered tile by tile: the same
    rows as ``topk_rows`` over all tiles side by side.

    ``p_ids`` ascend, so a tie goes to the smaller position.  A tile is compared
    with the k-th score so far (at first: the tile's own k-th); only what reaches
    it is rounded and sorted."""

    def __init__(self, q_ids: np.ndarray, p_ids: np.ndarray, k: int, exclude_self: bool):
        self.q_ids, self.p_ids, self.k, self.exclude_self = q_ids, p_ids, k, exclude_self
        self.score = np.full((len(q_ids), k), -np.inf)
        self.at = np.full((len(q_ids), k), NONE)

    def offer(self, rows: np.ndarray, at: np.ndarray, scores: np.ndarray) -> None:
        """``scores[i, j]`` of query row ``rows[i]`` and pool position ``at[j]``
        (ascending); the array may be overwritten."""
        k, m = self.k, scores.shape[1]
        if not k or not scores.size:
            return
        if np.isnan(scores.min()):
            scores[np.isnan(scores)] = -np.inf
        if self.exclude_self:
            ids = self.p_ids[at]
            low, high = (np.searchsorted(ids, self.q_ids[rows], side) for side in ("left", "right"))
            for step in range(int((high - low).max())):
                hit = np.flatnonzero(low + step < high)
                scores[hit, low[hit] + step] = -np.inf
        floor = self.score[rows, k - 1]
        free = np.flatnonzero(np.isneginf(floor))
        if len(free) and m > k:
            floor[free] = np.round(np.partition(scores[free], m - k, axis=1)[:, m - k], SCORE_DECIMALS)
        # behind the k-th place a tie is lost: only what rounds to more can enter
        lost = np.isfinite(self.score[rows, k - 1]) & (self.at[rows, k - 1] < at[0])
        flat = np.flatnonzero(scores >= (floor + np.where(lost, STRICT, -ROUND_SLACK))[:, None])
        r = flat // m
        c = flat - r * m
        v = np.round(scores.ravel()[flat], SCORE_DECIMALS)
        keep = v >= floor[r]
        if self.exclude_self:
            keep &= self.q_ids[rows][r] != self.p_ids[at][c]
        r, c, v = r[keep], c[keep], v[keep]
        if not len(r):
            return
        # of the rows that tie with the floor the first k can stay
        tied = v == floor[r]
        nth = np.cumsum(tied)
        first = np.searchsorted(r, r)
        keep = ~tied | (nth - (nth - tied)[first] <= k)
        r, c, v = r[keep], c[keep], v[keep]
        touched = np.unique(r)
        mine = rows[touched]
        all_r = np.concatenate((np.repeat(touched, k), r))
        all_v = np.concatenate((self.score[mine].ravel(), v))
        all_at = np.concatenate((self.at[mine].ravel(), at[c]))
        order = np.lexsort((all_at, -all_v, all_r))
        best = order[np.searchsorted(all_r[order], touched)[:, None] + np.arange(k)]
        self.score[mine], self.at[mine] = all_v[best], all_at[best]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, pool position, score) of what was kept."""
        r, c = np.nonzero(self.at != NONE)
        return r, self.at[r, c], self.score[r, c]

    def frame(self) -> pd.DataFrame:
        r, at, v = self.found()
        return pd.DataFrame({"query_id": self.q_ids[r], "cand_id": self.p_ids[at], "score": v})


def tiles(n: int, size: int) -> list[np.ndarray]:
    return [np.arange(at, min(n, at + size)) for at in range(0, n, size)]
