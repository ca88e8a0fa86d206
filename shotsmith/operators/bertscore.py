"""M4 token-matching F1 (BERTScore without idf weights) and M5 MMR order.

For sentences a, b with L2-normalised token vectors:
  P = mean over b's tokens of the max cosine to a's tokens
  R = mean over a's tokens of the max cosine to b's tokens
  F1 = 2PR / (P + R)   (0 when P + R = 0; cosines may be negative)
F1 is symmetric, so which side is "candidate" does not matter.

M5: the relevance term of the original greedy MMR is the F1 to the query
and its diversity term is the same constant for every remaining candidate
at each step, so for lambda > 0 the greedy order is F1 descending with the
smaller id first on ties -- one ranking, no cubic loop.

Sentence token matrices ride in grid cells (``blocks``) bounded by their tokens.
Sentences of few tokens are worked by length: the cosines of their i-th and j-th
tokens are matrices over whole sentences, whose maxima need no segments.  Longer
ones take one matmul per tile of tokens, then ``np.maximum.reduceat``.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotsmith.operators.blocks import (BLOCK_ROWS, CELL_BLOCKS, TopRows, grid_shape, ids_of,
                                        matrix_of, run_cells, tiles, to_cells, topk_rows, unit_rows)
from shotsmith.operators.ranking import rank_within

MMR_LAMBDA = 0.5
TILE_TOKENS = 4096      # tokens a side of one product: the tile is 128 MiB of doubles
BLOCK_TOKENS = 1 << 16  # tokens a cell holds a side on average
SHORT = 8               # tokens of the sentences that are worked by length
TILE = (128, 256)       # query and pool sentences scored at a time


def token_sentences(tokens: DataFrame, sent_col: str, pos_col: str, vec_col: str,
                    id_name: str) -> DataFrame:
    """(id, toks ARRAY<ARRAY<DOUBLE>>) from long token rows, in token order
    (vectors as given; the F1 kernel normalises them).

    A sentence's tokens form one group; its size is the sentence length.
    """
    return (tokens.groupBy(F.col(sent_col).alias(id_name))
            .agg(F.array_sort(F.collect_list(F.struct(
                F.col(pos_col).alias("p"), F.col(vec_col).cast("array<double>").alias("v"))))
                 .alias("_t"))
            .select(id_name, F.col("_t.v").alias("toks")))


def _runs(lengths: np.ndarray, limit: int) -> list[np.ndarray]:
    """Indices of the non-empty sentences in runs of about ``limit`` tokens."""
    some = np.flatnonzero(lengths)
    if not len(some):
        return []
    run = (np.cumsum(lengths[some]) - lengths[some]) // limit
    return np.split(some, np.flatnonzero(np.diff(run)) + 1)


def _matrix(toks: list) -> np.ndarray:
    return unit_rows(np.vstack([np.asarray(list(t), dtype=np.float64) for t in toks if len(t)]))


def _f1(precision: np.ndarray, recall: np.ndarray) -> np.ndarray:
    denom = precision + recall
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(denom != 0, 2 * precision * recall / denom, 0.0)


class Sentences:
    """Unit token vectors of sentences, one after the other, and their lengths."""

    def __init__(self, units: np.ndarray, lengths: np.ndarray):
        self.units, self.lengths = units, lengths
        self.starts = np.cumsum(lengths) - lengths

    def rows(self, at: np.ndarray) -> np.ndarray:
        """The token rows of the sentences ``at``."""
        n = self.lengths[at]
        return self.units[np.repeat(self.starts[at] - np.cumsum(n) + n, n) + np.arange(n.sum())]

    def by_length(self, at: np.ndarray) -> tuple[list, np.ndarray]:
        """([(places in ``at``, tokens of each, their rows token by token)] of the
        short ones, places of the others)."""
        n = self.lengths[at]
        short = [(np.flatnonzero(n == size), size) for size in np.unique(n[(n > 0) & (n <= SHORT)])]
        return ([(where, size, self.units[(self.starts[at[where]] + np.arange(size)[:, None]).ravel()])
                 for where, size in short], np.flatnonzero(n > SHORT))


def _f1_short(size_q: int, q: np.ndarray, size_p: int, p: np.ndarray) -> np.ndarray:
    """F1 of sentences of ``size_q`` and of ``size_p`` tokens (rows token by token)."""
    n, m = len(q) // size_q, len(p) // size_p
    sim = q @ p.T
    recall, over_q = 0.0, [None] * size_p
    for i in range(size_q):
        best = None
        for j in range(size_p):
            part = sim[i * n:(i + 1) * n, j * m:(j + 1) * m]
            best = part if best is None else np.maximum(best, part)
            over_q[j] = part if over_q[j] is None else np.maximum(over_q[j], part)
        recall = recall + best
    return _f1(sum(over_q) / size_p, recall / size_q)


def _f1_long(q: Sentences, q_at: np.ndarray, p: Sentences, p_at: np.ndarray) -> np.ndarray:
    """F1 of any sentences; the token products are made in tiles of about
    TILE_TOKENS a side, so memory does not grow with the sentences' lengths."""
    f1 = np.zeros((len(q_at), len(p_at)))
    for p_run in _runs(p.lengths[p_at], TILE_TOKENS):
        pm, pl = p.rows(p_at[p_run]), p.lengths[p_at[p_run]]
        p_off = np.cumsum(pl) - pl
        for q_run in _runs(q.lengths[q_at], TILE_TOKENS):
            ql = q.lengths[q_at[q_run]]
            q_off = np.cumsum(ql) - ql
            sim = q.rows(q_at[q_run]) @ pm.T
            best_over_p = np.maximum.reduceat(sim, p_off, axis=1)      # q tokens x p sents
            best_over_q = np.maximum.reduceat(sim, q_off, axis=0)      # q sents x p tokens
            recall = np.add.reduceat(best_over_p, q_off, axis=0) / ql[:, None]
            precision = np.add.reduceat(best_over_q, p_off, axis=1) / pl[None, :]
            f1[np.ix_(q_run, p_run)] = _f1(precision, recall)
    return f1


def f1_tile(q: Sentences, q_at: np.ndarray, p: Sentences, p_at: np.ndarray) -> np.ndarray:
    """F1 of the sentences ``q_at`` and ``p_at``; one without tokens scores 0."""
    f1 = np.zeros((len(q_at), len(p_at)))
    q_short, q_long = q.by_length(q_at)
    p_short, p_long = p.by_length(p_at)
    for qw, size_q, qm in q_short:
        for pw, size_p, pm in p_short:
            part = _f1_short(size_q, qm, size_p, pm)
            if part.shape == f1.shape:
                return part
            f1[np.ix_(qw, pw)] = part
    q_any = np.flatnonzero(q.lengths[q_at])
    if len(p_long) and len(q_any):
        f1[np.ix_(q_any, p_long)] = _f1_long(q, q_at[q_any], p, p_at[p_long])
    p_rest = np.flatnonzero((p.lengths[p_at] > 0) & (p.lengths[p_at] <= SHORT))
    if len(q_long) and len(p_rest):
        f1[np.ix_(q_long, p_rest)] = _f1_long(q, q_at[q_long], p, p_at[p_rest])
    return f1


def f1_matrix(q_toks: list, p_toks: list) -> np.ndarray:
    """F1 of every (query sentence, pool sentence) pair of two lists of token
    matrices."""
    sides = []
    for toks in (q_toks, p_toks):
        lengths = np.array([len(t) for t in toks], dtype=np.int64)
        if not lengths.sum():
            return np.zeros((len(q_toks), len(p_toks)))
        sides.append(Sentences(_matrix(toks), lengths))
    return f1_tile(sides[0], np.arange(len(q_toks)), sides[1], np.arange(len(p_toks)))


def _sentences_of(table) -> Sentences:
    import pyarrow.compute as pc
    toks = table.column("toks")
    lengths = pc.list_value_length(toks).to_numpy().astype(np.int64)
    units = matrix_of(pc.list_flatten(toks)) if lengths.sum() else np.zeros((0, 1))
    return Sentences(unit_rows(units), lengths)


def bertscore_rank(queries: DataFrame, pool: DataFrame, k: int | None = 5,
                   exclude_self: bool = False,
                   block_rows: int = BLOCK_ROWS // 2) -> DataFrame:
    """(query_id, rank, cand_id, f1): pool sentences by F1 to each query.

    queries: (query_id, toks); pool: (cand_id, toks) -- see token_sentences.
    """
    # One pass over the pool: row count, mean tokens.
    probe = pool.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("toks")).alias("t")).first()
    n_pool, most = int(probe["n"]), int(BLOCK_TOKENS / max(1.0, probe["t"] or 1.0))
    block_rows = max(1, min(block_rows, most if k is None else math.ceil(most / CELL_BLOCKS)))
    cores = max(1, queries.sparkSession.sparkContext.defaultParallelism)
    shape = grid_shape(queries.count(), n_pool, cores, k, block_rows)
    cells = to_cells(queries, pool, "query_id", "cand_id", "toks", *shape)

    def kernel(q_table, p_table):
        qi, pi = ids_of(q_table), ids_of(p_table)
        q, p = _sentences_of(q_table), _sentences_of(p_table)
        if k is None:
            return topk_rows(f1_tile(q, np.arange(len(qi)), p, np.arange(len(pi))), qi, pi, k, exclude_self)
        best = TopRows(qi, pi, k, exclude_self)
        for p_at in tiles(len(pi), TILE[1]):
            for q_at in tiles(len(qi), TILE[0]):
                best.offer(q_at, p_at, f1_tile(q, q_at, p, p_at))
        return best.frame()

    scored = run_cells(cells, kernel)
    ranked = rank_within(scored, ["query_id"],
                         [F.col("score").desc(), F.col("cand_id").asc()], k,
                         max_group_rows=n_pool)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "cand_id",
                         F.col("score").alias("f1"))


def mmr_rank(queries: DataFrame, pool: DataFrame, k: int | None = 10,
             lam: float = MMR_LAMBDA, exclude_self: bool = False) -> DataFrame:
    """M5: the greedy MMR order of the original = F1 DESC, id ASC (lambda > 0)."""
    if lam <= 0:
        raise ValueError("lambda must be > 0")
    return bertscore_rank(queries, pool, k, exclude_self).select("query_id", "rank", "cand_id")
