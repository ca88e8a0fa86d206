"""Approximate nearest neighbours by collision counting.

Every vector is projected on ``PROJECTIONS`` random lines (a fixed seed), and
each line's projections are kept as one sorted array.  A query opens a window
centred on its own projection on every line; virtual rehashing widens all
windows by the factor ``GROWTH`` at a time.  A vector that lies in at least
``SHARE`` of the windows has collided often enough and is verified by its true
distance.  The widening ends when k verified vectors are no farther than the
radius the windows stand for, or when every vector was verified.

Every row is indexed, block by block.  Null and zero vectors, and vectors with
null or non-finite components, take no part.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotsmith.llm.blocks import search, usable

PROJECTIONS = 40
GROWTH = 1.25
WIDTH = 2.8          # window width at radius 1 (vectors that near fall in it 84 times in 100)
SHARE = 0.75
SEED = 20_11
CELLS = 200_000      # queries x rows counted at a time


def unit(*vectors: np.ndarray) -> float:
    """A power of two that brings every component to at most 1, so that no
    projection overflows; scaling by it changes no digit."""
    top = max(float(np.abs(v).max(initial=0.0)) for v in vectors)
    return 2.0 ** -min(max(int(np.frexp(top)[1]), -1000), 1024)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows; where squares leave the range of a double,
    rows are scaled first (infinite only if the distance itself is too large)."""
    with np.errstate(over="ignore", under="ignore"):
        diff = a - b
        out = np.sqrt((diff * diff).sum(axis=1))
        odd = np.flatnonzero(~((out > 1e-140) & (out < 1e140)))
        half = a[odd] / 2 - b[odd] / 2
        big = np.abs(half).max(axis=1, initial=0.0)
        part = half / np.where(big > 0, big, 1.0)[:, None]
        out[odd] = 2 * (big * np.sqrt((part * part).sum(axis=1)))
    return out


class Index:
    def __init__(self, points: np.ndarray, scale: float = 1.0):
        rng = np.random.default_rng(SEED)
        self.points, self.scale = points, scale
        self.lines = rng.standard_normal((points.shape[1], PROJECTIONS))
        self.scaled = points * scale
        self.square = (self.scaled * self.scaled).sum(axis=1)
        at = self.scaled @ self.lines
        order = np.argsort(at, axis=0, kind="stable").T
        self.value = np.take_along_axis(at.T, order, axis=1)
        # line x row -> place on the line, in the narrowest type that holds n
        self.place = np.empty(order.shape, np.uint16 if len(points) < 1 << 16 else np.uint32)
        np.put_along_axis(self.place, order, np.arange(len(points), dtype=self.place.dtype)[None], axis=1)
        self.start = max(float(at.std(axis=0).mean()) * 0.5, 1e-12)

    def _collisions(self, lo: np.ndarray, size: np.ndarray) -> np.ndarray:
        """(query, row): on how many lines the row's place is in the query's window
        of ``size`` places from ``lo`` on."""
        kind = self.place.dtype
        out = np.zeros((lo.shape[1], len(self.points)), np.uint8)
        for place, first, length in zip(self.place, lo.astype(kind), size.astype(kind)):
            out += place[None, :] - first[:, None] < length[:, None]     # places below wrap round
        return out

    def query(self, queries: np.ndarray, k: int, skip: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (rows, distances) of its k nearest found; its row
        ``skip`` (-1: none) takes no part.  All queries widen their windows
        together; a finished query keeps its windows.

        Squared distances come from one matrix product, with a bound of their
        rounding; where that leaves a comparison open, and for the rows that can
        be among the k nearest, the true distance decides."""
        m = len(queries)
        near = queries * self.scale
        centre = near @ self.lines
        norm = (near * near).sum(axis=1)
        both = norm[:, None] + self.square[None, :]
        rough = both - 2 * (near @ self.scaled.T)
        far = np.sqrt(2 * both)                             # no distance is larger
        grain = np.finfo(float).smallest_subnormal * 8 * self.scale
        slack = both * (16 * (queries.shape[1] + 8) * np.finfo(float).eps) + (2 * far + grain) * grain + 1e-280
        slack[far >= 1e308 * self.scale] = np.inf           # the distance itself may overflow
        seen = np.zeros((m, len(self.points)), bool)
        own = np.flatnonzero(skip >= 0)
        seen[own, skip[own]] = True
        rough[own, skip[own]], slack[own, skip[own]] = np.inf, 0
        least = int(np.ceil(SHARE * PROJECTIONS))
        open_ = np.arange(m)
        radius = self.start
        while len(open_):
            half = WIDTH * radius / 2
            c = centre[open_].T
            lo = np.stack([np.searchsorted(v, x - half, "left") for v, x in zip(self.value, c)])
            hi = np.stack([np.searchsorted(v, x + half, "right") for v, x in zip(self.value, c)])
            got = seen[open_] | (self._collisions(lo, hi - lo) >= least)
            seen[open_] = got
            off = rough[open_] - radius * radius
            edge = slack[open_]
            close = (got & (off < -edge)).sum(axis=1)
            q, r = np.nonzero(got & (np.abs(off) <= edge))
            if len(q):
                d = self._true(queries, open_[q], r)
                close += np.bincount(q[d * self.scale <= radius], minlength=len(open_))
            open_ = open_[(close < k) & ~got.all(axis=1)]
            radius *= GROWTH
        # rows that can be among the k nearest of those seen
        rough[~seen] = np.inf
        slack[~seen] = 0
        top = rough + slack
        if len(self.points) > k:
            limit = np.partition(top, k - 1, axis=1)[:, k - 1]
        else:
            limit = np.full(m, np.inf)
        who, rows = np.nonzero((rough - slack <= limit[:, None]) & (rough < np.inf))
        dist = self._true(queries, who, rows)
        best = np.lexsort((rows, dist, who))
        edge = np.searchsorted(who[best], np.arange(m + 1))
        return [(rows[best[a:b][:k]], dist[best[a:b][:k]]) for a, b in zip(edge[:-1], edge[1:])]

    def _true(self, queries: np.ndarray, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        out = np.empty(len(q))
        for i in range(0, len(q), 100_000):
            out[i:i + 100_000] = distances(self.points[rows[i:i + 100_000]], queries[q[i:i + 100_000]])
        return out


def nearest(rows: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): neighbours of the rows whose id is
    divisible by ``every``; score is the Euclidean distance."""
    def meet(qid, queries, pid, points):
        index = Index(points, unit(points, queries))
        at = np.minimum(np.searchsorted(pid, qid), len(pid) - 1)
        skip = np.where(pid[at] == qid, at, -1)
        step = max(1, CELLS // len(points))
        got = [g for i in range(0, len(qid), step)
               for g in index.query(queries[i:i + step], k, skip[i:i + step])]
        return (np.repeat(qid, [len(r) for r, _ in got]), pid[np.concatenate([r for r, _ in got])],
                np.concatenate([d for _, d in got]))

    vectors = usable(rows, F.col("embedding")).where(F.exists("v", lambda x: x != 0))
    return search(vectors, F.col("vec_id") % every == 0, k, meet, "double", F.col("score"))
