"""Exact top-k inner products by dual-tree cover-tree search.

Queries and data of a block pair are each indexed by a cover tree: a node has a
centre and a covering radius; its children's centres are chosen farthest first,
so they stand apart, until they cover its points within ``SHRINK`` times that
radius (or there are enough of them to fill leaves), and each point goes to the
nearest.  The search walks both trees together.  For a pair of nodes

    <q, p>  <=  <cq, cp> + rq |cp| + rp |cq| + rq rp

bounds every product between them, and the pair is pruned when the bound is
below the worst kth score of all queries in the query node.  Equal bounds are
kept, so ties are decided exactly.

Components are floor(256 x); products are integers and exact.  Vectors without
components meet each other only, with product 0.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotsmith.llm.blocks import search, usable

SHRINK = 0.7
LEAF = 64
STEP = 16             # data nodes that a query leaf opens at a time


class Tree:
    """Nodes in arrays; a node's points are the slice lo:hi of ``order``."""

    def __init__(self, points: np.ndarray):
        self.points = points.astype(np.float64)
        self.order = np.arange(len(points))
        self.lo, self.hi, self.kids, self.centre, self.radius = [], [], [], [], []
        self._build(0, len(points), self.points[0])
        self.centres = np.array(self.centre)
        self.radii = np.array(self.radius) * (1 + 1e-9) + 1e-6     # safe against rounding
        self.norms = np.sqrt((self.centres ** 2).sum(axis=1))

    def _build(self, lo: int, hi: int, centre: np.ndarray) -> int:
        node = len(self.lo)
        own = self.order[lo:hi].copy()
        dist = np.sqrt(((self.points[own] - centre) ** 2).sum(axis=1))
        radius = float(dist.max())
        self.lo.append(lo)
        self.hi.append(hi)
        self.kids.append([])
        self.centre.append(centre)
        self.radius.append(radius)
        if hi - lo <= LEAF or radius == 0:
            return node
        cover = radius * SHRINK
        part = np.zeros(len(own), np.int64)
        near = dist                        # distance to the nearest centre so far
        centres = [centre]
        most = max(2, 2 * len(own) // LEAF)
        while len(centres) < most and near.max() > cover:
            new = self.points[own[int(near.argmax())]]
            d = np.sqrt(((self.points[own] - new) ** 2).sum(axis=1))
            part[d < near] = len(centres)
            near = np.minimum(near, d)
            centres.append(new)
        by = np.argsort(part, kind="stable")
        self.order[lo:hi] = own[by]
        edge = np.searchsorted(part[by], np.arange(len(centres) + 1))
        for c, a, b in zip(centres, edge[:-1].tolist(), edge[1:].tolist()):
            if b > a:
                self.kids[node].append(self._build(lo + a, lo + b, c))
        return node


class Search:
    def __init__(self, queries: np.ndarray, points: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int):
        """``own``: for each query its row among ``points``, or -1."""
        self.q, self.p, self.ids, self.own, self.k = Tree(queries), Tree(points), ids, own, k
        top = [max(float(np.abs(v).max(initial=0)), 1.0) for v in (queries, points)]
        big = top[0] * top[1] * queries.shape[1]
        kind = np.float64 if big < 2 ** 53 else np.int64 if big < 2 ** 62 else object
        self.qv = queries[self.q.order].astype(kind)
        self.pv = points[self.p.order].astype(kind)
        n = len(queries)
        self.found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in range(n)]   # by query place
        self.kth = np.full(n, -np.inf)

    def run(self):
        self._walk(0, np.array([0]))
        return self.found

    def _bound(self, qn: int, nodes: np.ndarray) -> np.ndarray:
        q, p = self.q, self.p
        rq, rp = q.radii[qn], p.radii[nodes]
        top = (p.centres[nodes] @ q.centres[qn] + rq * p.norms[nodes] + rp * q.norms[qn] + rq * rp)
        return top * (1 + 1e-9 * np.sign(top)) + 1e-3

    def _walk(self, qn: int, nodes: np.ndarray) -> None:
        q = self.q
        lo, hi = q.lo[qn], q.hi[qn]
        nodes = nodes[self._bound(qn, nodes) >= self.kth[lo:hi].min()]
        if q.kids[qn]:
            nodes = np.array([c for n in nodes.tolist() for c in (self.p.kids[n] or [n])], np.int64)
            for child in q.kids[qn]:
                self._walk(child, nodes)
            return
        while len(nodes):                               # best bound first
            bound = self._bound(qn, nodes)
            live = bound >= self.kth[lo:hi].min()
            nodes, bound = nodes[live], bound[live]
            if not len(nodes):
                return
            take = nodes[np.argsort(-bound, kind="stable")[:STEP]]
            nodes = np.setdiff1d(nodes, take, assume_unique=True)
            inner = [c for n in take.tolist() for c in self.p.kids[n]]
            leaves = [n for n in take.tolist() if not self.p.kids[n]]
            if leaves:
                self._leaves(lo, hi, leaves)
            if inner:
                nodes = np.concatenate((nodes, np.array(inner, np.int64)))

    def _leaves(self, lo: int, hi: int, leaves: list[int]) -> None:
        at = np.concatenate([np.arange(self.p.lo[n], self.p.hi[n]) for n in leaves])
        score = self.qv[lo:hi] @ self.pv[at].T
        rows = self.p.order[at]
        for i in range(lo, hi):
            s = score[i - lo]
            use = s >= self.kth[i]
            own = self.own[self.q.order[i]]
            if own >= 0:
                use = use & (rows != own)
            if not use.any():
                continue
            ids = np.concatenate((self.found[i][0], self.ids[rows[use]]))
            got = np.concatenate((self.found[i][1], s[use].astype(np.int64)))
            best = np.lexsort((ids, -got))[: self.k]
            self.found[i] = (ids[best], got[best])
            if len(best) == self.k:
                self.kth[i] = float(got[best[-1]])


def top_products(rows: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows whose id is divisible by ``every``."""
    def meet(qid, queries, pid, points):
        at = np.minimum(np.searchsorted(pid, qid), len(pid) - 1)
        own = np.where(pid[at] == qid, at, -1)
        run = Search(queries.astype(np.int64), points.astype(np.int64), pid, own, k)
        found = run.run()
        which = np.concatenate([np.full(len(f[0]), qid[run.q.order[i]]) for i, f in enumerate(found)])
        return which, np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    vec = F.transform(F.col("embedding"), lambda x: F.when(
        x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.floor(256 * x.cast("double"))).cast("double"))
    return search(usable(rows, vec), F.col("vec_id") % every == 0, k, meet, "bigint", F.desc("score"))
