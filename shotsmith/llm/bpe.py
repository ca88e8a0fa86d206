"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The words (pattern matches) of a batch of documents are collected once, and
all merges are replayed over that word list together: an inverted index from
the rank of a mergeable pair to the word positions that hold it is consumed in
rank order, and each merge updates only the two neighbours it touches.  The
result equals the usual lowest-rank-first, leftmost-first merge of each word.

A document's ids depend on its own text only, so the operator is one pass over
the documents: no shuffle, nothing gathered, any lost task is just run again.
Words seen before are kept in a bounded per-process table.

Null text: no ids.  Empty text: no ids.  Texts of any length are cut into
words in slices, so memory follows the slice, not the text.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotsmith.llm.common import by_chars

WORDS_KEPT = 800_000       # words in the per-process table
REPLAY_WORDS = 200_000     # words replayed together
# The published pattern (a fixed value) for which cutting at spaces is proved.
SPACED = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
INSIDE = re.compile(r"\s (?:\s|\Z)")   # a space inside a run of white space
MANY = 32                  # places of a rank that make a numpy step worth it
SLICE_CHARS = 4_000_000    # characters cut into words at a time


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Merges:
    """What every replay of one rank file needs.

    ``keys``/``made``: sorted pair keys (left id, right id) and the rank of the
    token they make -- every split of every token into two tokens, because a
    pair merges whenever its joined bytes are a token.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.pairs = pairs
        self.keys = np.fromiter(sorted(pairs), np.int64, len(pairs))
        self.made = np.fromiter((pairs[k] for k in self.keys.tolist()), np.int64, len(pairs))
        self.packed = np.arange(max(ranks.values(), default=-1) + 1, dtype=np.int32)
        self.packed = [r.tobytes() for r in self.packed]
        self.byte = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank made by each pair, -1 where the pair never merges."""
        if not len(self.keys):
            return np.full(len(left), -1, np.int64)
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.made[at], -1)


def replay(words: list[bytes], merges: Merges) -> list[bytes]:
    """Ids (int32, packed) of every word: all merges applied in rank order
    over all words.

    The symbols of all words lie in one flat array, linked by ``after`` and
    ``before``.  ``index`` maps the rank of a mergeable pair to the positions
    of its left symbols; ranks are taken in order, all places of a rank merge
    together and only the pairs with their two neighbours are entered anew.
    Ranks with many places run as numpy steps, ranks with few one by one.

    A new pair may rank below the merge that made it.  A word in which that
    happens is replayed alone, one merge at a time (``_replay_one``).
    """
    whole = [merges.ranks.get(w, -1) for w in words]
    out = [b"" if r < 0 else merges.packed[r] for r in whole]
    todo = [i for i, r in enumerate(whole) if r < 0 and words[i]]
    if not todo:
        return out
    length = np.array([len(words[i]) for i in todo], np.int64)
    end = np.cumsum(length)
    first = end - length
    total = int(end[-1])
    sym = merges.byte[np.frombuffer(b"".join([words[i] for i in todo]), np.uint8)]
    if (sym < 0).any():
        raise ValueError("the rank file lacks a single byte")
    owner = np.repeat(np.arange(len(todo)), length)
    after = np.arange(1, total + 2, dtype=np.int64)
    after[end - 1] = -1
    before = np.arange(-1, total, dtype=np.int64)
    before[first] = -1
    odd = np.zeros(len(todo), bool)

    rank = np.full(total, -1, np.int64)
    has = np.flatnonzero(after[:total] >= 0)
    rank[has] = merges.rank(sym[has], sym[after[has]])
    place = np.flatnonzero(rank >= 0)
    place = place[np.argsort(rank[place], kind="stable")]
    held, start = np.unique(rank[place], return_index=True)
    index = {r: p.tolist() for r, p in zip(held.tolist(), np.split(place, start[1:]))}
    heap = held.tolist()
    busy = float(MANY)
    while heap and busy >= MANY / 4:
        r = heapq.heappop(heap)
        p = np.array(index.pop(r), np.int64)
        busy += (len(p) - busy) / 64
        p = p[rank[p] == r]                      # stale: a neighbour has changed
        if not len(p):
            continue
        p.sort()
        if len(p) > 1:
            p = p[np.concatenate(([True], p[1:] != p[:-1]))]
        q = after[p]
        chained = np.concatenate(([False], p[1:] == q[:-1]))
        if chained.any():                        # a a a: the leftmost pair, then every other
            i = np.arange(len(p))
            p = p[(i - np.maximum.accumulate(np.where(chained, 0, i))) % 2 == 0]
            q = after[p]
        sym[p] = r
        sym[q] = -1
        nxt = after[q]
        after[p] = nxt
        rank[q] = -1
        right = p[nxt >= 0]
        before[nxt[nxt >= 0]] = right
        rank[p] = -1
        left = before[p]
        left = left[left >= 0]
        fresh = np.concatenate((right, left))
        got = merges.rank(sym[fresh], sym[after[fresh]])
        rank[fresh] = got
        live = got >= 0
        fresh, got = fresh[live], got[live]
        odd[owner[fresh[got < r]]] = True
        for where, g in zip(fresh.tolist(), got.tolist()):
            if g in index:
                index[g].append(where)
            else:
                index[g] = [where]
                heapq.heappush(heap, g)
    if heap:
        sym, late = _replay_sparse(sym, after, before, rank, index, heap, merges)
        odd[owner[late]] = True
    alive = sym >= 0
    flat = sym[alive].astype(np.int32).tobytes()
    stop = 4 * np.add.reduceat(alive, first).cumsum()
    for i, a, b in zip(todo, [0, *stop[:-1].tolist()], stop.tolist()):
        out[i] = flat[a:b]
    for i in np.flatnonzero(odd).tolist():
        out[todo[i]] = np.array(_replay_one(words[todo[i]], merges.ranks), np.int32).tobytes()
    return out


def _replay_sparse(sym, after, before, rank, index, heap, merges):
    """The same replay for the ranks that few places hold: plain lists."""
    sym, after, before, rank = sym.tolist(), after.tolist(), before.tolist(), rank.tolist()
    pair, push, late = merges.pairs.get, heapq.heappush, []
    while heap:
        r = heapq.heappop(heap)
        places = index.pop(r)
        if len(places) > 1:
            places.sort()
        for p in places:
            if rank[p] != r:
                continue
            q = after[p]
            sym[p] = r
            sym[q] = rank[q] = -1
            nxt = after[p] = after[q]
            g = -1
            if nxt >= 0:
                before[nxt] = p
                g = pair(r << 32 | sym[nxt], -1)
                if g >= 0:
                    if g in index:
                        index[g].append(p)
                    else:
                        index[g] = [p]
                        push(heap, g)
                    if g <= r:
                        late.append(p)
            rank[p] = g
            prv = before[p]
            if prv >= 0:
                g = rank[prv] = pair(sym[prv] << 32 | r, -1)
                if g >= 0:
                    if g in index:
                        index[g].append(prv)
                    else:
                        index[g] = [prv]
                        push(heap, g)
                    if g <= r:
                        late.append(prv)
    return np.array(sym, np.int64), late


def _replay_one(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """One word, one merge at a time: a heap of (rank, position)."""
    n = len(word)
    part: list[bytes | None] = [word[i:i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(ranks[g], i) for i in range(n - 1) if (g := word[i:i + 2]) in ranks]
    heapq.heapify(heap)
    while heap:
        r, p = heapq.heappop(heap)
        if part[p] is None or after[p] >= n:
            continue
        q = after[p]
        joined = part[p] + part[q]
        if ranks.get(joined) != r:
            continue
        part[p], part[q] = joined, None
        after[p] = after[q]
        if after[p] < n:
            before[after[p]] = p
            if (g := ranks.get(joined + part[after[p]])) is not None:
                heapq.heappush(heap, (g, p))
        if before[p] >= 0:
            if (g := ranks.get(part[before[p]] + joined)) is not None:
                heapq.heappush(heap, (g, before[p]))
    return [ranks[x] for x in part if x is not None]


class Encoder:
    """Encoder and decoder of one rank file, for one Python worker."""

    _open: dict[tuple[str, str], "Encoder"] = {}

    def __init__(self, path: str, pattern: str):
        import regex
        self.ranks = load_ranks(path)
        self.merges = Merges(self.ranks)
        self.pattern = regex.compile(pattern)
        self.spaced = pattern == SPACED
        self.token = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for b, i in self.ranks.items():
            self.token[i] = b
        self.decimal = [b"%d" % i for i in range(len(self.token))]
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str, pattern: str) -> "Encoder":
        if (path, pattern) not in cls._open:
            cls._open[path, pattern] = cls(path, pattern)
        return cls._open[path, pattern]

    def _learn(self, chunks: set[str]) -> dict[str, bytes]:
        """A table with the ids of every chunk: its words' ids joined.  Chunks
        not met since the table was last full are forgotten."""
        if len(self.known) > WORDS_KEPT // 2:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        new = [c for c in chunks if c not in known]
        known.update((c, older[c]) for c in new if c in older)
        new = [c for c in new if c not in older]
        cut = [self.pattern.findall(c) for c in new]
        words = list({w for c in cut for w in c if w not in known})
        for i in range(0, len(words), REPLAY_WORDS):
            part = words[i:i + REPLAY_WORDS]
            known.update(zip(part, replay([w.encode() for w in part], self.merges)))
        for c, pieces in zip(new, cut):
            if len(pieces) != 1:
                known[c] = b"".join(map(known.__getitem__, pieces))
        return known

    def _chunks(self, text: str) -> list[str]:
        """The text cut where a match of the usual pattern always begins.

        A match holds a space only at its start or inside a run of white
        space, and such a run leaves its last character to the next match.
        So a space starts a match unless white space stands on both its sides
        (or before it, at the end).  Texts without such a space are cut at the
        spaces, and words are found once per distinct chunk; others are cut by
        the pattern.
        """
        if not self.spaced or INSIDE.search(text):
            return self.pattern.findall(text)
        head, *rest = text.split(" ")
        return [head] * bool(head) + [" " + c for c in rest]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text; the word list of all texts is replayed at once."""
        out: list[np.ndarray] = []
        for a, b in by_chars(texts, SLICE_CHARS):
            if b - a == 1 and len(texts[a]) > SLICE_CHARS:
                found = self.pattern.finditer(texts[a])
                ids: list[bytes] = []
                while part := [m.group() for m in islice(found, SLICE_CHARS // 8)]:
                    known = self._learn(set(part))
                    ids.append(b"".join(map(known.__getitem__, part)))
                out.append(np.frombuffer(b"".join(ids), np.int32))
                continue
            cut = [self._chunks(t) for t in texts[a:b]]
            known = self._learn(set().union(*cut))
            out.extend(np.frombuffer(b"".join(map(known.__getitem__, c)), np.int32) for c in cut)
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """(id_col, ids ARRAY<INT>): every document's token ids."""
    def run(batches):
        enc = Encoder.of(path, pattern)
        for pdf in batches:
            yield pd.DataFrame({"k": pdf["k"], "ids": enc.encode(
                [t if t is not None else "" for t in pdf["t"]])})

    kind = docs.schema[id_col].dataType.simpleString()
    return (docs.selectExpr(f"`{id_col}` AS k", f"`{text_col}` AS t")
            .mapInPandas(run, f"k {kind}, ids array<int>").withColumnRenamed("k", id_col))


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """(id_col, decoded BINARY) from ``encode``'s rows."""
    def run(batches):
        enc = Encoder.of(path, pattern)
        for pdf in batches:
            yield pd.DataFrame({"k": pdf["k"], "decoded": [
                enc.decode([] if i is None else list(i)) for i in pdf["ids"]]})

    # ids travel as text: pandas turns a bigint column that holds a null into doubles
    made = encoded.select(F.col(id_col).cast("string").alias("k"), "ids").mapInPandas(
        run, "k string, decoded binary")
    return made.select(F.col("k").cast(encoded.schema[id_col].dataType).alias(id_col), "decoded")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): ``encode`` and then
    ``decode`` of each document, digested where the ids lie so that the id
    lists (several times the text) never leave the task."""
    def run(batches):
        enc = Encoder.of(path, pattern)
        for pdf in batches:
            texts = [t if t is not None else "" for t in pdf["text"]]
            n, a, b = [], [], []
            for lo, hi in by_chars(texts, SLICE_CHARS):
                for packed in enc.encode(texts[lo:hi]):
                    ids = packed.tolist()
                    n.append(len(ids))
                    a.append(hashlib.sha256(b" ".join(map(enc.decimal.__getitem__, ids))).hexdigest())
                    b.append(hashlib.sha256(enc.decode(ids)).hexdigest())
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_tokens": n,
                                "ids_sha256": a, "decoded_sha256": b})

    made = docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(
        run, "doc_id string, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    return made.withColumn("doc_id", F.col("doc_id").cast("bigint"))
