"""Substring dedup with suffix automata of reference shards.

A window is ``size`` consecutive words.  Words covered by a window whose word
sequence also starts anywhere else are removed.

The corpus is its own reference, so it is cut into shards by content, and a
document's stretches meet only the shard that can repeat them:

1. Every window has an anchor: the smallest hash among its ``GRAM``-word grams.
   Equal windows have equal anchors.  Consecutive windows with the same anchor
   place form a segment (anchor, content hash, row, first window, windows).
2. Anchors seen once cannot repeat; they go.  The other segments are reduced
   to distinct contents with their number of copies, and only one copy of each
   fetches its words.
3. A shard holds the distinct segments of its anchors.  Its suffix automaton
   counts, for every substring, the places it starts at (copies included).
   Segments are streamed through it for matching statistics: at each word the
   length of the longest suffix that occurs at least twice.  Where that
   reaches ``size``, a repeated window ends.
4. An anchor with very many distinct contents would make one shard large; its
   segments are sent as single windows, dealt by the window's own hash.  Equal
   windows are summed map-side first, so a passage found in a third of all
   documents reaches its shard as one row; its verdict is joined back.
5. The verdict of a distinct segment goes to all its copies, and every row
   removes the words its repeated windows cover.

Words are compared by 64-bit hashes on the way and as text in the automata.
Words are ``[^\\x20\\x09-\\x0D]+``; null text has none.  Rows are told apart by
id and text, so null ids and repeated rows are allowed (a repeated row repeats
every window of its twin).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotsmith.llm.common import (WORD_BASE, mix, powers, windows, with_columns, word_spans,
                                  write_once)

SIZE = 35
GRAM = 8
SHARD = 4000          # distinct segments in a shard, on average
WIDE = 1000           # distinct contents from which an anchor is sent as windows
WORD_BACK = np.uint64(pow(int(WORD_BASE), -1, 1 << 64))


def segments(words: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """(anchor, content, first window, windows) of a text's segments."""
    n = len(words) - size + 1
    if n <= 0:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64))
    gram = min(GRAM, size)
    grams = mix(windows(words, gram))
    width = size - gram + 1
    at = np.empty(n, np.int64)
    for a in range(0, n, 200_000):
        b = min(n, a + 200_000)
        view = np.lib.stride_tricks.sliding_window_view(grams[a:b + width - 1], width)
        at[a:b] = view.argmin(axis=1) + np.arange(a, b)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    count = np.diff(np.append(first, n))
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers(WORD_BASE, len(words))[: len(words)], out=total[1:])
    content = mix((total[first + count + size - 1] - total[first]) * powers(WORD_BACK, len(words))[first]
                  + count.astype(np.uint64))
    return grams[at[first]], content, first, count


class Automaton:
    """Suffix automaton of several weighted word sequences."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len, self.count = [-1], [0], [0]

    def add(self, seq: list[int], weight: int) -> None:
        nxt, link, length, count = self.next, self.link, self.len, self.count
        last = 0
        for c in seq:
            q = nxt[last].get(c)
            if q is not None:
                if length[q] == length[last] + 1:
                    last = q
                else:
                    last = self._clone(last, q, c)
                count[last] += weight
                continue
            cur = len(length)
            nxt.append({})
            length.append(length[last] + 1)
            count.append(weight)
            link.append(0)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, c)
            last = cur

    def _clone(self, p: int, q: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        new = len(length)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        self.count.append(0)
        link[q] = new
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def finish(self) -> None:
        """Places of every state, and the longest suffix with two or more."""
        order = sorted(range(1, len(self.len)), key=self.len.__getitem__)
        for v in reversed(order):
            if self.link[v] >= 0:
                self.count[self.link[v]] += self.count[v]
        self.twice = [0] * len(self.len)
        for v in order:
            self.twice[v] = self.len[v] if self.count[v] > 1 else self.twice[self.link[v]]

    def repeated(self, seq: list[int], size: int) -> list[tuple[int, int]]:
        """(first window, windows) of the runs of repeated windows in ``seq``
        (a sequence the automaton holds)."""
        v, out, start = 0, [], -1
        for i, c in enumerate(seq):
            v = self.next[v][c]
            longest = i + 1 if self.count[v] > 1 else self.twice[v]
            if longest >= size:
                if start < 0:
                    start = i - size + 1
            elif start >= 0:
                out.append((start, i - size + 1 - start))
                start = -1
        if start >= 0:
            out.append((start, len(seq) - size + 1 - start))
        return out


def _segment_rows(docs: DataFrame, size: int) -> DataFrame:
    def run(batches):
        for pdf in batches:
            parts = []
            for key, text in zip(pdf["key"].tolist(), pdf["text"]):
                a, c, s, m = segments(word_spans((text or "").encode())[2], size)
                if len(a):
                    parts.append((a, c, np.full(len(a), key), s, m))
                if sum(len(p[0]) for p in parts) > 200_000:
                    yield frame(parts)
                    parts = []
            if parts:
                yield frame(parts)

    def frame(parts):
        a, c, k, s, m = (np.concatenate(x) for x in zip(*parts))
        return pd.DataFrame({"a": a.view(np.int64), "c": c.view(np.int64), "key": k,
                             "s": s.astype(np.int32), "m": m.astype(np.int32)})

    return docs.select("key", "text").mapInPandas(run, "a bigint, c bigint, key bigint, s int, m int")


def _contents(joined: DataFrame, size: int, shards: int) -> DataFrame:
    """(shard, wide, a, c, off, x, weight, words): the words of every distinct
    segment, or of each of its windows (``x``: window hash) where the anchor is wide."""
    def run(batches):
        for pdf in batches:
            rows = []
            for text, want in zip(pdf["text"], pdf["want"]):
                raw = text.encode()
                start, end, h = word_spans(raw)
                for w in want:
                    a, c, s, m = w["a"], w["c"], w["s"], w["m"]
                    if not w["wide"]:
                        rows.append((a % shards, False, a, c, 0, 0, w["n"], raw[start[s]:end[s + m + size - 2]]))
                        continue
                    own = mix(windows(h[s:s + m + size - 1], size)).view(np.int64)
                    for i, x in enumerate(own.tolist()):
                        words = b" ".join(raw[start[s + i]:end[s + i + size - 1]].split())
                        rows.append((x % shards, True, a, c, i, x, w["n"], words))
                if len(rows) > 20_000:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=names)

    names = ["shard", "wide", "a", "c", "off", "x", "weight", "words"]
    return joined.mapInPandas(run, "shard bigint, wide boolean, a bigint, c bigint, off int, x bigint, "
                                   "weight bigint, words binary")


def repeated_windows(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(key, spans): per row (``key``, ``text``) the repeated windows, as
    ARRAY<STRUCT<w, m>>: first window, windows."""
    rows = write_once(_segment_rows(docs, size), "segments")
    # written first: both sides of the join are then plain shuffles, which
    # adaptive execution can split where one anchor holds many rows
    several = write_once(rows.groupBy("a").agg(F.count("*").alias("k")).where("k > 1").select("a"), "anchors")
    rows = write_once(rows.join(several, "a"), "candidates")
    distinct = (rows.groupBy("a", "c").agg(F.count("*").alias("n"), F.min(F.struct("key", "s", "m")).alias("r"))
                .select("a", "c", "n", "r.key", "r.s", "r.m"))
    distinct = write_once(distinct, "distinct")
    wide = distinct.groupBy("a").agg(F.count("*").alias("k")).where(F.col("k") > WIDE).select(
        "a", F.lit(True).alias("wide"))
    shards = max(1, -(-distinct.count() // SHARD))
    want = (distinct.join(wide, "a", "left").withColumn("wide", F.coalesce("wide", F.lit(False)))
            .groupBy(F.col("key").alias("_key"))
            .agg(F.collect_list(F.struct("a", "c", "n", "s", "m", "wide")).alias("want")))
    joined = docs.join(want.hint("shuffle_hash"), docs["key"] == want["_key"]).select("text", "want")

    contents = write_once(_contents(joined, size, shards), "contents")
    # a window of a wide anchor is judged once, whatever the number of its segments
    sent = contents.where("NOT wide").select("shard", "wide", "a", "c", "weight", "words").unionByName(
        contents.where("wide").groupBy("shard", "x", "words").agg(F.sum("weight").alias("weight"))
        .select("shard", F.lit(True).alias("wide"), F.lit(0).cast("bigint").alias("a"),
                F.col("x").alias("c"), "weight", "words"))

    def judge(pdf):
        pdf = pdf.drop_duplicates(["wide", "a", "c", "words"])
        # equal contents under one automaton: windows of wide anchors meet here
        ids: dict[bytes, int] = {}
        seqs = [[ids.setdefault(w, len(ids)) for w in x.split()] for x in pdf["words"]]
        auto = Automaton()
        for seq, weight in zip(seqs, pdf["weight"].tolist()):
            auto.add(seq, weight)
        auto.finish()
        out = [(wide, a, c, w, m) for wide, a, c, seq in
               zip(pdf["wide"].tolist(), pdf["a"].tolist(), pdf["c"].tolist(), seqs)
               for w, m in auto.repeated(seq, size)]
        return pd.DataFrame(out, columns=["wide", "a", "c", "w", "m"])

    judged = write_once(sent.groupBy("shard").applyInPandas(
        judge, "wide boolean, a bigint, c bigint, w int, m int"), "judged")
    repeated = judged.where("wide").select(F.col("c").alias("x")).distinct()
    verdict = (judged.where("NOT wide").select("a", "c", "w", "m")
               .unionByName(contents.where("wide").select("a", "c", F.col("off").alias("w"), "x")
                            .join(repeated, "x").select("a", "c", "w", F.lit(1).alias("m")))
               .groupBy("a", "c").agg(F.collect_set(F.struct("w", "m")).alias("runs")))
    verdict = write_once(verdict, "verdict")
    return (rows.join(verdict, ["a", "c"]).select("key", "s", F.explode("runs").alias("x"))
            .groupBy("key").agg(F.collect_list(F.struct(
                (F.col("s") + F.col("x.w")).alias("w"), F.col("x.m").alias("m"))).alias("spans")))


def remove_repeats(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` and ``kept`` (the kept words,
    joined by one space).  Other columns are untouched."""
    keyed = docs.withColumn("_key", F.xxhash64("doc_id", "text"))
    found = repeated_windows(keyed.select(F.col("_key").alias("key"), "text"), size).select(
        F.col("key").alias("_found"), F.col("spans").alias("_spans"))
    joined = keyed.join(found.hint("shuffle_hash"), keyed["_key"] == found["_found"], "left")

    def cut(texts, spans):
        total, gone, kept = [], [], []
        for text, runs in zip(texts, spans):
            words = (text or "").encode().split()
            total.append(len(words))
            if runs:
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, [r["w"] for r in runs], 1)
                np.add.at(edge, [r["w"] + r["m"] + size - 1 for r in runs], -1)
                keep = np.cumsum(edge[:-1]) == 0
                words = [w for w, k in zip(words, keep.tolist()) if k]
            gone.append(total[-1] - len(words))
            kept.append(b" ".join(words).decode())
        return total, gone, kept

    return with_columns(joined, ["text", "_spans"], cut,
                        {"n_words": "bigint", "n_removed": "bigint", "kept": "string"},
                        drop=("_key", "_found", "_spans"))
