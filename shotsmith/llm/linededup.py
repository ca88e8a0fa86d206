"""Exact line dedup over the whole corpus with sharded minimal perfect hashes.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at its ends and with A-Z
in lower case; a line is known by the 128-bit digest of its key.

1. Every document lists its distinct keys (at least ``min_chars`` code points).
   Keys are pre-aggregated in each task to (digest, first document, whether
   there are several).
2. ``build_index``: distinct digests are split into shards of bounded size; a
   shard becomes one row: a minimal perfect hash (levels of bit arrays), and
   at each key's slot a 32-bit fingerprint, a count (saturating at 2) and the
   smallest document id.
3. Documents probe the arrays: their digests travel to the shard that holds
   them and are looked up in blocks.  A shard whose lines are probed often is
   copied under several salts, so a line held by a third of all documents is
   probed by many tasks.
4. Only the digests to drop come back, listed per document, and every document
   drops those lines.

Null or empty text is one empty line.  Documents without an id take no part
and come back unchanged.  Rows that repeat a document id are one document.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotsmith.llm.common import mix, with_columns, write_once

SHARD_KEYS = 8192       # digests in a shard, on average
PROBES = 32_768         # probes of a shard that one task takes, on average
GAMMA = 2               # bits a key in each level of the perfect hash
LEVELS = 48
WHITE = b" \t\n\x0b\x0c\r"


def line_key(line: bytes) -> bytes:
    return line.strip(WHITE).lower()          # bytes.lower touches A-Z only


def line_digest(line: bytes, min_chars: int) -> bytes | None:
    """Digest of a line's key; None for a key that is too short."""
    key = line_key(line)
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode()) < min_chars:
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: in each level a key that
    meets no other owns its bit; the others go on to the next level.  Keys that
    no level parts (equal ones only, in practice) are listed."""

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray):
        self.levels, self.rest = levels, rest
        self.base = np.cumsum([0] + [int(b.sum()) for b in levels])
        self.rank = [np.cumsum(b) for b in levels]

    @staticmethod
    def _slot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + np.array([level + 1], np.uint64) * np.uint64(0x632BE59BD9B4E019))
                % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> "PerfectHash":
        levels, left = [], keys
        while len(left) and len(levels) < LEVELS:
            size = max(64, GAMMA * len(left))
            slot = cls._slot(left, len(levels), size)
            alone = np.bincount(slot, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[slot]]
        return cls(levels, np.sort(left))

    def slot(self, keys: np.ndarray) -> np.ndarray:
        """The slot of every key, 0 .. n-1 (any slot, or -1, for strangers)."""
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for i, bits in enumerate(self.levels):
            if not len(open_):
                break
            at = self._slot(keys[open_], i, len(bits))
            hit = bits[at]
            out[open_[hit]] = self.base[i] + self.rank[i][at[hit]] - 1
            open_ = open_[~hit]
        if len(open_) and len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            hit = self.rest[at] == keys[open_]
            out[open_[hit]] = self.base[-1] + at[hit]
        return out

    def dump(self) -> tuple[list[int], bytes, bytes]:
        return ([len(b) for b in self.levels],
                b"".join(np.packbits(b).tobytes() for b in self.levels), self.rest.tobytes())

    @classmethod
    def load(cls, sizes: list[int], bits: bytes, rest: bytes) -> "PerfectHash":
        levels, at = [], 0
        for n in sizes:
            part = np.frombuffer(bits, np.uint8, count=-(-n // 8), offset=at)
            levels.append(np.unpackbits(part, count=n).astype(bool))
            at += -(-n // 8)
        return cls(levels, np.frombuffer(rest, np.uint64))


def _halves(digests) -> tuple[np.ndarray, np.ndarray]:
    """(key of the perfect hash, fingerprint) of 16-byte digests."""
    both = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)
    return both[:, 0].copy(), (both[:, 1] >> np.uint64(32)).astype(np.uint32)


def document_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, shard_key, digest): the distinct keys of every document."""
    def run(batches):
        for pdf in batches:
            ids, digests = [], []
            for key, text in zip(pdf["doc_id"].tolist(), pdf["text"]):
                if text:
                    got = {line_digest(x, min_chars) for x in text.encode().split(b"\n")}
                    got.discard(None)
                    ids.extend([key] * len(got))
                    digests.extend(got)
            yield pd.DataFrame({"doc_id": pd.Series(ids, dtype="int64"), "digest": digests})

    return (docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint"), "text")
            .mapInPandas(run, "doc_id bigint, digest binary"))


def build_index(lines: DataFrame, shards: int | None = None) -> tuple[DataFrame, int]:
    """One row per shard: perfect hash, fingerprints, counts, first documents."""
    keys = write_once(lines.groupBy("digest").agg(
        F.min("doc_id").alias("first"),
        F.when(F.min("doc_id") == F.max("doc_id"), 1).otherwise(2).alias("n")), "linekeys")
    shards = shards or max(1, -(-keys.count() // SHARD_KEYS))

    def build(pdf):
        key, mark = _halves(pdf["digest"])
        index = PerfectHash.build(key)
        slot = index.slot(key)
        # digests whose 64-bit keys agree share a slot run in ``rest``: part them
        order = np.lexsort((mark, key))
        same = np.concatenate(([False], key[order][1:] == key[order][:-1]))
        for i in np.flatnonzero(same):
            slot[order[i]] = slot[order[i - 1]] + 1
        marks = np.zeros(len(key), np.uint32)
        count = np.zeros(len(key), np.uint8)
        first = np.zeros(len(key), np.int64)
        marks[slot], count[slot], first[slot] = mark, pdf["n"], pdf["first"]
        sizes, bits, rest = index.dump()
        return pd.DataFrame([(pdf["shard"].iloc[0], sizes, bits, rest, marks.tobytes(),
                              count.tobytes(), first.tobytes())], columns=names)

    names = ["shard", "sizes", "bits", "rest", "marks", "counts", "firsts"]
    index = keys.withColumn("shard", _shard(shards)).groupBy("shard").applyInPandas(
        build, "shard bigint, sizes array<bigint>, bits binary, rest binary, marks binary, "
               "counts binary, firsts binary")
    return write_once(index, "lineindex"), shards


def _shard(shards: int):
    return F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("bigint")


def probe(lines: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """The (doc_id, digest) rows whose line must go: found in several
    documents, and this is not the first of them."""
    keyed = lines.withColumn("shard", _shard(shards))
    salts = (keyed.groupBy("shard").agg(F.count("*").alias("n"))
             .select("shard", F.ceil(F.col("n") / PROBES).cast("int").alias("salts")))
    salts = write_once(salts, "linesalts")
    left = (keyed.join(salts, "shard")
            .withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int")).drop("salts"))
    right = (index.join(salts, "shard")
             .withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts"))

    def look(pdf, idx):
        if not len(idx) or not len(pdf):
            return pd.DataFrame({"doc_id": pd.Series(dtype="int64"), "digest": []})
        row = idx.iloc[0]
        index = PerfectHash.load(list(row["sizes"]), row["bits"], row["rest"])
        marks = np.frombuffer(row["marks"], np.uint32)
        count = np.frombuffer(row["counts"], np.uint8)
        first = np.frombuffer(row["firsts"], np.int64)
        key, mark = _halves(pdf["digest"])
        slot = index.slot(key)
        # equal 64-bit keys lie in neighbouring slots; the fingerprint tells them apart
        for i in np.flatnonzero((slot >= 0) & (marks[slot] != mark)).tolist():
            s = slot[i] + 1
            while s < len(marks) and marks[s] != mark[i]:
                s += 1
            slot[i] = s if s < len(marks) else -1
        drop = (slot >= 0) & (count[slot] > 1) & (first[slot] != pdf["doc_id"].to_numpy(np.int64))
        return pdf.loc[drop, ["doc_id", "digest"]]

    return left.groupBy("shard", "salt").cogroup(right.groupBy("shard", "salt")).applyInPandas(
        look, "doc_id bigint, digest binary")


def drop_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """``docs`` with repeated lines removed from ``text``; adds ``n_lines``
    (before dropping) and ``n_dropped``.  Other columns are untouched."""
    lines = write_once(document_lines(docs, min_chars), "lines")
    index, shards = build_index(lines)
    gone = (probe(lines, index, shards).groupBy(F.col("doc_id").alias("_line_doc"))
            .agg(F.collect_list("digest").alias("_line_gone")))
    joined = docs.join(gone.hint("shuffle_hash"),
                       docs["doc_id"].cast("bigint") == gone["_line_doc"], "left").drop("_line_doc")

    def cut(texts, gone):
        out, total, dropped = [], [], []
        for text, drop in zip(texts, gone):
            rows = (text or "").split("\n")
            total.append(len(rows))
            if drop:
                drop = set(drop)
                kept = [r for r in rows if line_digest(r.encode(), min_chars) not in drop]
                dropped.append(len(rows) - len(kept))
                out.append("\n".join(kept))
            else:
                dropped.append(0)
                out.append(text)
        return out, total, dropped

    return with_columns(joined, ["text", "_line_gone"], cut,
                        {"text": "string", "n_lines": "bigint", "n_dropped": "bigint"},
                        drop=("_line_gone",)).select(*docs.columns, *[
                            c for c in ("n_lines", "n_dropped") if c not in docs.columns])
