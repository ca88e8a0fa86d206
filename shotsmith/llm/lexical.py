"""Ranked lexical search by the Best Position Algorithm over impact lists.

1. Queries: items (rows of one id are one item) give (item, term, repeats); the
   distinct terms are numbered.  Terms over ``KEY_BYTES`` bytes go by a digest.
2. One pass over the documents for every ``TERMS`` distinct query terms (as a
   rule one) counts each document's terms and keeps its query terms as packed
   arrays.  The table is written once; corpus statistics (N, L, document
   frequencies) are aggregated from it, over all documents.
3. Documents are dealt to shards by a written row number: at most about
   ``SHARD_DOCS`` documents and ``SHARD_HITS`` postings each, so a shard's index
   fits a task whatever a term's frequency.
4. In a shard, every term has an impact list (postings by falling impact, each
   with its place), and every document its own entries.  For a query all lists
   are read in parallel; a document met for the first time is scored at once by
   direct access to its entries, which also marks its places in the other lists
   as seen.  The best position of a list is the end of its unbroken run of seen
   places: an unseen document stands below it in every list, so the sum of the
   values just below the best positions bounds its score.  Reading stops only
   when that bound is strictly below the k-th best score, so ties are complete.
5. The k-th scores of the first shards (one in ``FIRST``) bound the others from
   the start; the shards' best k are merged by a window.

Texts are whole; null text has no terms; documents without terms count in no
statistic.  Rows that repeat a document id are documents of their own; a null
id comes last among equal scores.  Items without an id are left out; items
without terms, or whose terms occur nowhere, have no rows.  A term of weight 0
adds nothing.  Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from shotsmith.llm.common import write_once
from shotsmith.operators.positions import dense_positions

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
KEY_BYTES = 40
TERMS = 50_000
SHARD_DOCS, SHARD_HITS = 16_384, 4_000_000
QUERY_ROWS = 200_000     # query terms of a block
FIRST = 8
TOP = 20
SLICE = 1 << 20

# bytes of a term, A-Z lowered; every other byte separates
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def count_terms(raw: bytes) -> tuple[int, Counter]:
    """Number of terms of a UTF-8 text, and how often each occurs; in slices, so
    that a very long text needs memory for its distinct terms only."""
    n, seen = 0, Counter()
    plain = raw.translate(_TABLE)
    at = 0
    while at < len(plain):
        end = plain.find(b" ", at + SLICE)
        end = len(plain) if end < 0 else end
        words = plain[at:end].split()
        n += len(words)
        seen.update(words)
        at = end
    return n, seen


def key_of(term: bytes) -> bytes:
    """The term, or a line break and its digest if it is long."""
    return term if len(term) <= KEY_BYTES else b"\n" + hashlib.sha256(term).hexdigest().encode()


def query_terms(items: DataFrame) -> DataFrame:
    """(item_id, key, c): how often each term occurs in each item."""
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    term = F.explode(F.regexp_extract_all(low, F.lit(TERM), F.lit(0))).alias("term")
    key = F.when(F.octet_length("term") <= KEY_BYTES, F.col("term")).otherwise(
        F.concat(F.lit("\n"), F.sha2("term", 256)))
    return (items.where("item_id IS NOT NULL").select(F.col("item_id").cast("bigint").alias("item_id"), term)
            .groupBy("item_id", key.alias("key")).agg(F.count("*").alias("c")))


def postings(docs: DataFrame, keys: list[bytes], first: int, every: bool) -> DataFrame:
    """(rid, doc_id, n, term, tf) of the documents that hold a key (``every``: of
    all that hold a term); ``term`` and ``tf`` are packed int32 and int64."""
    sent = docs.sparkSession.sparkContext.broadcast({k: first + i for i, k in enumerate(keys)})   # <= TERMS keys

    def run(batches):
        number = sent.value
        known = number.keys()
        long = any(k[:1] == b"\n" for k in known)
        for batch in batches:
            rid, doc, n_terms, ids, tfs = [], [], [], [], []
            for i in range(batch.num_rows):
                raw = batch.column(2)[i].as_py()
                n, seen = count_terms(raw) if raw else (0, ())
                if not n:
                    continue
                hits = sorted((number[t], seen[t]) for t in seen.keys() & known)
                if long:
                    more = ((key_of(t), c) for t, c in seen.items() if len(t) > KEY_BYTES)
                    hits += [(number[k], c) for k, c in more if k in known]
                if not hits and not every:
                    continue
                rid.append(batch.column(0)[i].as_py())
                doc.append(batch.column(1)[i].as_py())
                n_terms.append(n)
                ids.append(np.array([t for t, _ in hits], np.int32).tobytes())
                tfs.append(np.array([c for _, c in hits], np.int64).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(rid, pa.int64()), pa.array(doc, pa.int64()), pa.array(n_terms, pa.int64()),
                 pa.array(ids, pa.binary()), pa.array(tfs, pa.binary())], names=["rid", "doc_id", "n", "term", "tf"])

    return docs.select("rid", "doc_id", F.col("text").cast("binary")).mapInArrow(
        run, "rid bigint, doc_id bigint, n bigint, term binary, tf binary")


def _frequencies(hits: DataFrame) -> DataFrame:
    """(term, df) over all documents, counted in the tasks first."""
    def run(batches):
        total = Counter()
        for batch in batches:
            part = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int32)
            ids, n = np.unique(part, return_counts=True)
            total.update(dict(zip(ids.tolist(), n.tolist())))
            if len(total) >= TERMS:
                yield pa.RecordBatch.from_pydict({"term": list(total), "df": list(total.values())})
                total.clear()
        if total:
            yield pa.RecordBatch.from_pydict({"term": list(total), "df": list(total.values())})

    return hits.select("term").mapInArrow(run, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df"))


class Shard:
    """Impact lists of the terms (numbered 0..) of the documents of one shard."""

    def __init__(self, doc_start: np.ndarray, term: np.ndarray, impact: np.ndarray, n_terms: int):
        """``term`` and ``impact`` by document; documents in tie order."""
        self.doc_start, self.term, self.impact = doc_start, term, impact
        owner = np.repeat(np.arange(len(doc_start) - 1), np.diff(doc_start))
        self.listed = np.lexsort((owner, -impact, term))
        self.list_docs, self.list_impact = owner[self.listed], impact[self.listed]
        self.list_start = np.searchsorted(term[self.listed], np.arange(n_terms + 1))
        self.place = np.empty(len(term), np.int64)
        self.place[self.listed] = np.arange(len(term)) - self.list_start[term[self.listed]]
        self.coef = np.zeros(n_terms, np.int64)
        self.base = np.zeros(n_terms, np.int64)
        self.read = 0       # places read in order, over all queries
        self.total = 0

    def best(self, terms: np.ndarray, coef: np.ndarray, k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """The documents that can be among the best ``k`` (in tie order), with
        their scores; ``seed`` is a score that k documents are known to reach."""
        size = self.list_start[terms + 1] - self.list_start[terms]
        use = (coef > 0) & (size > 0)
        terms, coef, size = terms[use], coef[use], size[use]
        start = self.list_start[terms]
        base = np.cumsum(size) - size
        self.total += int(size.sum())
        self.coef[terms], self.base[terms] = coef, base
        seen = np.zeros(int(size.sum()), bool)
        met = np.zeros(len(self.doc_start) - 1, bool)
        position = np.zeros(len(terms), np.int64)
        found, scores = [], []
        kept = np.zeros(0, np.int64)        # the best k scores so far
        kth, depth, step = seed, 0, 16
        while True:
            below = position < size
            bound = int((coef[below] * self.list_impact[(start + position)[below]]).sum())
            if not bound or bound < kth:
                break
            parts = [self.list_docs[s + depth: s + min(depth + step, z)] for s, z in zip(start, size) if depth < z]
            self.read += sum(map(len, parts))
            docs = np.unique(np.concatenate(parts))
            docs = docs[~met[docs]]
            depth, step = depth + step, max(16, (depth + step) // 3)
            if len(docs):
                met[docs] = True
                first, count = self.doc_start[docs], self.doc_start[docs + 1] - self.doc_start[docs]
                at = np.cumsum(count) - count
                entry = np.repeat(first - at, count) + np.arange(int(count.sum()))
                term = self.term[entry]
                c = self.coef[term]
                score = np.add.reduceat(c * self.impact[entry], at)
                mine = c > 0
                seen[self.base[term[mine]] + self.place[entry[mine]]] = True
                found.append(docs)
                scores.append(score)
                kept = np.concatenate((kept, score))
                if len(kept) >= k:
                    kept = np.partition(kept, len(kept) - k)[len(kept) - k:]
                    kth = max(seed, int(kept[0]))
            for i in range(len(terms)):
                p = position[i]
                if p < size[i]:
                    rest = seen[base[i] + p: base[i] + size[i]]
                    gap = int(np.argmin(rest))
                    position[i] = size[i] if rest[gap] else p + gap
        self.coef[terms] = 0
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        docs, score = np.concatenate(found), np.concatenate(scores)
        order = np.lexsort((docs, -score))[:k]
        return docs[order], score[order]


def search_shard(hits: pd.DataFrame, queries: pd.DataFrame, n_docs: int, length: int, k: int) -> pd.DataFrame:
    """The best k documents of one shard for every item of a query block."""
    hits = hits.sort_values(["unknown", "doc", "rid"], kind="stable")
    order, row = np.unique(hits["rid"].to_numpy(), return_inverse=True)
    first = np.full(len(order), len(hits))
    np.minimum.at(first, row, np.arange(len(hits)))
    rank = np.empty(len(order), np.int64)        # documents in tie order
    rank[np.argsort(first)] = np.arange(len(order))
    size = np.array([len(b) // 4 for b in hits["term"]], np.int64)
    owner = np.repeat(rank[row], size)
    term = np.frombuffer(b"".join(hits["term"]), np.int32)
    tf = np.frombuffer(b"".join(hits["tf"]), np.int64)
    m = 100 - 25 + 25 * hits["n"].to_numpy(np.int64) * n_docs // length
    impact = 10 ** 9 * tf // (1000 * tf + 12 * np.repeat(m, size))
    wanted = np.unique(queries["term"].to_numpy(np.int64))
    local = np.searchsorted(wanted, term)
    mine = wanted[np.minimum(local, len(wanted) - 1)] == term
    by_doc = np.argsort(owner[mine], kind="stable")
    owner, local, impact = owner[mine][by_doc], local[mine][by_doc], impact[mine][by_doc]
    shard = Shard(np.searchsorted(owner, np.arange(len(order) + 1)), local, impact, len(wanted))
    head = hits.drop_duplicates("rid")
    out = []
    for item, q in queries.groupby("item_id"):
        docs, score = shard.best(np.searchsorted(wanted, q["term"].to_numpy(np.int64)),
                                 q["coef"].to_numpy(np.int64), k, int(q["seed"].iloc[0]))
        got = head.iloc[docs]
        out.append(pd.DataFrame({"item_id": item, "doc": got["doc"].to_numpy(), "rid": got["rid"].to_numpy(),
                                 "unknown": got["unknown"].to_numpy(), "score": score,
                                 "n_read": 0, "n_listed": 0}))
    if not out:
        return pd.DataFrame({c: [] for c in RESULT})
    out = pd.concat(out, ignore_index=True)
    if len(out):        # work done, noted on the shard's first row
        out.loc[0, ["n_read", "n_listed"]] = shard.read, shard.total
    return out


RESULT = ["item_id", "doc", "rid", "unknown", "score", "n_read", "n_listed"]
RESULT_TYPE = ("item_id bigint, doc bigint, rid bigint, unknown boolean, score bigint, "
               "n_read bigint, n_listed bigint")


def _merge(rows: DataFrame, k: int) -> DataFrame:
    best = W.partitionBy("item_id").orderBy(F.desc("score"), "unknown", "doc", "rid")
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def shard_results(docs: DataFrame, items: DataFrame, k: int = TOP, first: int = FIRST) -> DataFrame | None:
    """The best ``k`` rows of every shard for every item (None: nothing to find)."""
    q = write_once(query_terms(items), "queryterms")
    keys = dense_positions(q.select("key").distinct(), [F.col("key")], keep=["key"], pos_col="term")
    n_terms = keys.count()
    if not n_terms:
        return None
    docs = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("bigint"), "text")
    blocks = math.ceil(n_terms / TERMS)
    if blocks > 1:      # several passes must see the same row numbers
        docs = write_once(docs, "lexical-docs")
    hits = None
    for b in range(blocks):
        own = keys.where(F.col("term").between(b * TERMS, b * TERMS + TERMS - 1)).orderBy("term").collect()
        part = postings(docs, [r["key"].encode() for r in own], b * TERMS, every=b == 0).withColumn("pass", F.lit(b))
        hits = part if hits is None else hits.unionByName(part)
    hits = write_once(hits, "hits")
    n_docs, length, with_hits, n_hits = hits.agg(
        F.sum((F.col("pass") == 0).cast("bigint")), F.sum(F.when(F.col("pass") == 0, F.col("n"))),
        F.sum((F.octet_length("term") > 0).cast("bigint")), F.sum(F.octet_length("term") / 4).cast("bigint")).first()
    if not n_hits:
        return None
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1)))
    q = (q.join(keys, "key").join(_frequencies(hits), "term")
         .select("item_id", "term", (F.col("c") * weight).alias("coef")).where("coef > 0"))
    q = write_once(q, "weighted")
    shards = max(math.ceil(with_hits / SHARD_DOCS), math.ceil(n_hits / SHARD_HITS))
    qblocks = max(1, math.ceil(q.count() / QUERY_ROWS))
    q = q.withColumn("qblock", F.pmod(F.xxhash64("item_id"), F.lit(qblocks)).cast("int"))
    hits = hits.where(F.octet_length("term") > 0).select(
        "rid", F.coalesce("doc_id", F.lit(2 ** 63 - 1)).alias("doc"), F.col("doc_id").isNull().alias("unknown"),
        "n", "term", "tf", F.pmod(F.xxhash64("rid"), F.lit(shards)).cast("int").alias("shard"))
    key = ["shard", "qblock"]

    def wave(low: int, high: int, seeds: DataFrame | None) -> DataFrame:
        mine = q.withColumn("seed", F.lit(0).cast("bigint")) if seeds is None else \
            q.join(seeds, "item_id", "left").withColumn("seed", F.coalesce("seed", F.lit(0).cast("bigint")))
        mine = mine.withColumn("shard", F.explode(F.sequence(F.lit(low), F.lit(high - 1))))
        data = hits.where(F.col("shard").between(low, high - 1)).withColumn(
            "qblock", F.explode(F.sequence(F.lit(0), F.lit(qblocks - 1))))

        def solve(h, w):
            if not len(h) or not len(w):
                return pd.DataFrame({c: [] for c in RESULT})
            return search_shard(h, w, n_docs, length, k)

        return data.groupBy(*key).cogroup(mine.groupBy(*key)).applyInPandas(solve, RESULT_TYPE)

    head = math.ceil(shards / first)
    if head >= shards:
        return wave(0, shards, None)
    begun = write_once(wave(0, head, None), "firstshards")
    seeds = _merge(begun, k).where(F.col("rank") == k).select("item_id", F.col("score").alias("seed"))
    return begun.unionByName(wave(head, shards, seeds))


def search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the best ``k`` documents of every item."""
    rows = shard_results(docs, items, k)
    if rows is None:
        return docs.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    return _merge(rows, k).select(
        "item_id", F.col("rank").cast("int").alias("rank"),
        F.when(~F.col("unknown"), F.col("doc")).alias("doc_id"), "score")
