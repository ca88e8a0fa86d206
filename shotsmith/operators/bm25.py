"""M1 / A4: Okapi BM25 ranking of a pool for every query, from a postings store.

The pool is indexed once (``postings.PostingsStore``): its text is tokenised in
the scan and never shuffled, neither for the index nor for a query batch.

1. Statistics (N, mean length, idf) come from the store's vocabulary tables;
   four scalars reach the driver.
2. Query tokens ``(query_id, token, qtf, idf)`` meet the posting blocks of their
   token.  The query side is broadcast only after counting its rows and bytes;
   beyond the limits it is joined, hot tokens salted by block.
3. Pruned top k (``prune=True``; it takes five passes over small parts of the
   index, so it pays on large pools only; README has figures):
   block maxima (max tf, min length) give each query token a ceiling.  The best
   k candidates of a query's rarest tokens are scored in full; their k-th score
   is a floor for the result.  Tokens whose ceilings add up to less than the
   floor cannot lift a candidate there alone, so candidates come from the
   postings of the other tokens only; those that cannot reach the floor with
   all ceilings added go, and the few left are completed from the blocks that
   hold them.  Exact: every step drops only what lies strictly below the floor.
4. Postings are weighted once each, dealt by candidate (in parts of at most about
   ``PART_DOCS``), and summed per (query, class, candidate) inside that partitioning;
   candidates without a shared token come from the same postings, so pairs are
   not shuffled to be summed.
5. Top-k per (query, class) by ``row_number`` plans as WindowGroupLimit: each
   partition keeps k rows per group before the only shuffle by query.

Candidates that share no token with a query score 0 but still rank (the
ranking is a permutation).  They enter through a marker token (a single
space, which can never be a token) that the first k ids of each class in
tie order carry with weight 0.  With all weights >= 0 this is exact: an id
outside that list is preceded by k ids scoring >= 0.  When some idf is
floored to a negative value, or a full ranking is asked for, every id
carries the marker and no block is pruned.

Scores are exact and order-free: idf and every term weight are rounded to
DECIMAL(18,10), weights are computed once per posting (not per pair) and
summed as BIGINT units of 1e-10.  Ties: score DESC, cand_id DESC.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shotsmith.functions.text import as_text, tokens
from shotsmith.operators.blocks import BROADCAST_BYTES
from shotsmith.operators.postings import MARKER, PostingsStore
from shotsmith.operators.ranking import rank_within
from shotsmith.session import BROADCAST_ROW_LIMIT

# --- fixed values: Okapi BM25 parameters (k1, b, epsilon) ---
K1 = 1.5
B = 0.75
EPSILON = 0.25
# --- end of fixed values ---

WEIGHT_TYPE = "decimal(18,10)"
SCALE = 10 ** 10      # a DECIMAL(18,10) weight as BIGINT units: exact, fast sums
SALT_BUCKETS = 32
PART_DOCS = 8192      # documents whose pairs are summed in one task
SEEDS = 4             # times k candidates are scored in full for the floor
SEED_POSTINGS = 16    # times k postings of a query's rarest tokens give those candidates


@dataclass(frozen=True)
class CorpusStats:
    n_docs: int
    avg_len: float
    vocab: int
    mean_idf: float
    floor_idf: Decimal  # epsilon * mean idf, rounded like every weight


def _raw_idf(n_docs, df_col: F.Column) -> F.Column:
    n = F.lit(n_docs).cast("double") if isinstance(n_docs, int) else n_docs
    return F.log(n - df_col + F.lit(0.5)) - F.log(df_col + F.lit(0.5))


def term_weight(idf: F.Column, tf: F.Column, dl: F.Column, avg_len: float) -> F.Column:
    """idf * tf*(k1+1) / (tf + k1*(1 - b + b*dl/avgdl)), rounded."""
    norm = F.lit(K1) * (F.lit(1.0) - F.lit(B) + F.lit(B) * dl / F.lit(avg_len))
    return (idf.cast("double") * (tf * F.lit(K1 + 1.0) / (tf + norm))).cast(WEIGHT_TYPE)


def vocabulary_table(pool: DataFrame) -> DataFrame:
    """The pool's vocabulary (token, df, ctf) of a store written for it.  The
    marker row carries the document count (df) and the total token count (ctf)."""
    return PostingsStore.create(pool).vocabulary()


def corpus_stats_from(vocab: DataFrame) -> CorpusStats:
    """Statistics from the vocabulary table (its marker row holds N and the
    total length)."""
    marker = F.col("token") == MARKER
    row = vocab.agg(F.max(F.when(marker, F.col("df"))).alias("n"),
                    F.max(F.when(marker, F.col("ctf"))).alias("total")).first()
    n_docs, total = int(row["n"] or 0), int(row["total"] or 0)
    if n_docs == 0:
        raise ValueError("empty pool")
    v = vocab.where(~marker).agg(
        F.count(F.lit(1)).alias("v"),
        F.sum(_raw_idf(n_docs, F.col("df").cast("double")).cast(WEIGHT_TYPE)).alias("s")
    ).first()
    n_vocab, idf_sum = int(v["v"]), v["s"] or Decimal(0)
    avg_len = float(total) / float(n_docs)
    mean_idf = float(idf_sum) / n_vocab if n_vocab else 0.0
    floor = Decimal(EPSILON * mean_idf).quantize(Decimal("1E-10"))
    return CorpusStats(n_docs, avg_len, n_vocab, mean_idf, floor)


def corpus_stats(pool: DataFrame, vocab: DataFrame | None = None) -> CorpusStats:
    """A4: N, mean document length, vocabulary size, mean idf, idf floor."""
    return corpus_stats_from(vocab if vocab is not None else vocabulary_table(pool))


def idf_table(vocab: DataFrame, stats: CorpusStats) -> DataFrame:
    """(token, df, idf) with negative idf floored to epsilon * mean idf."""
    raw = _raw_idf(stats.n_docs, F.col("df").cast("double"))
    return vocab.where(F.col("token") != MARKER).select(
        "token", "df", raw.alias("raw_idf"),
        F.when(raw < 0, F.lit(stats.floor_idf).cast(WEIGHT_TYPE))
         .otherwise(raw.cast(WEIGHT_TYPE)).alias("idf"))


def _first_ids(docs: DataFrame, k: int) -> DataFrame:
    """The first k ids of each class in tie order (cand_id DESC)."""
    w = Window.partitionBy("cls").orderBy(F.col("cand_id").desc())
    return (docs.select("cand_id", "cls").withColumn("_r", F.row_number().over(w))
            .where(F.col("_r") <= k).select("cand_id", "cls"))


def _query_terms(queries: DataFrame) -> DataFrame:
    return (queries.select("query_id", F.explode(tokens(as_text("sentence"))).alias("token"))
            .groupBy("query_id", "token").agg(F.count(F.lit(1)).alias("qtf")))


def hot_tokens(vocab: DataFrame) -> DataFrame:
    """(token, _hot) of the tokens whose postings are salted: at most
    64 * SALT_BUCKETS and the marker, since document frequencies add up to the
    number of postings (read from the vocabulary table, not from the text)."""
    n_post = int(vocab.where(F.col("token") != MARKER).agg(F.sum("df")).first()[0] or 0)
    hot_df = max(-(-n_post // (SALT_BUCKETS * 64)), 1)
    return vocab.where(F.col("df") >= hot_df).select("token", F.lit(True).alias("_hot"))


def _join_salted(blocks: DataFrame, qterms: DataFrame, vocab: DataFrame) -> DataFrame:
    """posting blocks JOIN query terms on token.  The blocks of a hot token spread
    over SALT_BUCKETS keys, and the query rows of such a token are copied to each."""
    hot = F.broadcast(hot_tokens(vocab))   # a proven bound, see there
    p = blocks.join(hot, "token", "left").withColumn(
        "_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64("block"), F.lit(SALT_BUCKETS)))
        .otherwise(F.lit(0)).cast("int")).drop("_hot")
    q = qterms.join(hot, "token", "left").withColumn(
        "_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALT_BUCKETS - 1)))
                           .otherwise(F.array(F.lit(0))))).drop("_hot")
    return p.join(q, ["token", "_salt"]).drop("_salt")


def _fits(df: DataFrame, row_bytes: F.Column) -> bool:
    """Whether a frame may be broadcast: counted, rows and bytes."""
    n, size = df.agg(F.count(F.lit(1)), F.sum(row_bytes)).first()
    return n <= BROADCAST_ROW_LIMIT and (size or 0) <= BROADCAST_BYTES


class BM25Index:
    """The pool side of BM25, prepared once: a postings store and its statistics.
    ``scores``/``rank`` then serve any query batch -- e.g. every micro-batch of a
    query stream -- from the store alone.  ``pool`` is a frame to index, or a
    store written earlier (by the same ``by``)."""

    def __init__(self, pool: DataFrame | PostingsStore, by: str | None = None):
        self.by = by
        self.store = pool if isinstance(pool, PostingsStore) else PostingsStore.create(pool, by)
        self.vocab = self.store.vocabulary()
        self.stats = corpus_stats_from(self.vocab)
        self.idf = idf_table(self.vocab, self.stats)
        self.blocks, self.docs = self.store.read("blocks"), self.store.read("docs")

    def _units(self, tf: F.Column, dl: F.Column) -> F.Column:
        """The weight of a posting as an exact scaled integer (units of 1e-10)."""
        return (term_weight(F.col("idf"), tf, dl, self.stats.avg_len) * F.lit(SCALE)).cast("bigint")

    def _matches(self, terms: DataFrame, fits: bool, only: DataFrame | None = None,
                 among: DataFrame | None = None) -> DataFrame:
        """(query_id, cls, cand_id, block, units): summed weights of the postings
        that match ``terms`` (query_id, token, qtf, idf[, tcls]: in that class
        only); of the (query_id, cand_id, block) rows of ``only`` or of the
        candidates ``among`` (cand_id) alone if given."""
        blocks, ids = self.blocks, among
        if only is not None:
            ids = only.select("cand_id").distinct()
            blocks = blocks.join(self._small(only.select("block").distinct(), 16), "block", "left_semi")
        if fits:
            rows = self._weighted(blocks.join(F.broadcast(terms.select("token", "idf").distinct()), "token"),
                                  ["token", "cls", "block"], ids)
            n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            # numbered: adaptive execution must not merge the pair-making stage
            rows = rows.repartition(n, "block").join(F.broadcast(terms.drop("idf")), "token")
        else:
            joined = _join_salted(blocks, terms, self.vocab)
            rows = self._weighted(joined, [c for c in joined.columns if c in (
                "token", "cls", "block", "query_id", "qtf", "tcls")], ids)
        if "tcls" in rows.columns:
            rows = rows.where("cls <=> tcls")
        if only is not None:
            rows = rows.join(self._small(only.select("query_id", "cand_id"), 24), ["query_id", "cand_id"], "left_semi")
        return (rows.groupBy("block", "query_id", "cls", "cand_id")
                .agg(F.sum(F.col("qtf") * F.col("w")).alias("units")))

    def _weighted(self, rows: DataFrame, keep: list[str], ids: DataFrame | None) -> DataFrame:
        rows = rows.select(*keep, "idf", F.explode("rows").alias("p"))
        if ids is not None:
            rows = rows.withColumn("cand_id", F.col("p.cand_id")).join(
                self._small(ids, 16), "cand_id", "left_semi")
        return rows.select(*keep, "p.cand_id", self._units(F.col("p.tf"), F.col("p.dl")).alias("w"))

    @staticmethod
    def _small(df: DataFrame, row_bytes: int) -> DataFrame:
        return F.broadcast(df) if _fits(df, F.lit(row_bytes)) else df

    def ceilings(self, terms: DataFrame, fits: bool) -> DataFrame:
        """(query_id, tcls, token, qtf, idf, df, ceiling): what a token can add to a
        score of a class at most, from the block maxima (no posting is read)."""
        heads = self.blocks.select("token", "block", "cls", "max_tf", "min_dl")
        own = terms.select("token", "idf").distinct()
        pairs = heads.join(F.broadcast(own), "token") if fits else _join_salted(heads, own, self.vocab)
        # one unit above: the maxima are rounded like the weights
        most = pairs.groupBy("token", F.col("cls").alias("tcls")).agg(
            (F.max(self._units(F.col("max_tf"), F.col("min_dl"))) + 1).alias("most"))
        return terms.join(most, "token").join(self.vocab.select("token", "df"), "token").select(
            "query_id", "tcls", "token", "qtf", "idf", "df", (F.col("qtf") * F.col("most")).alias("ceiling"))

    def pruned_scores(self, terms: DataFrame, fits: bool, k: int,
                      among: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """(query_id, cls, cand_id, units) of all candidates that can be among the
        best ``k`` of their class, and the tokens with their part in it."""
        group = ["query_id", "tcls"]
        plan = self._written(self.ceilings(terms, fits), "ceilings")
        rare = Window.partitionBy(*group).orderBy("df", "token").rowsBetween(Window.unboundedPreceding, -1)
        first = plan.withColumn("_before", F.coalesce(F.sum("df").over(rare), F.lit(0))).where(
            F.col("_before") < SEED_POSTINGS * k)
        asked = ["query_id", "tcls", "token", "qtf", "idf"]
        w = Window.partitionBy("query_id", "cls").orderBy(F.desc("units"), "cand_id")
        heads = self._written(self._matches(first.select(*asked), fits, None, among).withColumn("_r", F.row_number().over(w))
                              .where(F.col("_r") <= SEEDS * k).select("query_id", "cand_id", "block"), "heads")
        floor = (self._matches(plan.select(*asked), fits, heads).withColumn("_r", F.row_number().over(w))
                 .where(F.col("_r") == k)
                 .select(F.col("query_id").alias("fq"), F.col("cls").alias("fcls"), F.col("units").alias("floor")))
        low = Window.partitionBy(*group).orderBy("ceiling", "token")
        split = self._written(
            plan.join(floor, F.expr("query_id = fq AND tcls <=> fcls"), "left").drop("fq", "fcls")
            .withColumn("weak", F.coalesce(F.sum("ceiling").over(low) < F.col("floor"), F.lit(False))), "split")
        rest = split.groupBy(F.col("query_id").alias("rq"), F.col("tcls").alias("rcls")).agg(
            F.sum(F.when(F.col("weak"), F.col("ceiling")).otherwise(0)).alias("rest"),
            F.coalesce(F.max("floor"), F.lit(0)).alias("floor"))
        strong = self._matches(split.where(~F.col("weak")).select(*asked), fits, None, among)
        left = self._written(strong.join(rest, F.expr("query_id = rq AND cls <=> rcls"))
                             .where(F.col("units") + F.col("rest") >= F.col("floor"))
                             .select("query_id", "cls", "cand_id", "block", "units"), "candidates")
        more = self._matches(split.where("weak").select(*asked), fits, left)
        cols = ["query_id", "cls", "cand_id", "units"]
        return left.select(*cols).unionByName(more.select(*cols)), split

    def _written(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.store.path}/queries/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def terms(self, queries: DataFrame) -> DataFrame:
        """(query_id, token, qtf, idf) of the query tokens the pool holds."""
        return _query_terms(queries).join(self.idf.select("token", "idf"), "token")

    def _pairs(self, terms: DataFrame, queries: DataFrame, k: int | None,
               among: DataFrame | None) -> DataFrame:
        """(query_id, cls, cand_id, units) of all candidates that share a token with a
        query or carry the marker, summed once; ``terms`` and ``queries`` fit a broadcast."""
        marker = queries.select("query_id", F.lit(MARKER).alias("token"), F.lit(1).cast("bigint").alias("qtf"),
                                F.lit(0).cast(WEIGHT_TYPE).alias("idf"))
        terms = self._written(terms.select("query_id", "token", "qtf", "idf"), "terms")
        own = terms.select("token", "idf").distinct()
        if k is None:
            own = own.unionByName(own.sparkSession.range(1).select(
                F.lit(MARKER).alias("token"), F.lit(0).cast(WEIGHT_TYPE).alias("idf")))
        rows = self._weighted(self.blocks.join(F.broadcast(own), "token"), ["token", "cls"], among)
        if k is not None:
            rows = rows.unionByName(_first_ids(self._among(among), k).select(
                F.lit(MARKER).alias("token"), "cls", "cand_id", F.lit(0).cast("bigint").alias("w")))
        spark = rows.sparkSession
        n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-self.stats.n_docs // PART_DOCS))
        # numbered: adaptive execution must not merge the pair-making stage
        rows = rows.withColumn("block", F.xxhash64("cand_id")).repartition(n, "block")
        pairs = rows.join(F.broadcast(terms.drop("idf").unionByName(marker.drop("idf"))), "token")
        return (pairs.groupBy("block", "query_id", "cls", "cand_id")
                .agg(F.sum(F.col("qtf") * F.col("w")).alias("units")).drop("block"))

    def _among(self, among: DataFrame | None) -> DataFrame:
        """The documents, of the ids ``among`` alone if given."""
        return self.docs if among is None else self.docs.join(self._small(among, 16), "cand_id", "left_semi")

    def scores(self, queries: DataFrame, k: int | None = None, prune: bool = False,
               among: DataFrame | None = None) -> DataFrame:
        """(query_id, cls, cand_id, score) for pairs that can reach the top k.  With
        ``among`` (P2) only its ids are candidates, and no other pair is made; the
        statistics stay those of the whole pool."""
        size = F.octet_length("token") + F.lit(32)
        fits = _fits(_query_terms(queries), size)
        terms = self.terms(queries)
        # Full ranking, or negative weights (unmatched ids can then outrank
        # matched ones anywhere): every id carries the marker.
        whole = k is None or self.stats.floor_idf < 0
        score = (F.col("units").cast("double") / F.lit(float(SCALE))).alias("score")
        if fits and not (prune and not whole) and _fits(queries.select("query_id"), F.lit(32)):
            return self._pairs(terms, queries, None if whole else k, among).select(
                "query_id", "cls", "cand_id", score)
        cols = ["query_id", "cls", "cand_id", "units"]
        if prune and not whole:
            found = self.pruned_scores(terms, fits, k, among)[0]
        else:
            found = self._matches(terms, fits, None, among).select(*cols)
        docs = self._among(among)
        marked = docs.select("cand_id", "cls") if whole else _first_ids(docs, k)
        asked = queries.select("query_id", F.lit(MARKER).alias("token"))
        if _fits(asked, F.lit(32)):
            asked = F.broadcast(asked)
        zero = marked.withColumn("token", F.lit(MARKER)).join(asked, "token").select(
            "query_id", "cls", "cand_id", F.lit(0).cast("bigint").alias("units"))
        return (found.unionByName(zero).groupBy("query_id", "cls", "cand_id")
                .agg(F.sum("units").alias("units")).select("query_id", "cls", "cand_id", score))

    def rank(self, queries: DataFrame, k: int | None = None, prune: bool = False,
             among: DataFrame | None = None) -> DataFrame:
        """(query_id, [by], rank, cand_id, score)."""
        order = [F.col("score").desc(), F.col("cand_id").desc()]
        ranked = rank_within(self.scores(queries, k, prune, among), ["query_id", "cls"], order, k,
                             max_group_rows=self.stats.n_docs)
        out = ["query_id"] + ([F.col("cls").alias(self.by)] if self.by else []) + \
            [F.col("rank").cast("int").alias("rank"), "cand_id", "score"]
        return ranked.select(*out)


def bm25_scores(pool: DataFrame, queries: DataFrame, k: int | None = None,
                by: str | None = None) -> tuple[DataFrame, CorpusStats]:
    """Scores of (query, cand) pairs that can reach the top k of (query, cls)."""
    index = BM25Index(pool, by)
    return index.scores(queries, k), index.stats


def bm25_rank(pool: DataFrame, queries: DataFrame, k: int | None = None,
              by: str | None = None) -> DataFrame:
    """M1 + W1: (query_id, [by], rank, cand_id, score).

    ``k=None`` gives the full permutation of the pool for every query.
    ``by`` ranks inside each class of that pool column separately (the
    wrong/right split of the feedback selection).
    """
    return BM25Index(pool, by).rank(queries, k)
