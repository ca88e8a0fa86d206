"""Composite jobs (the user-facing API): C1 build_pool .. C5 run_with_feedback.

Every job takes DataFrames and returns DataFrames; writing is the caller's
choice (``sources.results.write_results``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotsmith.functions.labels import is_correct, normalise_labels
from shotsmith.functions.templates import TaskConfig
from shotsmith.operators.bm25 import bm25_rank
from shotsmith.operators.prompt import assemble_prompts
from shotsmith.operators.sampling import random_neighbours, random_rankings, stratified_pool
from shotsmith.operators.scoring import decode_label, score_prompts, shape_results, vote_scorer
from shotsmith.operators.select import select_quota, select_top_n
from shotsmith.session import BROADCAST_ROW_LIMIT, checkpoint_dir

RETRIEVAL_MODES = ("random_each", "bm25", "sbert", "kmeans", "mmr")


def build_pool(table: DataFrame, pool_size: int = 300, seed: int = 75,
               label_col: str = "label") -> DataFrame:
    """Stratified example pool; ``pool_id`` is the new positional id."""
    return stratified_pool(table, pool_size, seed, label_col)


def _as_queries(table: DataFrame) -> DataFrame:
    return table.withColumnRenamed("cand_id", "query_id")


def _decode(prompts: DataFrame, cfg: TaskConfig, scorer, kind: str, seed: int) -> DataFrame:
    scored = score_prompts(prompts, scorer, list(cfg.labels), kind=kind)
    return scored.withColumn("outputs", decode_label("scores", cfg.labels, "query_id", seed))


def prior_prompts(pool: DataFrame, cfg: TaskConfig, k: int = 4, seed: int = 123) -> DataFrame:
    """Prior layout: every pool row with k random other rows as examples."""
    demos = random_neighbours(pool, k, seed)
    return assemble_prompts(_as_queries(pool), demos, pool, cfg, "prior", n=k)


def prior_predict(pool: DataFrame, cfg: TaskConfig, scorer=vote_scorer, kind: str = "column",
                  k: int = 4, seed: int = 123) -> DataFrame:
    """Label every pool row with the scorer -> result table."""
    return shape_results(_decode(prior_prompts(pool, cfg, k, seed), cfg, scorer, kind, seed),
                         "query_id")


def output_counts(results: DataFrame) -> DataFrame:
    """A1: rows per output label, most frequent first."""
    return (results.groupBy("outputs").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.col("n").desc(), F.col("outputs")))


def write_back(pool: DataFrame, results: DataFrame) -> tuple[DataFrame, int]:
    """Pool with ``prediction`` from the results, and the number of rows
    whose result label differs from the pool label (must be 0).  Results
    that repeat an id would multiply pool rows; they raise.

    The joined table is written to the checkpoint folder once, so counting
    the mismatches does not run the scoring a second time.
    """
    checkpoint_dir(pool.sparkSession)
    res = results.select(F.col("id").cast("bigint").alias("cand_id"),
                         F.col("label").alias("_rlabel"), F.col("outputs"))
    n, ids = res.agg(F.count(F.lit(1)), F.count_distinct("cand_id")).first()
    if n != ids:
        raise ValueError(f"{n} results for {ids} ids: an id must have one result")
    # One result per pool row: the pool's (cheap) count bounds the results.
    if pool.count() <= BROADCAST_ROW_LIMIT:
        res = F.broadcast(res)
    joined = (normalise_labels(pool, ("label",)).join(res, "cand_id", "left")
              .withColumn("_mismatch", ~F.col("_rlabel").eqNullSafe(F.col("label")))
              .drop("prediction", "_rlabel").withColumnRenamed("outputs", "prediction")
              .checkpoint(eager=True))
    mismatches = joined.where(F.col("_mismatch")).count()
    return joined.drop("_mismatch"), mismatches


def retrieve(mode: str, pool: DataFrame, queries: DataFrame, k: int | None = None,
             seed: int = 123, by: str | None = None, **kw) -> DataFrame:
    """A ranking table (query_id, rank, cand_id[, score]) by one mode, cut to
    the first ``k`` ranks.  Without ``k``: the whole pool (bm25, sbert, mmr),
    ``m`` = 300 draws (random_each) or the 30 ids of each cluster (kmeans)."""
    if mode == "random_each":
        return random_rankings(queries, pool, kw.get("m", 300) if k is None else k, seed)
    if mode == "bm25":
        return bm25_rank(pool, queries, k, by)
    if mode == "sbert":
        from shotsmith.operators.cosine import cosine_rank
        from shotsmith.operators.embed import embed
        enc, dt = kw["encoder"], kw.get("dtype", "float")
        return cosine_rank(embed(queries, enc, "query_id", dtype=dt),
                           embed(pool, enc, "cand_id", dtype=dt), k)
    if mode == "kmeans":
        from shotsmith.operators.clusters import kmeans_rankings
        from shotsmith.operators.embed import embed
        ranking = kmeans_rankings(queries, embed(pool, kw["encoder"], "cand_id"), seed=seed)
        return ranking if k is None else ranking.where(F.col("rank") <= k)
    if mode == "mmr":
        from shotsmith.operators.bertscore import mmr_rank
        from shotsmith.operators.embed import embed_tokens
        enc = kw["token_encoder"]
        return mmr_rank(embed_tokens(queries, enc, "query_id"),
                        embed_tokens(pool, enc, "cand_id"), k)
    raise ValueError(f"unknown mode {mode!r}; one of {RETRIEVAL_MODES}")


def run_baseline(queries: DataFrame, pool: DataFrame, ranking: DataFrame, cfg: TaskConfig,
                 n: int = 4, scorer=vote_scorer, kind: str = "column",
                 seed: int = 123) -> DataFrame:
    """C4: top-n examples with their labels -> result table."""
    demos = select_top_n(ranking, n, dedupe=True)
    prompts = assemble_prompts(queries, demos, pool, cfg, "baseline", n=n)
    return shape_results(_decode(prompts, cfg, scorer, kind, seed), "query_id")


def feedback_demos(queries: DataFrame, pool: DataFrame, n: int = 4, wrong: int = 2,
                   ranking: DataFrame | None = None) -> DataFrame:
    """W4 input: a given ranking, or BM25 ranked inside each correctness class
    (only max(quota) ids per class are needed, so no full ranking is built)."""
    if ranking is not None:
        return select_quota(ranking, n, wrong, pool=pool)
    flagged = pool.withColumn("is_correct", is_correct("label", "prediction"))
    k = max(min(n, wrong), max(0, n - wrong), 1)
    return select_quota(bm25_rank(flagged, queries, k, by="is_correct"), n, wrong)


def run_with_feedback(queries: DataFrame, pool: DataFrame, cfg: TaskConfig, n: int = 4,
                      wrong: int = 2, ranking: DataFrame | None = None, scorer=vote_scorer,
                      kind: str = "column", seed: int = 123) -> DataFrame:
    """Wrong-first quota, prompts with corrections and feedback -> results."""
    demos = feedback_demos(queries, pool, n, wrong, ranking)
    prompts = assemble_prompts(queries, demos, pool, cfg, "feedback", n=n)
    return shape_results(_decode(prompts, cfg, scorer, kind, seed), "query_id")
