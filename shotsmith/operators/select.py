"""Demonstration selection from a ranking table (query_id, rank, cand_id).

All selections are per-query ``row_number`` windows with a literal bound,
which Spark plans as WindowGroupLimit: every partition keeps at most n rows
per query before the shuffle, so a query with a huge ranking never sends it
whole to one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shotsmith.functions.labels import is_correct
from shotsmith.operators.ranking import rank_within
from shotsmith.session import BROADCAST_ROW_LIMIT


def dedupe_ranking(ranking: DataFrame) -> DataFrame:
    """Keep each id once per query, at its best rank (imported rankings)."""
    return ranking.groupBy("query_id", "cand_id").agg(F.min("rank").alias("rank"))


def select_top_n(ranking: DataFrame, n: int = 4, dedupe: bool = True) -> DataFrame:
    """The first n distinct ids in rank order -> (query_id, pos, cand_id)."""
    if dedupe:
        ranking = dedupe_ranking(ranking)
    w = Window.partitionBy("query_id").orderBy("rank", "cand_id")
    return (ranking.select("query_id", "rank", "cand_id")
            .withColumn("pos", F.row_number().over(w))
            .where(F.col("pos") <= n)
            .select("query_id", F.col("pos").cast("int").alias("pos"), "cand_id"))


def correctness(pool: DataFrame) -> DataFrame:
    """(cand_id, is_correct) of every pool row (P3 + P4)."""
    return pool.select("cand_id", is_correct("label", "prediction").alias("is_correct"))


def attach_correctness(ranking: DataFrame, pool: DataFrame) -> DataFrame:
    flags = correctness(pool)
    if flags.limit(BROADCAST_ROW_LIMIT + 1).count() <= BROADCAST_ROW_LIMIT:
        flags = F.broadcast(flags)
    return ranking.join(flags, "cand_id")


def select_quota(ranking: DataFrame, n: int = 4, wrong: int = 2,
                 pool: DataFrame | None = None) -> DataFrame:
    """First min(n, wrong) mispredicted ids, then first max(0, n-wrong)
    correct ones, each in rank order.  A short class is not refilled.

    ``ranking`` holds ``is_correct`` already (a per-class ranking, each id
    once) or gets it from ``pool`` (an imported one, whose repeats count once).  Returns (query_id, pos, cand_id, is_correct); ``pos`` is
    the prompt order: the wrong ones first.
    """
    n_wrong, n_right = min(n, wrong), max(0, n - wrong)
    if "is_correct" not in ranking.columns:
        ranking = attach_correctness(dedupe_ranking(ranking), pool)
    w = Window.partitionBy("query_id", "is_correct").orderBy("rank", "cand_id")
    bound = max(n_wrong, n_right)
    picked = (ranking.select("query_id", "rank", "cand_id", "is_correct")
              .withColumn("_r", F.row_number().over(w))
              .where(F.col("_r") <= bound)
              .where(F.when(F.col("is_correct"), F.col("_r") <= n_right)
                     .otherwise(F.col("_r") <= n_wrong)))
    # Prompt position: wrong ones 1..a, then right ones a+1..; a = number of
    # wrong ones this query really got.
    n_got_wrong = F.sum(F.when(~F.col("is_correct"), 1).otherwise(0)) \
        .over(Window.partitionBy("query_id"))
    pos = F.when(~F.col("is_correct"), F.col("_r")).otherwise(n_got_wrong + F.col("_r"))
    return picked.select("query_id", pos.cast("int").alias("pos"), "cand_id",
                         "is_correct")


def limit_pool(pool: DataFrame, n: int, positional: bool = False) -> DataFrame:
    """The first n pool rows in position (cand_id) order; the pool must
    hold at least n rows.

    ``positional``: ids are positions 0..N-1 of a file.  The first n must then be
    exactly 0..n-1; a gap or a repeated id raises, and nothing is sorted.
    Otherwise each partition keeps its first n ids (top-n)."""
    if positional:
        head = pool.where(F.col("cand_id").between(0, n - 1))
        rows, ids = head.agg(F.count(F.lit(1)), F.count_distinct("cand_id")).first()
        if rows != n or ids != n:
            raise ValueError(f"positions 0..{n - 1}: {rows} rows with {ids} ids")
        return head
    head = pool.select("cand_id").orderBy("cand_id").limit(n)
    if head.count() != n:
        raise ValueError(f"pool holds fewer than {n} rows")
    if n <= BROADCAST_ROW_LIMIT:
        head = F.broadcast(head)
    return pool.join(head, "cand_id", "left_semi")


def restrict_rankings(ranking: DataFrame, pool: DataFrame) -> DataFrame:
    """Drop ranked ids outside the (trimmed) pool; keep the order and
    renumber ranks 1.. without gaps."""
    ids = pool.select("cand_id")
    n_ids = ids.count()
    if n_ids <= BROADCAST_ROW_LIMIT:
        ids = F.broadcast(ids)
    kept = ranking.join(ids, "cand_id", "left_semi")
    # A query keeps at most one row per pool id: the pool size bounds a group.
    ranked = rank_within(kept.withColumnRenamed("rank", "_old"), ["query_id"],
                         [F.col("_old"), F.col("cand_id")], None, max_group_rows=n_ids)
    return ranked.withColumn("rank", F.col("rank").cast("int")).drop("_old")
