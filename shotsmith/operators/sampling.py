"""Sampling operators: stratified pools and seeded random draws.

Random choices are seeded md5 draws (``functions.hashing``), so a re-run --
after a lost executor, or in another engine -- gives the same rows.

Random orders never pair every query with every candidate.  A query's
sample is the start of its own seeded permutation of the pool positions
(``functions.permutation``): place i maps to a position by an expression, so m
places are m distinct positions, without rounds, distinct steps or
checkpoints.  Positions map to ids through a dense position table (equi-join),
built distributed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shotsmith.functions.hashing import seeded_hash
from shotsmith.functions.permutation import grid, permuted
from shotsmith.operators.positions import dense_positions, explode_range
from shotsmith.session import BROADCAST_ROW_LIMIT

LABEL_WINDOW = 1000     # labels numbered and broadcast in one task; more go by distributed positions


def label_quota(df: DataFrame, pool_size: int, label_col: str = "label") -> int:
    """A3: pool_size // number of distinct labels (integer division)."""
    n_labels = df.select(label_col).distinct().count()
    if n_labels == 0:
        raise ValueError("no labels")
    return pool_size // n_labels


def stratified_pool(df: DataFrame, pool_size: int = 300, seed: int = 75,
                    label_col: str = "label", id_col: str = "cand_id") -> DataFrame:
    """Per label, ``pool_size // labels`` rows without replacement.

    Output keeps the input columns plus ``pool_id`` = the row's position in
    the new pool: labels ascending, then draw order (the reference's file
    order).  Rows without a label form no stratum and are not drawn.
    Raises if a label has fewer rows than its quota.
    """
    df = df.where(F.col(label_col).isNotNull())
    counts = df.groupBy(label_col).count()
    n_labels, fewest = counts.agg(F.count(F.lit(1)), F.min("count")).first()
    if n_labels == 0:
        raise ValueError("no labels")
    quota = pool_size // n_labels
    if fewest < quota:
        short = counts.where(F.col("count") < quota).orderBy(label_col).limit(20).collect()
        raise ValueError(f"labels {[r[label_col] for r in short]} have fewer than {quota} rows")
    w = Window.partitionBy(label_col).orderBy(seeded_hash(seed, id_col), F.col(id_col))
    picked = df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= quota)
    names = counts.select(F.col(label_col).alias("_label"))
    if n_labels <= LABEL_WINDOW:        # few labels: one window numbers them
        place = F.broadcast(names.withColumn("pos", F.row_number().over(Window.orderBy("_label")).cast("bigint") - 1))
    else:
        place = dense_positions(names, [F.col("_label")], keep=["_label"])
    columns = picked.columns
    return (picked.join(place, picked[label_col] == place["_label"])
            .withColumn("pool_id", F.col("pos") * quota + F.col("_r") - 1)
            .select(*[c for c in columns if c != "_r"], "pool_id"))


def pool_positions(pool: DataFrame, id_col: str = "cand_id") -> tuple[DataFrame, int]:
    """(pos, cand_id) with pos = 0..N-1 in id order, and N."""
    pos = dense_positions(pool.select(id_col), [F.col(id_col)], keep=[id_col])
    n = pos.count()
    return pos, n


def _ids_at(rows: DataFrame, positions: DataFrame, n: int) -> DataFrame:
    """``rows`` with the id at their ``pos``."""
    return rows.join(F.broadcast(positions) if n <= BROADCAST_ROW_LIMIT else positions, "pos")


def random_rankings(queries: DataFrame, pool: DataFrame, m: int = 300,
                    seed: int = 123, strict: bool = False) -> DataFrame:
    """Per query, m = min(m, N) pool ids uniformly without replacement,
    in draw order -> (query_id, rank, cand_id).  ``strict``: a pool smaller
    than m is an error instead."""
    positions, n = pool_positions(pool)
    if strict and n < m:
        raise ValueError(f"pool has {n} rows; {m} requested")
    m = min(m, n)
    if m == 0:
        return queries.select("query_id").where("false") \
            .withColumn("rank", F.lit(0)).withColumn("cand_id", F.lit(0).cast("bigint"))
    drawn = explode_range(queries.select("query_id"), m, "_i").withColumn(
        "pos", permuted(F.col("_i"), n, *grid(n), seed, "query_id"))
    return _ids_at(drawn, positions, n).select(
        "query_id", (F.col("_i") + 1).cast("int").alias("rank"), "cand_id")


def random_neighbours(table: DataFrame, k: int = 4, seed: int = 123,
                      id_col: str = "cand_id") -> DataFrame:
    """K distinct random other rows of the same table for every row ->
    (query_id, pos, cand_id); query_id is the row's own id."""
    positions, n = pool_positions(table, id_col)
    if n <= k:
        raise ValueError(f"need more than {k} rows to draw {k} distinct others")
    if id_col != "cand_id":
        positions = positions.withColumnRenamed(id_col, "cand_id")
    # one place more than needed: the row's own position is left out, if drawn
    rows = positions.select(F.col("cand_id").alias("query_id"), F.col("pos").alias("_own"))
    rows = rows.repartition(max(1, int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "query_id")
    drawn = F.transform(F.sequence(F.lit(0), F.lit(k)),
                        lambda i: permuted(i, n, *grid(n), seed, F.col("query_id")))
    others = F.slice(F.filter(drawn, lambda p: p != F.col("_own")), 1, k)
    return _ids_at(rows.select("query_id", F.posexplode(others).alias("_i", "pos")), positions, n).select(
        "query_id", (F.col("_i") + 1).cast("int").alias("pos"), "cand_id")
