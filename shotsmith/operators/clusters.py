"""M6 k-means rankings, A2 cluster sizes, W8 shuffle within cluster, W9 interleave.

For every query the ranking is: a random permutation of each cluster (drawn
independently per query), cut to ``take`` ids, then interleaved round-robin
by cluster index -- 1st of cluster 0, 1st of cluster 1, ..., 2nd of cluster
0, ...  With k clusters: rank = (r - 1) * k + cluster + 1.

The per-query shuffles are seeded permutations of the dense positions inside
each cluster, made only as far as ``take`` (no query x pool pairs).  Clustering is pyspark.ml KMeans with seeds
0, 1, ... until every cluster holds at least ``min_size`` rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotsmith.functions.permutation import grid, permuted
from shotsmith.operators.positions import dense_positions, explode_range
from shotsmith.session import BROADCAST_ROW_LIMIT


def cluster_sizes(assigned: DataFrame, k: int, cluster_col: str = "cluster") -> list[int]:
    """A2: size of clusters 0..k-1; an empty cluster counts 0."""
    got = {r[cluster_col]: r["count"] for r in
           assigned.groupBy(cluster_col).count().collect()}  # at most k rows
    return [int(got.get(i, 0)) for i in range(k)]


def check_sizes(sizes: list[int], min_size: int) -> bool:
    return all(s >= min_size for s in sizes)


def interleave_clusters(queries: DataFrame, assigned: DataFrame, k: int, take: int = 30,
                        seed: int = 123, cluster_col: str = "cluster",
                        min_size: int | None = None) -> DataFrame:
    """W8 + W9: (query_id, rank, cand_id); ``assigned`` = (cand_id, cluster)."""
    sizes = cluster_sizes(assigned, k, cluster_col)
    need = take if min_size is None else min_size
    if not check_sizes(sizes, need):
        raise ValueError(f"cluster sizes {sizes}: every cluster needs >= {need}")
    pos = dense_positions(assigned.select("cand_id", F.col(cluster_col).alias("cluster")),
                          [F.col("cand_id")], group_cols=["cluster"], keep=["cand_id"])
    shape = F.create_map(*[x for i, s in enumerate(sizes) for x in (
        F.lit(i), F.struct(*[F.lit(v).cast("bigint").alias(c) for c, v in zip("nab", (s, *grid(max(s, 1))))]))])
    rows = (queries.select("query_id")
            .withColumn("cluster", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
            .withColumn("_s", F.element_at(shape, F.col("cluster"))))
    drawn = explode_range(rows, take, "_i").withColumn("pos", permuted(
        F.col("_i"), F.col("_s.n"), F.col("_s.a"), F.col("_s.b"), seed, "query_id", "cluster"))
    pos_side = F.broadcast(pos) if sum(sizes) <= BROADCAST_ROW_LIMIT else pos
    return drawn.join(pos_side.withColumn("cluster", F.col("cluster").cast("int")), ["cluster", "pos"]).select(
        "query_id", (F.col("_i") * k + F.col("cluster") + 1).cast("int").alias("rank"), "cand_id")


def kmeans_assign(pool: DataFrame, k: int = 4, min_size: int = 30, tries: int = 25,
                  vec_col: str = "embedding") -> DataFrame:
    """M6: (cand_id, cluster) from the first seed whose clusters all hold
    ``min_size`` rows; raises if no seed in 0..tries-1 does."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = pool.select("cand_id", array_to_vector(F.col(vec_col)).alias("features")) \
        .persist()
    try:
        for rs in range(tries):
            model = KMeans(k=k, seed=rs, featuresCol="features",
                           predictionCol="cluster").fit(data)
            # Written once (small: id, cluster); the sizes are counted from
            # that copy, so the vectors are not transformed a second time.
            assigned = model.transform(data).select("cand_id", "cluster") \
                .checkpoint(eager=True)
            if check_sizes(cluster_sizes(assigned, k), min_size):
                return assigned
        raise ValueError(f"no seed in 0..{tries - 1} gives {k} clusters of >= {min_size}")
    finally:
        data.unpersist()


def kmeans_rankings(queries: DataFrame, pool: DataFrame, k: int = 4, take: int = 30,
                    min_size: int = 30, seed: int = 123, tries: int = 25,
                    vec_col: str = "embedding") -> DataFrame:
    """M6 end to end: cluster the pool, then W8 + W9 for every query."""
    from shotsmith.session import checkpoint_dir
    checkpoint_dir(pool.sparkSession)
    assigned = kmeans_assign(pool, k, min_size, tries, vec_col)
    return interleave_clusters(queries, assigned, k, take, seed, min_size=min_size)
