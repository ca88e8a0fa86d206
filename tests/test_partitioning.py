"""Same answer at 1, 8 (the test default) and 64 shuffle partitions;
heavy stages keep their task count."""

import pytest
from pyspark.sql import functions as F

from shared import SF0001, SF001, rows
from shotsmith.functions.arrays import gather, reorder
import __spark_entry__ as E

NAMES = ["select_quota", "random_rankings", "random_neighbours", "cluster_interleave",
         "cosine_top5", "pool_stratified", "mean_pool_masked", "prompt_feedback"]


@pytest.mark.parametrize("name", NAMES)
def test_partition_count_independent(spark, name):
    sf = SF001 if name == "pool_stratified" else SF0001
    fn = E.queries()[name]
    want = rows(fn(spark, sf))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        got_many = rows(fn(spark, sf))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got_one = rows(fn(spark, sf))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got_many == want and got_one == want


def test_reorder_and_gather(spark):
    df = spark.createDataFrame([(["a", "b", "c"], [2, 0, 1])], "v array<string>, o array<int>")
    got = df.select(reorder("v", "o").alias("r"), gather("v", [1, 2]).alias("g")).first()
    assert got["r"] == ["c", "a", "b"] and got["g"] == ["b", "c"]


def test_random_rankings_strict(spark):
    from shotsmith.operators.sampling import random_rankings
    from shotsmith.sources import tables
    with pytest.raises(ValueError):
        random_rankings(tables.queries(spark, SF0001), tables.pool(spark, SF0001), m=10_000,
                        strict=True)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_heavy_stages_keep_their_task_count(spark):
    """The CPU-heavy stages are small in bytes; a numbered repartition keeps
    adaptive execution from merging them into one task."""
    from shotsmith.operators.bm25 import bm25_rank
    from shotsmith.operators.cosine import cosine_rank
    from shotsmith.sources import tables
    v = tables.vectors(spark, SF0001).select(F.col("vec_id").alias("id"), "embedding")
    plan = _plan(cosine_rank(v, v, k=3, q_id="id", p_id="id"))
    assert "rangepartitioning(q_block" in plan and "REPARTITION_BY_NUM" in plan
    plan = _plan(bm25_rank(tables.pool(spark, SF0001), tables.queries(spark, SF0001), k=5))
    assert "hashpartitioning(block" in plan and "REPARTITION_BY_NUM" in plan
    assert "documents.parquet" not in plan      # a query batch reads no pool text
