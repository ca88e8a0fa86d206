"""Pruned exact cosine top k and the opt-in bucketed search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shared import rows
from shotsmith.operators.cosine import cosine_rank
from shotsmith.operators.lsh import cosine_lsh, recall
from shotsmith.operators.pruned import pruned_cosine_rank

ARGS = dict(k=4, exclude_self=True, q_id="id", p_id="id")


def frame(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v])
                                  for i, v in enumerate(vectors)], "id bigint, embedding array<double>")


def clustered(n, dim, groups, seed=0):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(groups, dim))
    return middle[rng.integers(0, groups, n)] + 0.05 * rng.normal(size=(n, dim))


def test_pruned_equals_all_pairs_and_drops_most_of_clustered_data(spark):
    df = frame(spark, clustered(900, 12, 15))
    got, met = pruned_cosine_rank(df, df, block_rows=64, **ARGS)
    assert rows(got) == rows(cosine_rank(df, df, **ARGS))
    per = met.agg(F.count("*"), F.sum("met")).first()
    assert per[0] == 900 and per[1] < 0.35 * 900 * 900


def test_pruned_hot_group_zero_vectors_and_ties(spark):
    vecs = list(clustered(150, 6, 5, seed=1)) + [np.ones(6)] * 120 + [np.zeros(6)] * 70
    df = frame(spark, vecs)
    for block_rows in (16, 2048):
        got, _ = pruned_cosine_rank(df, df, block_rows=block_rows, **ARGS)
        assert rows(got) == rows(cosine_rank(df, df, **ARGS))


def test_pruned_without_clusters_small_and_empty_pools(spark):
    rng = np.random.default_rng(2)
    df = frame(spark, rng.normal(size=(60, 16)))
    got, met = pruned_cosine_rank(df, df, **ARGS)
    assert rows(got) == rows(cosine_rank(df, df, **ARGS))
    assert met.agg(F.max("met")).first()[0] <= 60
    few = frame(spark, rng.normal(size=(3, 16)))
    assert rows(pruned_cosine_rank(few, few, **ARGS)[0]) == rows(cosine_rank(few, few, **ARGS))
    none = df.where("id < 0")
    assert pruned_cosine_rank(df, none, **ARGS)[0].count() == 0
    assert pruned_cosine_rank(none, df, **ARGS)[0].count() == 0


def test_pruned_null_and_non_finite_vectors(spark):
    vecs = list(clustered(40, 4, 3, seed=3)) + [None, [float("nan")] * 4, [float("inf"), 0, 0, 0]]
    df = frame(spark, vecs)
    got = pruned_cosine_rank(df, df, **ARGS)[0].collect()
    finite = df.where("id < 40")
    want = rows(cosine_rank(finite, finite, **ARGS))
    assert sorted(tuple(r) for r in got if r["query_id"] < 40) == want
    assert not any(40 in (r["query_id"], r["cand_id"]) for r in got)


def test_lsh_recall_scores_and_copies(spark):
    vecs = list(clustered(300, 8, 6, seed=4)) + [np.ones(8)] * 200 + [np.zeros(8), None]
    df = frame(spark, vecs)
    exact = cosine_rank(df.where("id < 500"), df.where("id < 500"), **ARGS)
    found = cosine_lsh(df, df, bucket=0.3, tables=6, **ARGS).cache()
    r = recall(found, exact).first()
    assert r["neighbours"] == 2000 and r["recall"] >= 0.9
    copies = [tuple(x) for x in found.where("query_id >= 300").collect()]
    assert len(copies) == 800
    mine = sorted((x[1], x[2], x[3]) for x in copies if x[0] == 300)
    assert mine == [(1, 301, 1.0), (2, 302, 1.0), (3, 303, 1.0), (4, 304, 1.0)]
    assert not found.where("cand_id >= 500 OR query_id >= 500").count()


def test_recall_of_a_worse_ranking(spark):
    exact = spark.createDataFrame([(1, 1, 5, 0.9), (1, 2, 6, 0.8)], "query_id bigint, rank int, cand_id bigint, score double")
    found = spark.createDataFrame([(1, 1, 5, 0.9), (1, 2, 7, 0.7)], exact.schema)
    assert recall(found, exact).first()["recall"] == pytest.approx(0.5)


def test_cells_equal_one_block_over_several_rows_and_columns(spark, monkeypatch):
    """Grids of several rows and columns, copies, ties and repeated ids."""
    from shotsmith.operators import blocks
    from shotsmith.operators.blocks import topk_rows, unit_rows
    monkeypatch.setattr(blocks, "CELL_BLOCKS", 3)
    rng = np.random.default_rng(6)
    vecs = np.vstack([rng.integers(-1, 2, size=(170, 4)), np.ones((60, 4)), np.zeros((9, 4))]).astype(float)
    ids = np.arange(len(vecs)) * 50
    ids[5] = ids[6]
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, vecs)], "id bigint, embedding array<double>")
    u = unit_rows(vecs)
    want = topk_rows(u @ u.T, ids, ids, 4, True)
    first = {q: sorted(zip(-g["score"], g["cand_id"])) for q, g in want.groupby("query_id")}
    assert blocks.grid_shape(239, 239, 8, 4, 16) [1] == 5
    for rank in (cosine_rank(df, df, block_rows=16, **ARGS), pruned_cosine_rank(df, df, block_rows=16, **ARGS)[0]):
        got = {}
        for r in rank.collect():
            got.setdefault(r["query_id"], []).append((-r["score"], r["cand_id"]))
        assert {q: sorted(x) for q, x in got.items()} == {q: x[:4] for q, x in first.items()}


def test_lsh_cells_score_the_pairs_of_the_bucket_join(spark):
    vecs = list(clustered(200, 8, 6, seed=7)) + [np.ones(8)] * 30 + [np.zeros(8), None]
    df = frame(spark, vecs)
    for bucket, tables in ((0.3, 6), (0.02, 2)):
        joined = rows(cosine_lsh(df, df, bucket=bucket, tables=tables, dense=False, **ARGS))
        assert rows(cosine_lsh(df, df, bucket=bucket, tables=tables, dense=True, **ARGS)) == joined


def test_wide_buckets_make_no_pair_rows(spark):
    """A pair that shares many buckets is scored in a cell, not joined a table."""
    from shotsmith.operators.lsh import _score_met
    df = spark.createDataFrame([(i, [1.0, float(i)], [0.0] * 10, [i]) for i in range(300)],
                               "n bigint, u array<double>, buckets array<double>, ids array<bigint>")
    plan = _score_met(df.drop("ids"), df, 5, None)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning(q_block" in plan and "Join" not in plan
