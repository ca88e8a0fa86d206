import numpy as np
import pytest
from pyspark.sql import functions as F

from shared import SF0001
from shotsmith.operators.bertscore import bertscore_rank, mmr_rank, token_sentences
from shotsmith.operators.clusters import interleave_clusters, kmeans_assign, kmeans_rankings
from shotsmith.operators.cosine import cosine_rank
from shotsmith.operators.pooling import masked_mean_pool, pooled_vectors
from shotsmith.sources import tables


def test_mean_pool_golden(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 1), (1, [3.0, 4.0], 1), (1, [9.0, 9.0], 0),
                                (2, [5.0, 5.0], 0)], "g int, v array<double>, m int")
    got = {r["g"]: r["vector"] for r in
           pooled_vectors(masked_mean_pool(df, "g", "v", "m"), "g").collect()}
    assert got == {1: [2.0, 3.0], 2: [0.0, 0.0]}


def test_cosine_zero_vector_and_brute_force(spark):
    rng = np.random.default_rng(0)
    vecs = rng.normal(size=(60, 8))
    vecs[3] = 0.0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)],
                               "id bigint, embedding array<double>")
    got = cosine_rank(df, df, k=4, exclude_self=True, q_id="id", p_id="id",
                      block_rows=16).collect()
    unit = vecs / np.maximum(np.linalg.norm(vecs, axis=1, keepdims=True), 1e-12)
    sims = np.round(unit @ unit.T, 6)
    for r in got:
        assert r["score"] == pytest.approx(sims[r["query_id"], r["cand_id"]], abs=1e-9)
        if 3 in (r["query_id"], r["cand_id"]):
            assert r["score"] == 0.0
    for q in range(60):
        mine = [r["cand_id"] for r in sorted((r for r in got if r["query_id"] == q),
                                             key=lambda r: r["rank"])]
        order = sorted((c for c in range(60) if c != q), key=lambda c: (-sims[q, c], c))[:4]
        assert mine == order


def test_cosine_full_rank_is_permutation(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(20)],
                               "id bigint, embedding array<double>")
    got = cosine_rank(df, df, k=None, q_id="id", p_id="id", block_rows=8).collect()
    assert len(got) == 400
    for q in range(20):
        assert sorted(r["rank"] for r in got if r["query_id"] == q) == list(range(1, 21))


def brute_f1(a, b):
    a = a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-12)
    b = b / np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-12)
    s = a @ b.T
    r, p = s.max(axis=1).mean(), s.max(axis=0).mean()
    return 0.0 if p + r == 0 else 2 * p * r / (p + r)


def relevance_order(scores):
    """What diversity without effect leaves: highest F1 first, ties to the smaller id."""
    ids = np.array(sorted(scores))
    return ids[np.lexsort((ids, [-scores[i] for i in ids]))].tolist()


def test_f1_matrix_and_mmr_against_brute_force(spark):
    rng = np.random.default_rng(2)
    sents = {i: rng.normal(size=(rng.integers(1, 5), 6)) for i in range(25)}
    long_rows = [(i, j, v.tolist()) for i, m in sents.items() for j, v in enumerate(m)]
    toks = spark.createDataFrame(long_rows, "sid bigint, pos int, v array<double>")
    q = token_sentences(toks, "sid", "pos", "v", "query_id")
    p = token_sentences(toks, "sid", "pos", "v", "cand_id")
    got = bertscore_rank(q, p, k=None, exclude_self=True, block_rows=4).collect()
    for r in got:
        assert r["f1"] == pytest.approx(round(brute_f1(sents[r["query_id"]],
                                                       sents[r["cand_id"]]), 6), abs=1e-9)
    mmr = mmr_rank(q, p, k=None, exclude_self=True).collect()
    for qid in sents:
        scores = {c: round(brute_f1(sents[qid], sents[c]), 6) for c in sents if c != qid}
        mine = [r["cand_id"] for r in sorted((r for r in mmr if r["query_id"] == qid),
                                             key=lambda r: r["rank"])]
        assert mine == relevance_order(scores)


def test_mmr_order_golden():
    assert relevance_order({0: 0.5, 1: 0.9, 2: 0.9, 3: 0.1}) == [1, 2, 0, 3]


def test_interleave_invariants(spark):
    assigned = spark.createDataFrame([(c * 10 + i, c) for c in range(4) for i in range(2)]
                                     + [(100 + i, i % 4) for i in range(40)],
                                     "cand_id bigint, cluster int")
    queries = spark.createDataFrame([(q,) for q in range(6)], "query_id bigint")
    got = interleave_clusters(queries, assigned, k=4, take=2, seed=5).collect()
    cl = {r["cand_id"]: r["cluster"] for r in assigned.collect()}
    for q in range(6):
        lst = sorted((r["rank"], r["cand_id"]) for r in got if r["query_id"] == q)
        assert [a for a, _ in lst] == list(range(1, 9))
        assert [cl[c] for _, c in lst] == [0, 1, 2, 3, 0, 1, 2, 3]
        assert len({c for _, c in lst}) == 8
    with pytest.raises(ValueError):
        interleave_clusters(queries, assigned, k=5, take=2)


def test_interleave_rounds_agree(spark):
    """take = cluster size needs several draw rounds; each cluster is then
    fully permuted, and its first picks are those of a smaller take."""
    assigned = spark.createDataFrame([(i, i % 4) for i in range(160)],
                                     "cand_id bigint, cluster int")
    queries = spark.createDataFrame([(q,) for q in range(30)], "query_id bigint")

    def picks(take):
        out = {}
        for r in interleave_clusters(queries, assigned, k=4, take=take, seed=9).collect():
            r0 = r["rank"] - 1
            out[(r["query_id"], r0 % 4, r0 // 4)] = r["cand_id"]
        return out

    full, head = picks(40), picks(10)
    assert len(full) == 30 * 160
    for q in range(30):
        for c in range(4):
            assert {full[(q, c, j)] for j in range(40)} == set(range(c, 160, 4))
    assert all(full[key] == cand for key, cand in head.items())


def test_kmeans_rankings_invariants(spark):
    v = tables.vectors(spark, SF0001).select(F.col("vec_id").alias("cand_id"), "embedding")
    q = tables.queries(spark, SF0001)
    assigned = kmeans_assign(v, k=4, min_size=30)
    sizes = [r["count"] for r in assigned.groupBy("cluster").count().collect()]
    assert len(sizes) == 4 and min(sizes) >= 30
    got = kmeans_rankings(q, v, k=4, take=30, min_size=30).collect()
    cl = {r["cand_id"]: r["cluster"] for r in assigned.collect()}
    per = {}
    for r in got:
        per.setdefault(r["query_id"], []).append((r["rank"], r["cand_id"]))
    assert len(per) == q.count()
    for lst in per.values():
        lst.sort()
        assert [a for a, _ in lst] == list(range(1, 121))
        blocks = [lst[i:i + 4] for i in range(0, 120, 4)]
        assert all(sorted(cl[c] for _, c in b) == [0, 1, 2, 3] for b in blocks)


def test_normalise_and_norm_columns(spark):
    from shotsmith.functions.vectors import cosine, dot, l2_norm, normalise
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])],
                               "a array<double>, b array<double>")
    got = df.select(normalise("a").alias("u"), l2_norm("a").alias("n"),
                    dot("a", "b").alias("d"), cosine("a", "b").alias("c")).collect()
    assert got[0]["u"] == pytest.approx([0.6, 0.8]) and got[0]["n"] == 5.0
    assert got[0]["d"] == 24.0 and got[0]["c"] == pytest.approx(0.96)
    assert got[1]["u"] == [0.0, 0.0] and got[1]["c"] == 0.0


def test_cosine_ties_go_to_smaller_id(spark):
    """Integer vectors tie often; ties rank by id ascending after rounding."""
    rng = np.random.default_rng(3)
    vecs = rng.integers(-1, 2, size=(80, 3)).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)],
                               "id bigint, embedding array<double>")
    got = cosine_rank(df, df, k=6, q_id="id", p_id="id", block_rows=16).collect()
    unit = vecs / np.maximum(np.linalg.norm(vecs, axis=1, keepdims=True), 1e-12)
    sims = np.round(unit @ unit.T, 6)
    for q in range(80):
        mine = [r["cand_id"] for r in sorted((r for r in got if r["query_id"] == q),
                                             key=lambda r: r["rank"])]
        assert mine == sorted(range(80), key=lambda c: (-sims[q, c], c))[:6]


def test_nan_vectors_rank_last_and_stay():
    from shotsmith.operators.blocks import topk_rows
    got = topk_rows(np.array([[0.2, np.nan, 0.9]]), np.array([7]), np.array([1, 2, 3]), None, True)
    assert got["cand_id"].tolist() == [3, 1, 2]


def test_f1_tiles_and_empty_sentences(monkeypatch):
    """Small tiles, ragged lengths: the same F1 as pair by pair; no tokens score 0."""
    from shotsmith.operators import bertscore
    rng = np.random.default_rng(4)
    lengths = [3, 0, 9, 1, 5, 0, 2]
    a = [rng.normal(size=(n, 4)) for n in lengths]
    b = [rng.normal(size=(n, 4)) for n in reversed(lengths)]
    monkeypatch.setattr(bertscore, "TILE_TOKENS", 4)
    got = bertscore.f1_matrix(a, b)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            want = brute_f1(x, y) if len(x) and len(y) else 0.0
            assert got[i, j] == pytest.approx(want, abs=1e-12)
