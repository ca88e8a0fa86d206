from pyspark.sql import functions as F

from shared import SF0001, SF001, rows
from shotsmith.functions.templates import task_config
from shotsmith.operators.embed import HashingEncoder, embed
from shotsmith.operators.prompt import assemble_prompts
from shotsmith.plans import jobs
from shotsmith.sources import tables
from shotsmith.sources.labelled import with_model_predictions


def test_model_predictions_join(spark):
    pool = spark.createDataFrame([(0, "a", "x", "old"), (1, "b", "y", "old")],
                                 "cand_id bigint, sentence string, label string, "
                                 "prediction string")
    preds = spark.createDataFrame([("m1", 0, "x"), ("m2", 0, "z"), ("m2", 1, "y")],
                                  "model string, cand_id bigint, prediction string")
    got = dict(rows(with_model_predictions(pool, preds, "m1"), "cand_id", "prediction"))
    assert got == {0: "x", 1: "nan"}
    got = dict(rows(with_model_predictions(pool, preds, "m2"), "cand_id", "prediction"))
    assert got == {0: "z", 1: "y"}


def test_user_template_callable(spark):
    cfg = task_config("sst2")
    pool = spark.createDataFrame([(0, "x", "negative", "negative")],
                                 "cand_id bigint, sentence string, label string, "
                                 "prediction string")
    q = spark.createDataFrame([(1, "y", None)], "query_id bigint, sentence string, "
                                                "label string")
    demos = spark.createDataFrame([(1, 1, 0)], "query_id bigint, pos int, cand_id bigint")
    tmpl = lambda c: F.concat(F.lit("Text: "), F.upper(F.col("sentence")), F.lit("\n"))  # noqa
    got = assemble_prompts(q, demos, pool, cfg, "baseline", template=tmpl).first()["prompt"]
    assert got == cfg.instruction + "Text: X\nLabel: negative\n\nText: Y\nLabel: "


def test_output_counts_and_build_pool(spark):
    res = spark.createDataFrame([("0", "p", "a", "x"), ("1", "p", "a", "y"),
                                 ("2", "p", "a", "x")],
                                "id string, input_all_tokens string, label string, outputs string")
    assert [tuple(r) for r in jobs.output_counts(res).collect()] == [("x", 2), ("y", 1)]
    pool = jobs.build_pool(tables.corpus(spark, SF001), 300, seed=75)
    assert pool.count() == 300
    assert sorted(r["pool_id"] for r in pool.collect()) == list(range(300))


def test_feedback_job_with_imported_ranking(spark):
    pool, q = tables.pool(spark, SF0001), tables.queries(spark, SF0001)
    cfg = task_config("sst2")
    from shotsmith.operators.bm25 import bm25_rank
    ranking = bm25_rank(pool, q, k=None).select("query_id", "rank", "cand_id")
    a = jobs.run_with_feedback(q, pool, cfg, n=4, wrong=2, ranking=ranking)
    b = jobs.run_with_feedback(q, pool, cfg, n=4, wrong=2)
    assert rows(a) == rows(b)


def test_hashing_encoder_hook(spark):
    df = spark.createDataFrame([(0, "a b"), (1, ""), (2, None)], "id bigint, sentence string")
    got = {r["id"]: r["embedding"] for r in embed(df, HashingEncoder(16), "id").collect()}
    import numpy as np
    for v in got.values():
        assert len(v) == 16 and abs(np.linalg.norm(v) - 1.0) < 1e-5


def test_retrieve_runs_every_mode_and_honours_k(spark):
    from shotsmith.operators.embed import HashingTokenEncoder, PooledEncoder
    pool = spark.createDataFrame(
        [(i, f"w{i % 7} w{i % 11} common {i}", "negative", "positive") for i in range(200)],
        "cand_id bigint, sentence string, label string, prediction string")
    q = spark.createDataFrame([(0, "w1 common", None), (1, "w3 w5", None)],
                              "query_id bigint, sentence string, label string")
    pooled = PooledEncoder(HashingTokenEncoder(16))
    given = {"sbert": {"encoder": pooled}, "kmeans": {"encoder": pooled},
             "mmr": {"token_encoder": HashingTokenEncoder(16)}}
    for mode in jobs.RETRIEVAL_MODES:
        got = rows(jobs.retrieve(mode, pool, q, k=6, **given.get(mode, {})), "query_id", "rank")
        assert got == [(i, r) for i in (0, 1) for r in range(1, 7)], mode


def test_pooled_tokens_point_where_the_sentence_vector_does(spark):
    import numpy as np
    from shotsmith.operators.embed import HashingTokenEncoder, PooledEncoder
    texts = ["a b a", "", "c d e f"]
    one = HashingEncoder(16).load()(texts)
    for v, w in zip(PooledEncoder(HashingTokenEncoder(16)).load()(texts), one):
        assert np.allclose(v / np.linalg.norm(v), w)
