import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shotsmith.functions.templates import FEEDBACK, INSTRUCTION, task_config
from shotsmith.operators.prompt import assemble_prompts
from shotsmith.operators.select import (limit_pool, restrict_rankings, select_quota,
                                        select_top_n)

RANKING = [5, 3, 8, 1, 9, 2]
WRONG = {8, 2}


def ranking_df(spark, ids=RANKING, q=0):
    return spark.createDataFrame([(q, i + 1, c) for i, c in enumerate(ids)],
                                 "query_id bigint, rank int, cand_id bigint")


def pool_df(spark, ids=range(10)):
    data = [(c, f"s{c}", "neg", "pos" if c in WRONG else "neg") for c in ids]
    return spark.createDataFrame(data, "cand_id bigint, sentence string, label string, "
                                       "prediction string")


def picked(df):
    return [r["cand_id"] for r in df.orderBy("pos").collect()]


@pytest.mark.parametrize("n,w,want", [(4, 2, [8, 2, 5, 3]), (4, 3, [8, 2, 5]),
                                      (4, 0, [5, 3, 1, 9]), (1, 2, [8])])
def test_quota_goldens(spark, n, w, want):
    got = select_quota(ranking_df(spark), n, w, pool=pool_df(spark))
    assert picked(got) == want
    assert [r["pos"] for r in got.orderBy("pos").collect()] == list(range(1, len(want) + 1))


def test_baseline_top_n(spark):
    assert picked(select_top_n(ranking_df(spark), 4)) == [5, 3, 8, 1]


def test_top_n_dedupes_imported_ranking(spark):
    r = ranking_df(spark, [5, 5, 3, 8, 3, 1])
    assert picked(select_top_n(r, 4, dedupe=True)) == [5, 3, 8, 1]


def test_null_prior_counts_wrong(spark):
    pool = spark.createDataFrame([(0, "x", "0", None), (1, "y", "0", "0")],
                                 "cand_id bigint, sentence string, label string, "
                                 "prediction string")
    got = select_quota(ranking_df(spark, [1, 0]), 1, 1, pool=pool)
    assert picked(got) == [0]


def test_pool_trim_and_restrict(spark):
    pool = pool_df(spark, range(10))
    head = limit_pool(pool, 5)
    assert sorted(r["cand_id"] for r in head.collect()) == [0, 1, 2, 3, 4]
    got = restrict_rankings(ranking_df(spark), head).orderBy("rank").collect()
    assert [r["cand_id"] for r in got] == [3, 1, 2]
    assert [r["rank"] for r in got] == [1, 2, 3]
    with pytest.raises(ValueError):
        limit_pool(pool, 11)


def test_feedback_prompt_bytes(spark):
    cfg = task_config("sst2")
    pool = spark.createDataFrame([(0, "x", "negative", "positive")],
                                 "cand_id bigint, sentence string, label string, "
                                 "prediction string")
    queries = spark.createDataFrame([(7, "y", None)], "query_id bigint, sentence string, "
                                                      "label string")
    demos = spark.createDataFrame([(7, 1, 0)], "query_id bigint, pos int, cand_id bigint")
    got = assemble_prompts(queries, demos, pool, cfg, "feedback").first()
    want = (INSTRUCTION["sst2"] + "Sentence: x\nPrediction: positive\nCorrect Label: negative\n"
            + FEEDBACK["wrong"] + "Sentence: y\nCorrect Label: ")
    assert got["prompt"] == want
    assert got["label"] == "nan"


def test_baseline_prompt_order_and_bare_query(spark):
    cfg = task_config("poem")
    pool = pool_df(spark, range(3))
    queries = spark.createDataFrame([(1, "q1", "neg"), (2, "q2", "pos")],
                                    "query_id bigint, sentence string, label string")
    demos = spark.createDataFrame([(1, 2, 0), (1, 1, 2)], "query_id bigint, pos int, "
                                                          "cand_id bigint")
    got = {r["query_id"]: r["prompt"] for r in
           assemble_prompts(queries, demos, pool, cfg, "baseline", n=4).collect()}
    inst = INSTRUCTION["poem"]
    assert got[1] == (inst + "Sentence: s2\nLabel: neg\n\n" + "Sentence: s0\nLabel: neg\n\n"
                      + "Sentence: q1\nLabel: ")
    assert got[2] == inst + "Sentence: q2\nLabel: "


def test_templates_families(spark):
    from shotsmith.functions.templates import input_template
    df = spark.createDataFrame([("s", "food", "t", "p", "h")],
                               "sentence string, aspect string, target string, text1 string, "
                               "text2 string")
    got = df.select(input_template(task_config("rest")).alias("a"),
                    input_template(task_config("pstance")).alias("b"),
                    input_template(task_config("mnli")).alias("c")).first()
    assert got["a"] == "Sentence: s What is the sentiment polarity of the aspect food ?\n"
    assert got["b"] == "Sentence: s What is the attitude of sentence toward target t ?\n"
    assert got["c"] == "Premise: p\nHypothesis: h\n"
    with pytest.raises(ValueError):
        task_config("agnews")


@settings(max_examples=6, deadline=None)
@given(perms=st.lists(st.permutations(list(range(10))), min_size=1, max_size=5),
       wrong=st.sets(st.integers(0, 9)), n=st.integers(1, 6), w=st.integers(0, 6))
def test_quota_matches_loop(spark, perms, wrong, n, w):
    """Many queries at once against the plain loop: min(n, w) wrong ids,
    then max(0, n - w) right ones, each in rank order, no refill."""
    ranking = spark.createDataFrame(
        [(q, i + 1, c) for q, p in enumerate(perms) for i, c in enumerate(p)],
        "query_id bigint, rank int, cand_id bigint")
    pool = spark.createDataFrame(
        [(c, f"s{c}", "neg", "pos" if c in wrong else "neg") for c in range(10)],
        "cand_id bigint, sentence string, label string, prediction string")
    got = {}
    for r in select_quota(ranking, n, w, pool=pool).collect():
        got.setdefault(r["query_id"], []).append((r["pos"], r["cand_id"]))
    for q, p in enumerate(perms):
        want = [c for c in p if c in wrong][:min(n, w)] + \
               [c for c in p if c not in wrong][:max(0, n - w)]
        assert [c for _, c in sorted(got.get(q, []))] == want
        assert [i for i, _ in sorted(got.get(q, []))] == list(range(1, len(want) + 1))


def test_quota_counts_a_repeated_id_once(spark):
    from shotsmith.operators.select import select_quota
    ranking = spark.createDataFrame([(0, r + 1, c) for r, c in enumerate([0, 0, 1, 2, 3])],
                                    "query_id bigint, rank int, cand_id bigint")
    pool = spark.createDataFrame([(c, "a", "b" if c < 2 else "a") for c in range(4)],
                                 "cand_id bigint, label string, prediction string")
    got = sorted((r["pos"], r["cand_id"]) for r in select_quota(ranking, 4, 2, pool=pool).collect())
    assert got == [(1, 0), (2, 1), (3, 2), (4, 3)]


def test_write_back_refuses_repeated_results(spark):
    import pytest
    from shotsmith.plans.jobs import write_back
    pool = spark.createDataFrame([(1, "a", "a")], "cand_id bigint, label string, prediction string")
    res = spark.createDataFrame([("1", "a", "a"), ("1", "a", "b")], "id string, label string, outputs string")
    with pytest.raises(ValueError):
        write_back(pool, res)


def test_positional_pool_must_be_contiguous(spark):
    from shotsmith.operators.select import limit_pool
    frame = lambda ids: spark.createDataFrame([(i, "x") for i in ids], "cand_id bigint, label string")
    assert limit_pool(frame([4, 2, 1, 0, 3]), 3, positional=True).count() == 3
    for ids in ([0, 1, 3, 4], [0, 1, 1, 2], [0, 1], []):
        with pytest.raises(ValueError):
            limit_pool(frame(ids), 3, positional=True)


@pytest.mark.parametrize("k", [None, 3])
def test_candidates_restricted_before_the_pairs(spark, k):
    from shared import SF0001, rows
    from shotsmith.operators.bm25 import BM25Index
    from shotsmith.operators.select import restrict_rankings
    from shotsmith.sources import tables
    pool, q = tables.pool(spark, SF0001), tables.queries(spark, SF0001).limit(5)
    index, among = BM25Index(pool), pool.where("cand_id % 4 = 1").select("cand_id")
    want = restrict_rankings(index.rank(q).select("query_id", "rank", "cand_id"), among)
    want = rows(want if k is None else want.where(f"rank <= {k}"), "query_id", "rank", "cand_id")
    for prune in (False, True):
        assert rows(index.rank(q, k, prune, among), "query_id", "rank", "cand_id") == want
