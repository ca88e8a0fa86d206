"""Registered queries: every inventory operator run on the driver's tables.

Each query is a function (spark, sf_dir) -> DataFrame over whole tables, and
most have an oracle SQL string in ``ORACLE`` that computes the same rows
independently (``shotsmith.plans.sql``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotsmith.functions.templates import task_config
from shotsmith.operators import bm25 as bm25_op
from shotsmith.operators.prompt import assemble_prompts
from shotsmith.operators.select import select_quota, select_top_n
from shotsmith.plans import sql as S
from shotsmith.sources import tables

CFG = task_config(tables.DATASET)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


# ---------------------------------------------------------------- BM25

@register("bm25_top20", S.with_bm25(
    "SELECT query_id, rank, cand_id, score FROM bm25 WHERE rank <= 20"))
def bm25_top20(spark, sf):
    return bm25_op.bm25_rank(tables.pool(spark, sf), tables.queries(spark, sf), k=20)


@register("bm25_full_rank", S.with_bm25(
    "SELECT query_id, rank, cand_id, score FROM bm25"))
def bm25_full_rank(spark, sf):
    return bm25_op.bm25_rank(tables.pool(spark, sf), tables.queries(spark, sf), k=None)


def two_file_store(spark, sf):
    """A4: the pool indexed as two files, one after the other."""
    from shotsmith.operators.postings import PostingsStore
    pool = tables.pool(spark, sf)
    store = PostingsStore.create(pool.where("cand_id % 3 <> 0"))
    store.add(pool.where("cand_id % 3 = 0"))
    return store


@register("bm25_store_top20", ORACLE["bm25_top20"])
def bm25_store_top20(spark, sf):
    """M1 from a store that grew by a file: statistics added up, pruned top 20."""
    index = bm25_op.BM25Index(two_file_store(spark, sf))
    return index.rank(tables.queries(spark, sf), k=20, prune=True)


@register("bm25_store_stats", S.with_bm25(
    "SELECT i.token, i.df, CAST(i.idf AS DOUBLE) AS idf FROM idf i"))
def bm25_store_stats(spark, sf):
    """A4: idf of every token after two increments, as from one pass."""
    return bm25_op.BM25Index(two_file_store(spark, sf)).idf.select(
        "token", "df", F.col("idf").cast("double").alias("idf"))


@register("bm25_corpus_stats", S.with_bm25(
    "SELECT st.n AS n_docs, round(st.avgdl, 10) AS avg_len, fl.vocab AS vocab, "
    "round(fl.mean_idf, 10) AS mean_idf, CAST(fl.floor_idf AS DOUBLE) AS floor_idf "
    "FROM st, fl"))
def bm25_corpus_stats(spark, sf):
    st = bm25_op.corpus_stats(tables.pool(spark, sf))
    return spark.createDataFrame(
        [(st.n_docs, round(st.avg_len, 10), st.vocab, round(st.mean_idf, 10),
          float(st.floor_idf))],
        "n_docs bigint, avg_len double, vocab bigint, mean_idf double, floor_idf double")


@register("bm25_idf_floor", S.with_bm25(
    "SELECT token, df, CAST(idf AS DOUBLE) AS idf FROM idf WHERE raw < 0"))
def bm25_idf_floor(spark, sf):
    pool = tables.pool(spark, sf)
    vocab = bm25_op.vocabulary_table(pool)
    idf = bm25_op.idf_table(vocab, bm25_op.corpus_stats(pool, vocab))
    return idf.where(F.col("raw_idf") < 0).select(
        "token", "df", F.col("idf").cast("double").alias("idf"))


# ---------------------------------------------------------------- selection

@register("select_top_n", S.with_bm25(
    "SELECT query_id, rank AS pos, cand_id FROM bm25 WHERE rank <= 4"))
def q_select_top_n(spark, sf):
    ranking = bm25_op.bm25_rank(tables.pool(spark, sf), tables.queries(spark, sf), k=4)
    return select_top_n(ranking, n=4)


def _bm25_quota(spark, sf, n, wrong):
    pool = tables.pool(spark, sf).withColumn(
        "is_correct", F.col("label") == F.col("prediction"))
    k = max(min(n, wrong), max(0, n - wrong))
    ranking = bm25_op.bm25_rank(pool, tables.queries(spark, sf), k=k, by="is_correct")
    return select_quota(ranking, n=n, wrong=wrong)


@register("select_quota")
def q_select_quota(spark, sf):
    return _bm25_quota(spark, sf, 4, 2)


@register("select_quota_short")
def q_select_quota_short(spark, sf):
    return _bm25_quota(spark, sf, 100, 95)


ORACLE["select_quota"] = S.with_bm25(
    "," + S.quota_sql(4, 2) + "\nSELECT query_id, pos, cand_id, is_correct FROM quota")
ORACLE["select_quota_short"] = S.with_bm25(
    "," + S.quota_sql(100, 95) + "\nSELECT query_id, pos, cand_id, is_correct FROM quota")


# ---------------------------------------------------------------- prompts

@register("prompt_baseline", S.with_bm25(S.prompt_sql(
    "sel AS (SELECT query_id, rank AS pos, cand_id FROM bm25 WHERE rank <= 4)",
    "baseline")))
def prompt_baseline(spark, sf):
    pool, queries = tables.pool(spark, sf), tables.queries(spark, sf)
    demos = select_top_n(bm25_op.bm25_rank(pool, queries, k=4), n=4)
    return assemble_prompts(queries, demos, pool, CFG, "baseline", n=4)


@register("prompt_feedback", S.with_bm25(
    "," + S.quota_sql(4, 2) + S.prompt_sql(
        "sel AS (SELECT query_id, pos, cand_id FROM quota)", "feedback")))
def prompt_feedback(spark, sf):
    pool, queries = tables.pool(spark, sf), tables.queries(spark, sf)
    return assemble_prompts(queries, _bm25_quota(spark, sf, 4, 2), pool, CFG, "feedback", n=4)


# A user template (a function of the task config returning a Column).
USER_TEMPLATE = "Review: {sentence}\nAnswer with one word.\n"


def _user_template_sql(alias: str) -> str:
    return (f"'Review: ' || coalesce({alias}.sentence, 'nan') || chr(10) || "
            "'Answer with one word.' || chr(10)")


@register("prompt_user_template", S.with_bm25(S.prompt_sql(
    "sel AS (SELECT query_id, rank AS pos, cand_id FROM bm25 WHERE rank <= 4)",
    "baseline", _user_template_sql)))
def prompt_user_template(spark, sf):
    """Baseline prompts laid out with a caller's template (no UDF)."""
    from shotsmith.functions.templates import format_columns
    pool, queries = tables.pool(spark, sf), tables.queries(spark, sf)
    demos = select_top_n(bm25_op.bm25_rank(pool, queries, k=4), n=4)
    return assemble_prompts(queries, demos, pool, CFG, "baseline", n=4,
                            template=lambda cfg: format_columns(USER_TEMPLATE))


# ---------------------------------------------------------------- sampling

from shotsmith.operators.sampling import (  # noqa: E402
    random_neighbours, random_rankings, stratified_pool)
from shotsmith.operators.scoring import decode_label  # noqa: E402
from shotsmith.operators.select import limit_pool, restrict_rankings  # noqa: E402
from shotsmith.plans import jobs  # noqa: E402

POOL_CTE = f"WITH pool AS ({tables.SQL_POOL}), q AS ({tables.SQL_QUERIES}),"


@register("pool_stratified", f"""
WITH c AS (SELECT doc_id AS cand_id, lang AS label FROM documents),
r AS (SELECT cand_id, label,
             row_number() OVER (PARTITION BY label ORDER BY {S.seeded(75, 'cand_id')}, cand_id) AS rn,
             dense_rank() OVER (ORDER BY label) - 1 AS li,
             (SELECT 300 // count(DISTINCT label) FROM c) AS quota
      FROM c)
SELECT cand_id, label, CAST(li * quota + rn - 1 AS BIGINT) AS pool_id FROM r WHERE rn <= quota""")
def pool_stratified(spark, sf):
    return stratified_pool(tables.corpus(spark, sf).select("cand_id", "label"),
                           pool_size=300, seed=75)


@register("random_rankings", POOL_CTE + S.draws_sql(
    "q", "query_id", "(SELECT count(*) FROM pool)", 300, 123, False).lstrip() + """
SELECT query_id, draw_rank AS rank, cand_id FROM drawn
WHERE draw_rank <= least(300, (SELECT count(*) FROM pool))""")
def q_random_rankings(spark, sf):
    return random_rankings(tables.queries(spark, sf), tables.pool(spark, sf), m=300, seed=123)


NEIGHBOURS_SQL = S.draws_sql(
    "(SELECT cand_id AS query_id FROM pool)", "query_id", "(SELECT count(*) FROM pool)",
    4, 123, True).lstrip()


@register("random_neighbours", POOL_CTE + NEIGHBOURS_SQL + """
SELECT query_id, draw_rank AS pos, cand_id FROM drawn WHERE draw_rank <= 4""")
def q_random_neighbours(spark, sf):
    return random_neighbours(tables.pool(spark, sf), k=4, seed=123)


# ---------------------------------------------------------------- pool trim

@register("pool_prefix", f"""
WITH pool AS ({tables.SQL_POOL})
SELECT cand_id, label FROM (
  SELECT cand_id, label, row_number() OVER (ORDER BY cand_id) AS rn FROM pool)
WHERE rn <= 300""")
def pool_prefix(spark, sf):
    return limit_pool(tables.pool(spark, sf), 300).select("cand_id", "label")


@register("ranking_restricted", S.with_bm25(""",
prefix AS (SELECT cand_id FROM (SELECT cand_id, row_number() OVER (ORDER BY cand_id) AS rn
                                FROM pool) WHERE rn <= 300)
SELECT query_id,
       CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INTEGER) AS rank,
       cand_id
FROM bm25 WHERE cand_id IN (SELECT cand_id FROM prefix)"""))
def ranking_restricted(spark, sf):
    """Candidates are restricted before any pair is made; statistics are
    those of the whole pool."""
    pool = tables.pool(spark, sf)
    among = limit_pool(pool, 300).select("cand_id")
    return bm25_op.BM25Index(pool).rank(tables.queries(spark, sf), among=among).select(
        "query_id", "rank", "cand_id")


# ---------------------------------------------------------------- labels

@register("correctness_split", f"""
WITH pool AS ({tables.SQL_POOL})
SELECT label, label = prediction AS is_correct, count(*) AS n FROM pool GROUP BY ALL""")
def correctness_split(spark, sf):
    from shotsmith.functions.labels import is_correct
    return (tables.pool(spark, sf)
            .groupBy("label", is_correct("label", "prediction").alias("is_correct"))
            .agg(F.count(F.lit(1)).alias("n")))


def model_predictions(spark, sf) -> DataFrame:
    """(model, cand_id, prediction) for two models, derived from ``labels``:
    'a' is the pool's stand-in rule, 'b' copies the label of non-toxic rows
    and never scored the toxic ones."""
    lab = tables.table(spark, sf, "labels")
    a = lab.select(F.lit("a").alias("model"), F.col("doc_id").alias("cand_id"),
                   F.when(F.col("toxic") == 1, F.lit(CFG.labels[0]))
                    .otherwise(F.lit(CFG.labels[1])).alias("prediction"))
    b = lab.where(F.col("toxic") == 0).select(
        F.lit("b").alias("model"), F.col("doc_id").alias("cand_id"),
        tables.label_of("quality").alias("prediction"))
    return a.unionByName(b)


@register("pool_model_predictions", f"""
WITH pool AS ({tables.SQL_POOL}),
pr AS (SELECT doc_id AS cand_id,
              CASE quality WHEN 0 THEN 'negative' WHEN 1 THEN 'positive' END AS prediction
       FROM labels WHERE toxic = 0)
SELECT p.cand_id, coalesce(p.label, 'nan') AS label,
       coalesce(pr.prediction, 'nan') AS prediction,
       coalesce(p.label, 'nan') = coalesce(pr.prediction, 'nan') AS is_correct
FROM pool p LEFT JOIN pr ON pr.cand_id = p.cand_id""")
def pool_model_predictions(spark, sf):
    """The pool with one model's prior predictions (unscored -> 'nan')."""
    from shotsmith.functions.labels import is_correct
    from shotsmith.sources.labelled import with_model_predictions
    pool = with_model_predictions(tables.pool(spark, sf), model_predictions(spark, sf), "b")
    return pool.select("cand_id", F.coalesce(F.col("label"), F.lit("nan")).alias("label"),
                       "prediction", is_correct("label", "prediction").alias("is_correct"))


PRIOR_PROMPTS_SQL = POOL_CTE + NEIGHBOURS_SQL + S.prompt_sql(
    "sel AS (SELECT query_id, draw_rank AS pos, cand_id FROM drawn WHERE draw_rank <= 4)",
    "prior").replace("FROM q LEFT JOIN demo d",
                     "FROM (SELECT cand_id AS query_id, sentence, label FROM pool) q "
                     "LEFT JOIN demo d")

PRIOR_RESULTS_SQL = f"""
WITH pr AS ({PRIOR_PROMPTS_SQL}),
sc AS (SELECT query_id, prompt, label, {S.vote_sql('prompt', CFG.labels)} AS scores FROM pr)
SELECT CAST(query_id AS VARCHAR) AS id, prompt AS input_all_tokens, label,
       {S.decode_sql('scores', CFG.labels, 'query_id')} AS outputs
FROM sc"""


@register("prompt_prior", PRIOR_PROMPTS_SQL)
def prompt_prior(spark, sf):
    return jobs.prior_prompts(tables.pool(spark, sf), CFG, k=4, seed=123)


@register("prior_predict_vote", PRIOR_RESULTS_SQL)
def prior_predict_vote(spark, sf):
    return jobs.prior_predict(tables.pool(spark, sf), CFG, k=4, seed=123)


@register("output_counts", f"""
WITH r AS ({PRIOR_RESULTS_SQL})
SELECT outputs, count(*) AS n FROM r GROUP BY outputs""")
def output_counts(spark, sf):
    return jobs.output_counts(jobs.prior_predict(tables.pool(spark, sf), CFG, k=4, seed=123))


@register("writeback_mismatches", f"""
WITH r AS ({PRIOR_RESULTS_SQL}), pool AS ({tables.SQL_POOL})
SELECT count(*) AS n_rows,
       CAST(sum(CASE WHEN r.label IS NOT DISTINCT FROM pool.label THEN 0 ELSE 1 END) AS BIGINT)
         AS mismatches,
       CAST(sum(CASE WHEN r.outputs = pool.label THEN 1 ELSE 0 END) AS BIGINT) AS n_correct
FROM pool LEFT JOIN r ON CAST(r.id AS BIGINT) = pool.cand_id""")
def writeback_mismatches(spark, sf):
    pool = tables.pool(spark, sf)
    res = jobs.prior_predict(pool, CFG, k=4, seed=123)
    out, mismatches = jobs.write_back(pool, res)
    return out.agg(F.count(F.lit(1)).alias("n_rows"),
                   F.lit(mismatches).cast("bigint").alias("mismatches"),
                   F.sum(F.when(F.col("prediction") == F.col("label"), 1).otherwise(0))
                   .cast("bigint").alias("n_correct"))


# ---------------------------------------------------------------- scoring + decode (M7/M8)

def _results_sql(prompts_sql: str) -> str:
    return f"""
WITH pr AS ({prompts_sql}),
sc AS (SELECT query_id, prompt, label, {S.vote_sql('prompt', CFG.labels)} AS scores FROM pr)
SELECT CAST(query_id AS VARCHAR) AS id, prompt AS input_all_tokens, label,
       {S.decode_sql('scores', CFG.labels, 'query_id')} AS outputs
FROM sc"""


@register("feedback_infer_vote", _results_sql(ORACLE["prompt_feedback"]))
def feedback_infer_vote(spark, sf):
    return jobs.run_with_feedback(tables.queries(spark, sf), tables.pool(spark, sf), CFG,
                                  n=4, wrong=2)


@register("baseline_infer_vote", _results_sql(ORACLE["prompt_baseline"]))
def baseline_infer_vote(spark, sf):
    pool, queries = tables.pool(spark, sf), tables.queries(spark, sf)
    return jobs.run_baseline(queries, pool, bm25_op.bm25_rank(pool, queries, k=4), CFG, n=4)


EMO = ("others", "happy", "sad", "angry")   # has the 'others' fallback


def _part_sums(parts: int) -> list:
    """Sums of floor(256 x) over consecutive parts of the whole vector: exact
    integers, so that scores and their ties are the same in any engine."""
    n = F.size("embedding")
    width = F.floor(n / parts).cast("int")
    whole = F.transform("embedding", lambda x: F.floor(256 * x.cast("double")))
    cuts = [(F.lit(i) * width + 1, n - i * width if i == parts - 1 else width)
            for i in range(parts)]
    return [F.aggregate(F.slice(whole, at, size), F.lit(0).cast("bigint"), lambda x, y: x + y)
            .cast("double") for at, size in cuts]


def _part_sums_sql(parts: int) -> list[str]:
    width = f"(len(embedding) // {parts})"
    ends = [f"{i + 1} * {width}" for i in range(parts - 1)] + ["len(embedding)"]
    return [f"list_sum([floor(256 * CAST(x AS DOUBLE)) for x in "
            f"embedding[1 + {i} * {width}:{end}]])" for i, end in enumerate(ends)]


@register("decode_label", f"""
SELECT vec_id, {S.decode_sql('s', EMO, 'vec_id')} AS decoded
FROM (SELECT vec_id, [{", ".join(_part_sums_sql(4))}] AS s FROM embeddings)""")
def q_decode_label(spark, sf):
    v = tables.vectors(spark, sf)
    return v.select("vec_id", decode_label(F.array(*_part_sums(4)), EMO, "vec_id")
                    .alias("decoded"))


@register("decode_fallback", f"""
SELECT vec_id, {S.decode_sql('s', CFG.labels, 'vec_id')} AS decoded
FROM (SELECT vec_id, [{", ".join(f"floor({x} / 128)" for x in _part_sums_sql(2))}] AS s
      FROM embeddings)""")
def q_decode_fallback(spark, sf):
    """M7 fallback without 'others': coarse half sums tie often."""
    v = tables.vectors(spark, sf)
    s = F.array(*[F.floor(x / 128).cast("double") for x in _part_sums(2)])
    return v.select("vec_id", decode_label(s, CFG.labels, "vec_id").alias("decoded"))


# ---------------------------------------------------------------- pandas scorer hook (M8)

@register("feedback_infer_pandas", ORACLE["feedback_infer_vote"])
def feedback_infer_pandas(spark, sf):
    from shotsmith.operators.scoring import pandas_vote_scorer
    return jobs.run_with_feedback(tables.queries(spark, sf), tables.pool(spark, sf), CFG,
                                  n=4, wrong=2, scorer=pandas_vote_scorer(CFG.labels),
                                  kind="pandas")


@register("label_quota", """
SELECT count(DISTINCT lang) AS n_labels, 300 // count(DISTINCT lang) AS quota
FROM documents""")
def q_label_quota(spark, sf):
    c = tables.corpus(spark, sf)
    from shotsmith.operators.sampling import label_quota
    return c.agg(F.countDistinct("label").cast("bigint").alias("n_labels")).withColumn(
        "quota", F.lit(label_quota(c, 300)).cast("bigint"))


# ---------------------------------------------------------------- vectors

from shotsmith.functions.vectors import l2_norm  # noqa: E402
from shotsmith.operators.cosine import cosine_rank  # noqa: E402
from shotsmith.operators.pooling import masked_mean_pool  # noqa: E402

VEC_SQL = """
v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
vn AS (SELECT vec_id, label, e, greatest(sqrt(list_dot_product(e, e)), 1e-12) AS nrm FROM v)"""


@register("cosine_top5", "WITH" + VEC_SQL + """,
s AS (SELECT a.vec_id AS query_id, b.vec_id AS cand_id,
             round(list_dot_product(a.e, b.e) / (a.nrm * b.nrm), 6) AS score
      FROM vn a JOIN vn b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, cand_id) AS rk
      FROM s)
SELECT query_id, CAST(rk AS INTEGER) AS rank, cand_id, score FROM r WHERE rk <= 5""")
def cosine_top5(spark, sf):
    v = tables.vectors(spark, sf)
    return cosine_rank(v, v, k=5, exclude_self=True, q_id="vec_id", p_id="vec_id")


@register("cosine_pruned_top5", ORACLE["cosine_top5"])
def cosine_pruned_top5(spark, sf):
    from shotsmith.operators.pruned import pruned_cosine_rank
    v = tables.vectors(spark, sf)
    return pruned_cosine_rank(v, v, k=5, exclude_self=True, q_id="vec_id", p_id="vec_id")[0]


@register("cosine_lsh_recall", None)
def cosine_lsh_recall(spark, sf):
    from shotsmith.operators.lsh import cosine_lsh, recall
    v = tables.vectors(spark, sf)
    found = cosine_lsh(v, v, k=5, exclude_self=True, q_id="vec_id", p_id="vec_id")
    return recall(found, cosine_top5(spark, sf))


@register("l2_norms", "WITH" + VEC_SQL + """
SELECT vec_id, round(sqrt(list_dot_product(e, e)), 9) AS norm FROM v""")
def l2_norms(spark, sf):
    return tables.vectors(spark, sf).select("vec_id", F.round(l2_norm("embedding"), 9)
                                            .alias("norm"))


@register("mean_pool_masked", """
SELECT label, CAST(i - 1 AS INTEGER) AS dim,
       round(sum(CAST(embedding[i] AS DOUBLE) * m) / greatest(sum(m), 1e-9), 9) AS value
FROM (SELECT label, embedding,
             CASE WHEN embedding[1] >= 0 THEN 1.0 ELSE 0.0 END AS m,
             unnest(range(1, len(embedding) + 1)) AS i
      FROM embeddings)
GROUP BY label, i""")
def mean_pool_masked(spark, sf):
    v = tables.vectors(spark, sf)
    mask = F.when(F.element_at("embedding", 1) >= 0, 1.0).otherwise(0.0)
    return masked_mean_pool(v, "label", "embedding", mask) \
        .withColumn("value", F.round("value", 9))


# ---------------------------------------------------------------- clusters

from shotsmith.operators.clusters import interleave_clusters, kmeans_rankings  # noqa: E402


@register("cluster_interleave", f"""
WITH pool AS (SELECT vec_id AS cand_id, label % 4 AS cluster FROM embeddings),
pp AS (SELECT cand_id, cluster,
              row_number() OVER (PARTITION BY cluster ORDER BY cand_id) - 1 AS pos FROM pool),
sz AS (SELECT cluster, count(*) AS n FROM pool GROUP BY cluster),
shape AS ({S.sql_grid("SELECT DISTINCT n FROM sz")}),
rws AS (SELECT item_id AS query_id, c.cluster FROM benchmark,
        (SELECT unnest(range(0, 4)) AS cluster) c),
draws AS (SELECT r.query_id, r.cluster, t.i,
                 {S.sql_permuted('t.i', 'shape.n', 'shape.a', 'shape.b', 123, 'r.query_id', 'r.cluster')} AS pos
          FROM rws r JOIN sz ON sz.cluster = r.cluster JOIN shape ON shape.n = sz.n, range(0, 30) t(i))
SELECT d.query_id, CAST(d.i * 4 + d.cluster + 1 AS INTEGER) AS rank, pp.cand_id
FROM draws d JOIN pp ON pp.cluster = d.cluster AND pp.pos = d.pos""")
def cluster_interleave(spark, sf):
    v = tables.vectors(spark, sf)
    assigned = v.select(F.col("vec_id").alias("cand_id"),
                        F.pmod(F.col("label"), F.lit(4)).alias("cluster"))
    q = tables.queries(spark, sf)
    return interleave_clusters(q, assigned, k=4, take=30, seed=123)


@register("kmeans_rankings")
def q_kmeans_rankings(spark, sf):
    v = tables.vectors(spark, sf).select(F.col("vec_id").alias("cand_id"), "embedding")
    return kmeans_rankings(tables.queries(spark, sf), v, k=4, take=30, min_size=30, seed=123)


# ---------------------------------------------------------------- token F1 (M4/M5)

from shotsmith.operators.bertscore import bertscore_rank, mmr_rank, token_sentences  # noqa: E402

F1_SQL = """
WITH t AS (SELECT vec_id // 3 AS sid, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
tn AS (SELECT sid, vec_id, e, greatest(sqrt(list_dot_product(e, e)), 1e-12) AS nrm FROM t),
pairs AS (SELECT a.sid AS qs, a.vec_id AS qt, b.sid AS ps, b.vec_id AS pt,
                 list_dot_product(a.e, b.e) / (a.nrm * b.nrm) AS sim
          FROM tn a JOIN tn b ON a.sid <> b.sid),
rq AS (SELECT qs, ps, avg(m) AS r
       FROM (SELECT qs, qt, ps, max(sim) AS m FROM pairs GROUP BY qs, qt, ps)
       GROUP BY qs, ps),
pq AS (SELECT qs, ps, avg(m) AS p
       FROM (SELECT qs, ps, pt, max(sim) AS m FROM pairs GROUP BY qs, ps, pt)
       GROUP BY qs, ps),
f AS (SELECT rq.qs AS query_id, rq.ps AS cand_id,
             round(CASE WHEN p + r <> 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1
      FROM rq JOIN pq ON rq.qs = pq.qs AND rq.ps = pq.ps),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY f1 DESC, cand_id) AS rank
       FROM f)
"""


def _sentences(spark, sf, id_name):
    v = tables.vectors(spark, sf)
    return token_sentences(v.withColumn("sid", F.floor(F.col("vec_id") / 3).cast("bigint")),
                           "sid", "vec_id", "embedding", id_name)


@register("bertscore_rank", F1_SQL + """
SELECT query_id, CAST(rank AS INTEGER) AS rank, cand_id, f1 FROM rk WHERE rank <= 5""")
def q_bertscore_rank(spark, sf):
    return bertscore_rank(_sentences(spark, sf, "query_id"), _sentences(spark, sf, "cand_id"),
                          k=5, exclude_self=True)


@register("mmr_rank", F1_SQL + """
SELECT query_id, CAST(rank AS INTEGER) AS rank, cand_id FROM rk WHERE rank <= 10""")
def q_mmr_rank(spark, sf):
    return mmr_rank(_sentences(spark, sf, "query_id"), _sentences(spark, sf, "cand_id"),
                    k=10, exclude_self=True)


# ---------------------------------------------------------------- ranking JSON

@register("rankings_json_roundtrip", S.with_bm25(
    "SELECT query_id, rank, cand_id FROM bm25 WHERE rank <= 20"))
def rankings_json_roundtrip(spark, sf):
    from shotsmith.sources.rankings import rankings_from_json, rankings_to_json
    ranking = bm25_op.bm25_rank(tables.pool(spark, sf), tables.queries(spark, sf), k=20)
    return rankings_from_json(rankings_to_json(ranking))


# ---------------------------------------------------------------- encoder hook (M3)

def _hash_vec_sql(src: str, id_col: str, name: str) -> str:
    return f"""
{name}_t AS (SELECT {id_col} AS id, md5(tok) AS m
             FROM (SELECT {id_col}, unnest(string_split(coalesce(sentence, 'nan'), ' ')) AS tok
                   FROM {src})),
{name}_b AS (SELECT id, CAST(('0x' || substr(m, 1, 8)) AS BIGINT) % 64 AS bucket,
                    CASE WHEN CAST(('0x' || substr(m, 9, 1)) AS BIGINT) % 2 = 0
                         THEN 1.0 ELSE -1.0 END AS sg FROM {name}_t),
{name}_v AS (SELECT id, bucket, CAST(sum(sg) AS DOUBLE) AS val FROM {name}_b GROUP BY id, bucket),
{name}_n AS (SELECT id, greatest(sqrt(sum(val * val)), 1e-12) AS nrm FROM {name}_v GROUP BY id)"""


SBERT_SQL = (f"WITH pool AS ({tables.SQL_POOL}), q AS ({tables.SQL_QUERIES}),"
             + _hash_vec_sql("q", "query_id", "qv") + ","
             + _hash_vec_sql("pool", "cand_id", "pv") + """,
dots AS (SELECT a.id AS query_id, b.id AS cand_id, sum(a.val * b.val) AS d
         FROM qv_v a JOIN pv_v b ON a.bucket = b.bucket GROUP BY a.id, b.id),
s AS (SELECT q.query_id, p.cand_id,
             round(coalesce(d.d, 0) / (qn.nrm * pn.nrm), 6) AS score
      FROM q CROSS JOIN pool p
      JOIN qv_n qn ON qn.id = q.query_id JOIN pv_n pn ON pn.id = p.cand_id
      LEFT JOIN dots d ON d.query_id = q.query_id AND d.cand_id = p.cand_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, cand_id) AS rk
      FROM s)
SELECT query_id, CAST(rk AS INTEGER) AS rank, cand_id, score FROM r WHERE rk <= 5""")


@register("sbert_hashing_top5", SBERT_SQL)
def sbert_hashing_top5(spark, sf):
    from shotsmith.operators.embed import HashingEncoder
    return jobs.retrieve("sbert", tables.pool(spark, sf), tables.queries(spark, sf), k=5,
                         encoder=HashingEncoder(64), dtype="double")


@register("sbert_pooled_top5", SBERT_SQL)
def sbert_pooled_top5(spark, sf):
    """M3 -> A5 -> M2: token vectors pooled where they are made (the mean of the
    hashing tokens points where the hashing sentence vector does)."""
    from shotsmith.operators.embed import HashingTokenEncoder, PooledEncoder
    return jobs.retrieve("sbert", tables.pool(spark, sf), tables.queries(spark, sf), k=5,
                         encoder=PooledEncoder(HashingTokenEncoder(64)), dtype="double")


@register("decode_others_ties", f"""
SELECT vec_id, {S.decode_sql('s', EMO, 'vec_id')} AS decoded
FROM (SELECT vec_id, [{", ".join(f"floor({x} / 256) + 2" for x in _part_sums_sql(4))}] AS s
      FROM embeddings)""")
def q_decode_others_ties(spark, sf):
    """M7 fallback with 'others': coarse quarter sums tie often, at 1.0 and 2.0."""
    v = tables.vectors(spark, sf)
    s = F.array(*[(F.floor(x / 256) + 2).cast("double") for x in _part_sums(4)])
    return v.select("vec_id", decode_label(s, EMO, "vec_id").alias("decoded"))


# ---------------------------------------------------------------- template families (P5)

def _family_prompts(spark, sf, dataset: str, **derived) -> DataFrame:
    pool = tables.pool(spark, sf).withColumns(derived)
    queries = tables.queries(spark, sf).withColumns(derived)
    demos = select_top_n(bm25_op.bm25_rank(pool, queries, k=4), n=4)
    return assemble_prompts(queries, demos, pool, task_config(dataset), "baseline", n=4)


def _family_sql(dataset: str, text: str) -> str:
    """Oracle with the family's template typed out; {s} is the row's sentence."""
    return S.with_bm25(S.prompt_sql(
        "sel AS (SELECT query_id, rank AS pos, cand_id FROM bm25 WHERE rank <= 4)", "baseline",
        lambda alias: text.format(s=f"coalesce({alias}.sentence, 'nan')"), task_config(dataset)))


@register("prompt_aspect", _family_sql(
    "rest", "'Sentence: ' || {s} || ' What is the sentiment polarity of the aspect ' || "
            "string_split({s}, ' ')[1] || ' ?' || chr(10)"))
def prompt_aspect(spark, sf):
    """P5, aspect family: the aspect is the text's first token."""
    return _family_prompts(spark, sf, "rest", aspect=F.get(F.split("sentence", " "), F.lit(0)))


@register("prompt_stance", _family_sql(
    "pstance", "'Sentence: ' || {s} || ' What is the attitude of sentence toward target ' || "
               "string_split({s}, ' ')[-1] || ' ?' || chr(10)"))
def prompt_stance(spark, sf):
    """P5, stance family: the target is the text's last token."""
    return _family_prompts(spark, sf, "pstance",
                           target=F.element_at(F.split("sentence", " "), -1))


@register("prompt_pair", _family_sql(
    "mnli", "'Premise: ' || left({s}, length({s}) // 2) || chr(10) || "
            "'Hypothesis: ' || substr({s}, length({s}) // 2 + 1) || chr(10)"))
def prompt_pair(spark, sf):
    """P5, pair family: the two halves of the text."""
    text = "coalesce(sentence, 'nan')"
    return _family_prompts(
        spark, sf, "mnli",
        text1=F.expr(f"left({text}, cast(floor(length({text}) / 2) as int))"),
        text2=F.expr(f"substr({text}, cast(floor(length({text}) / 2) as int) + 1)"))


# ---------------------------------------------------------------- retrieval job (C3), M6

@register("retrieve_random", POOL_CTE + S.draws_sql(
    "q", "query_id", "(SELECT count(*) FROM pool)", 20, 123, False).lstrip() + """
SELECT query_id, draw_rank AS rank, cand_id FROM drawn WHERE draw_rank <= 20""")
def retrieve_random(spark, sf):
    return jobs.retrieve("random_each", tables.pool(spark, sf), tables.queries(spark, sf), k=20)


@register("kmeans_invariants", """
SELECT item_id AS query_id, CAST(120 AS BIGINT) AS n_ranks, CAST(120 AS BIGINT) AS n_ids,
       1 AS first_rank, 120 AS last_rank, CAST(0 AS BIGINT) AS n_moved
FROM benchmark""")
def kmeans_invariants(spark, sf):
    """M6: each query ranks 120 distinct ids without gaps, and an id keeps its
    cluster's place in the rounds of four in every query (``n_moved`` = 0)."""
    r = q_kmeans_rankings(spark, sf)
    slots = r.groupBy("cand_id").agg(F.count_distinct(F.col("rank") % 4).alias("_slots"))
    return r.join(slots, "cand_id").groupBy("query_id").agg(
        F.count_distinct("rank").alias("n_ranks"), F.count_distinct("cand_id").alias("n_ids"),
        F.min("rank").alias("first_rank"), F.max("rank").alias("last_rank"),
        F.sum(F.when(F.col("_slots") > 1, 1).otherwise(0)).cast("bigint").alias("n_moved"))


@register("reorder_vectors", """
SELECT vec_id, array_to_string([CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)
                                for x in list_reverse(embedding)], ',') AS reversed
FROM embeddings""")
def reorder_vectors(spark, sf):
    """every vector in the order n-1 .. 0, its components as integers."""
    from shotsmith.functions.arrays import reorder
    order = F.sequence(F.size("embedding") - 1, F.lit(0))
    whole = F.transform(reorder("embedding", order),
                        lambda x: F.floor(256 * x.cast("double")).cast("string"))
    return tables.vectors(spark, sf).select("vec_id", F.array_join(whole, ",").alias("reversed"))


# ---------------------------------------------------------------- files

def _folder(spark, name: str) -> str:
    """A new folder of this session's intermediates."""
    import uuid

    from shotsmith.session import checkpoint_dir
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@register("labelled_csv_pool", f"""
WITH pool AS ({tables.SQL_POOL}),
r AS (SELECT row_number() OVER (ORDER BY cand_id) - 1 AS cand_id, cand_id AS doc_id, sentence, label, prediction
      FROM pool)
SELECT cand_id, doc_id, sentence, label, prediction, label = prediction AS is_correct
FROM r WHERE cand_id < 300""")
def labelled_csv_pool(spark, sf):
    """S1 + P1: the pool written as several CSV files in id order and read back;
    positional ids follow the files, and the first 300 are 0..299."""
    from shotsmith.functions.labels import is_correct
    from shotsmith.sources.labelled import read_labelled
    path = _folder(spark, "pool-csv")
    pool = tables.pool(spark, sf).withColumnRenamed("cand_id", "doc_id")
    (pool.repartitionByRange(4, "doc_id").sortWithinPartitions("doc_id").write.option("header", True)
     .option("escape", '"').option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))
    read = read_labelled(spark, path, multi_line=True)
    return limit_pool(read, 300, positional=True).select(
        "cand_id", F.col("doc_id").cast("bigint").alias("doc_id"), "sentence", "label", "prediction",
        is_correct("label", "prediction").alias("is_correct"))


def _top20(spark, sf):
    return jobs.retrieve("bm25", tables.pool(spark, sf), tables.queries(spark, sf), k=20)


@register("rankings_parquet_file", S.with_bm25(
    "SELECT query_id, rank, cand_id, 'bm25' AS mode FROM bm25 WHERE rank <= 20"))
def rankings_parquet_file(spark, sf):
    """C3 bm25 -> S3 -> S4: two runs in one folder, one of them read back."""
    from shotsmith.sources.rankings import read_rankings, write_rankings
    path = _folder(spark, "rankings")
    ranking = _top20(spark, sf).select("query_id", "rank", "cand_id")
    write_rankings(ranking.where("rank <= 3").withColumn("mode", F.lit("other")), path, ["mode"])
    write_rankings(ranking.withColumn("mode", F.lit("bm25")), path, ["mode"])
    return read_rankings(spark, path, mode="bm25")


@register("rankings_json_file", S.with_bm25(
    "SELECT query_id, rank, cand_id FROM bm25 WHERE rank <= 20"))
def rankings_json_file(spark, sf):
    """C3 bm25 -> S3 -> S4 through JSON Lines files."""
    from shotsmith.sources.rankings import read_rankings_json, write_rankings_json
    path = _folder(spark, "rankings-json")
    write_rankings_json(_top20(spark, sf).select("query_id", "rank", "cand_id"), path)
    return read_rankings_json(spark, path)


RESULT_FILE_SQL = f"""
SELECT id, input_all_tokens, label, outputs, 'baseline' AS method, 'sst2' AS dataset
FROM ({ORACLE["baseline_infer_vote"]})"""


def _result_file(spark, sf, fmt: str):
    from shotsmith.sources.results import write_results
    path = _folder(spark, f"results-{fmt}")
    results = baseline_infer_vote(spark, sf)
    write_results(results, path, fmt, method="baseline", dataset="sst2")
    read = spark.read.option("header", True).option("escape", '"').option("multiLine", True)
    read = read.csv(path) if fmt == "csv" else read.parquet(path)
    return read.select("id", "input_all_tokens", "label", "outputs", "method", "dataset")


@register("results_csv_file", RESULT_FILE_SQL)
def results_csv_file(spark, sf):
    """S5 as CSV: prompts with line breaks, quotes and end spaces come back whole."""
    return _result_file(spark, sf, "csv")


@register("results_parquet_file", RESULT_FILE_SQL)
def results_parquet_file(spark, sf):
    """S5 as parquet, partitioned by run keys."""
    return _result_file(spark, sf, "parquet")
