import __spark_entry__ as E
from shared import SF0001


def test_entry_runs_with_stable_schema(spark):
    df = E.entry(spark)
    assert df.columns == ["id", "input_all_tokens", "label", "outputs"]
    got = df.collect()
    assert len(got) == spark.read.parquet(f"{SF0001}/benchmark.parquet").count()
    assert all(r["outputs"] in ("negative", "positive") for r in got)


def test_oracle_keys_are_registered_queries():
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 30


def test_prior_job_writeback_is_consistent(spark):
    from shotsmith.plans import jobs
    from shotsmith.plans.driver_queries import CFG
    from shotsmith.sources import tables
    pool = tables.pool(spark, SF0001)
    res = jobs.prior_predict(pool, CFG)
    out, mismatches = jobs.write_back(pool, res)
    assert mismatches == 0
    assert out.count() == pool.count()
    assert out.where("prediction IS NULL").count() == 0


def test_writeback_counts_label_mismatches(spark):
    from pyspark.sql import functions as F

    from shotsmith.plans import jobs
    from shotsmith.sources import tables
    pool = tables.pool(spark, SF0001)
    res = pool.select(F.col("cand_id").cast("string").alias("id"),
                      F.when(F.col("cand_id") % 5 == 0, F.lit("other"))
                       .otherwise(F.coalesce("label", F.lit("nan"))).alias("label"),
                      F.lit("positive").alias("outputs"))
    out, mismatches = jobs.write_back(pool, res)
    assert mismatches == pool.where(F.col("cand_id") % 5 == 0).count() > 0
    assert out.where("prediction = 'positive'").count() == pool.count()
