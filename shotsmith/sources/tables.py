"""The driver's parquet tables mapped onto the labelled-table model.

* pool    = documents JOIN labels: cand_id = doc_id, sentence = text,
            label = the sst2 label at position ``quality``; stand-in prior
            prediction from ``toxic`` (toxic rows predicted 'negative').
* queries = benchmark: query_id = item_id, sentence = text, no label.
* vectors = embeddings: vec_id, embedding ARRAY<FLOAT>, label INT.
* corpus  = documents (stratified pools draw from it, stratum = lang).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotsmith.functions.templates import task_config

DATASET = "sst2"  # label space and templates used for the driver tables


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table, read once per session: its schema comes from the
    file footers (a small job each time), so later calls reuse the frame."""
    path = f"{sf_dir}/{name}.parquet"
    seen = spark.__dict__.setdefault("_shotsmith_tables", {})
    if path not in seen:
        seen[path] = spark.read.parquet(path)
    return seen[path]


def label_of(quality_col: str = "quality") -> F.Column:
    labels = task_config(DATASET).labels
    return F.element_at(F.array(*[F.lit(x) for x in labels]),
                        F.col(quality_col) + 1)


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = task_config(DATASET).labels
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("cand_id"), F.col("text").alias("sentence"))
    lab = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("cand_id"),
        label_of("quality").alias("label"),
        F.when(F.col("toxic") == 1, F.lit(labels[0]))
         .otherwise(F.lit(labels[1])).alias("prediction"))
    return docs.join(lab, "cand_id")


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("sentence"),
        F.lit(None).cast("string").alias("label"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("cand_id"), F.col("text").alias("sentence"),
        F.col("lang").alias("label"))


# The same mapping as SQL (for oracles).  Tables are the driver's views.
SQL_POOL = """
SELECT d.doc_id AS cand_id, d.text AS sentence,
       CASE l.quality WHEN 0 THEN 'negative' WHEN 1 THEN 'positive' END AS label,
       CASE WHEN l.toxic = 1 THEN 'negative' ELSE 'positive' END AS prediction
FROM documents d JOIN labels l ON d.doc_id = l.doc_id
"""

SQL_QUERIES = """
SELECT item_id AS query_id, text AS sentence, CAST(NULL AS VARCHAR) AS label
FROM benchmark
"""
