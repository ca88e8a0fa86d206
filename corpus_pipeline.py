"""A training corpus from raw documents, in five stages.

Each stage is a function (spark, docs, sf_dir) -> DataFrame; its result is
written as Parquet and read again as the next one's ``docs``.  All but the last
return the columns of ``documents``; ``n_chars`` follows the text.

Null text counts as empty.  Rows without a document id pass the line and
near-duplicate stages unchanged and are packed like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotsmith.llm import jaccard, linededup, packing, quality, secretscan
from shotsmith.llm.common import read, write_once

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
LEAST_QUALITY = 0.7


def _as_documents(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("bigint")).select(*COLUMNS)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is below the threshold go."""
    model = quality.fit(docs, read(spark, sf_dir, "labels"))
    return quality.classify(docs, model, "_score").where(F.col("_score") >= LEAST_QUALITY).select(*COLUMNS)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in an earlier document go; the documents stay."""
    return _as_documents(linededup.drop_lines(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return jaccard.keep_one(docs).select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; the documents stay."""
    return _as_documents(secretscan.mask(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces packed into sequences (one row per piece)."""
    import public_tokenizers
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality_filter),
    ("line_dedup", repeated_lines),
    ("ngram_jaccard_join", near_duplicates),
    ("secret_scans", secrets),
    ("best_fit_packing", pack),
]

#: No SQL states the learned classifier or the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = write_once(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
