"""Labelled text tables (pool and queries).

Rows carry an explicit id: Spark rows have no order, so the position the
original CSV gave each row becomes a BIGINT column at ingest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shotsmith.functions.labels import normalise_labels
from shotsmith.session import BROADCAST_ROW_LIMIT

# --- fixed values: texts a pandas CSV read treats as missing (its default
# na_values); the original pipeline then renders such a cell as "nan" ---
PANDAS_NA = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
             "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
             "nan", "null"]
# --- end of fixed values ---

# Columns a labelled CSV may hold.  All are read as text; label_id (which no
# step uses) becomes INT with try_cast, so an odd value cannot fail a read.
LABELLED_COLUMNS = ["sentence", "label_id", "label", "prediction", "zeropred"]


def read_labelled(spark: SparkSession, path: str, id_col: str = "cand_id",
                  fmt: str = "csv", schema: T.StructType | None = None,
                  multi_line: bool = False) -> DataFrame:
    """Read a pool or query table and give every row its file position as id.

    CSV: header line, quotes doubled inside quoted fields (``escape='"'``).
    ``multi_line`` reads quoted newlines (a file is then one task).
    The header decides which columns exist; every column is text (no
    inference pass) and pandas' missing-value texts read as missing.
    """
    if fmt == "parquet":
        df = spark.read.parquet(path)
    else:
        header = spark.read.option("header", True).option("escape", '"') \
            .option("inferSchema", False).option("multiLine", multi_line).csv(path).columns
        fields = [T.StructField(c, T.StringType(), True) for c in header]
        df = (spark.read.schema(schema or T.StructType(fields))
              .option("header", True).option("escape", '"')
              .option("mode", "FAILFAST").option("multiLine", multi_line).csv(path))
        na = F.array(*[F.lit(x) for x in PANDAS_NA])
        df = df.select(*[F.when(F.array_contains(na, F.col(c)), F.lit(None))
                          .otherwise(F.col(c)).alias(c) for c in df.columns])
        if "label_id" in df.columns:
            df = df.withColumn("label_id", F.col("label_id").try_cast("int"))
    if id_col not in df.columns:
        df = with_row_ids(df, id_col)
    return normalise_labels(df)


def with_row_ids(df: DataFrame, id_col: str) -> DataFrame:
    """Positional ids 0..N-1 of a file read, computed on the JVM: files by path,
    then the rows of a file from its start.  Spark packs splits into partitions
    by size, so each split is numbered on its own."""
    tagged = df.select("*", F.col("_metadata.file_path").alias("_file"),
                       F.col("_metadata.file_block_start").alias("_block"),
                       F.monotonically_increasing_id().alias("_mid"))
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (tagged.groupBy("_file", "_block")
               .agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
               .withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
               .select("_file", "_block", "_first", "_off"))
    # a split is the last of its file, or as large as a partition may be
    if len(df.inputFiles()) + df.rdd.getNumPartitions() <= BROADCAST_ROW_LIMIT:
        offsets = F.broadcast(offsets)
    return (tagged.join(offsets, ["_file", "_block"])
            .withColumn(id_col, (F.col("_off") + F.col("_mid") - F.col("_first")).cast("bigint"))
            .drop("_file", "_block", "_mid", "_first", "_off"))


def with_model_predictions(pool: DataFrame, predictions: DataFrame, model: str) -> DataFrame:
    """The pool with the prior predictions one model made.

    Predictions live in their own table ``(model, cand_id, prediction)`` rather
    than in a per-model copy of the pool file; rows the model never scored
    read ``'nan'`` (and so count as wrong).
    """
    preds = (predictions.where(F.col("model") == F.lit(model))
             .select("cand_id", F.col("prediction").alias("_pred")))
    out = pool.drop("prediction").join(preds, "cand_id", "left") \
        .withColumnRenamed("_pred", "prediction")
    return normalise_labels(out, ("prediction",))
