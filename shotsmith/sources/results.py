"""Result tables to storage, keyed by run parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN_KEYS = ("model", "task", "dataset", "train_idx", "mode", "n_examples", "method")


def write_results(results: DataFrame, path: str, fmt: str = "parquet",
                  mode: str = "overwrite", **run) -> None:
    """Write (id, input_all_tokens, label, outputs) with run parameters as
    partition columns; CSV writes a header and quotes like the original and keeps
    the spaces at a prompt's ends.  Writing a run again replaces that run's
    partition and leaves the others."""
    unknown = set(run) - set(RUN_KEYS)
    if unknown:
        raise ValueError(f"unknown run keys {sorted(unknown)}")
    df = results
    keys = [k for k in RUN_KEYS if k in run]
    for k in keys:
        df = df.withColumn(k, F.lit(str(run[k])))
    w = df.write.mode(mode).option("partitionOverwriteMode", "dynamic")
    if keys:
        w = w.partitionBy(*keys)
    if fmt == "csv":
        (w.option("header", True).option("escape", '"')
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    else:
        w.parquet(path)
