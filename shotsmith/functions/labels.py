"""Label columns: P3 normalisation and P4 correctness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from shotsmith.functions.text import as_text


def normalise_labels(df: DataFrame, cols=("label", "prediction")) -> DataFrame:
    """Cast to text; a missing value becomes ``'nan'`` (so it is wrong)."""
    for c in cols:
        if c in df.columns:
            df = df.withColumn(c, as_text(c))
    return df


def is_correct(label: str = "label", prediction: str = "prediction") -> Column:
    """The prior prediction equals the label (after P3)."""
    return as_text(label) == as_text(prediction)
