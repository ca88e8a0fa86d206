"""M8 scoring hook, a built-in vote scorer, and M7 label decoding.

A scorer maps prompts to one score per label (aligned with the label
space).  Two kinds plug in:

* a column scorer ``fn(prompt_col, labels) -> Column`` -- stays in the JVM
  and in whole-stage codegen (the built-in ``vote_scorer``);
* a pandas scorer ``fn(iterator of pandas.DataFrame) -> iterator of
  pandas.DataFrame`` adding a ``scores`` column -- user model code, run by
  ``mapInPandas`` on Arrow batches (``spark.sql.execution.arrow.
  maxRecordsPerBatch`` plays the role of the batch size) and loaded once per
  task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shotsmith.functions.arrays import all_equal, argmax
from shotsmith.functions.hashing import seeded_draw
from shotsmith.functions.templates import LABEL_PREFIX
from shotsmith.functions.text import count_occurrences
from shotsmith.session import ship_package

# Fallback label for all-equal scores when the label space has it.
OTHERS = "others"


def vote_scorer(prompt: Column, labels: list[str] | tuple[str, ...]) -> Column:
    """Score of label l = number of demonstrations shown with ``Label: l``.

    Counts ``"Label: " + l + "\\n"`` in the prompt; the query's own tail
    ("Label: " at the very end) has no newline and is not counted.
    """
    return F.array(*[count_occurrences(prompt, F.lit(f"{LABEL_PREFIX}{lab}\n")).cast("double")
                     for lab in labels])


def pandas_vote_scorer(labels: list[str] | tuple[str, ...], prompt_col: str = "prompt"
                       ) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """The vote scorer as a pandas batch function (the shape of a model hook)."""
    needles = [f"{LABEL_PREFIX}{lab}\n" for lab in labels]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.copy()
            pdf["scores"] = [[float(str(p).count(nd)) for nd in needles]
                             for p in pdf[prompt_col]]
            yield pdf
    return run


def score_prompts(df: DataFrame, scorer, labels, prompt_col: str = "prompt",
                  kind: str = "column") -> DataFrame:
    """M8: add ``scores ARRAY<DOUBLE>`` (one per label) to every row."""
    if kind == "column":
        return df.withColumn("scores", scorer(F.col(prompt_col), labels))
    schema = T.StructType(df.schema.fields +
                          [T.StructField("scores", T.ArrayType(T.DoubleType()), True)])
    ship_package(df.sparkSession)
    return df.mapInPandas(scorer, schema)


def decode_label(scores: str | Column, labels: list[str] | tuple[str, ...],
                 row_id: str | Column, seed: int = 123) -> Column:
    """M7: label at the first maximum score.

    All scores equal: the ``others`` score becomes 1.0 before the argmax
    when the label space has it (so ``others`` wins for tied scores below
    1.0), else a seeded random label (md5 of the row id), the same on every
    run.  A score array whose length is not the label count is an error.
    """
    s = F.col(scores) if isinstance(scores, str) else scores
    n = len(labels)
    lab = F.array(*[F.lit(x) for x in labels])
    if OTHERS in labels:
        # The fallback sets the 'others' score to 1.0, then takes the first
        # maximum: 'others' wins only if the tied value is below 1.0.
        oi = list(labels).index(OTHERS)
        v = F.element_at(s, 1)
        tie = F.when(v < 1.0, F.lit(oi)).when(v > 1.0, F.lit(0 if oi != 0 else 1)) \
            .otherwise(F.lit(0))
    else:
        rid = F.col(row_id) if isinstance(row_id, str) else row_id
        tie = seeded_draw(seed, n, rid).cast("int")
    idx = F.when(F.size(s) != n,
                 F.raise_error(F.lit(f"expected {n} scores, one per label"))) \
        .when(all_equal(s), tie).otherwise(argmax(s))
    return F.element_at(lab, idx.cast("int") + 1)


def shape_results(df: DataFrame, id_col: str, prompt_col: str = "prompt",
                  label_col: str = "label", output_col: str = "outputs") -> DataFrame:
    """The four-column text result table."""
    return df.select(F.col(id_col).cast("string").alias("id"),
                     F.col(prompt_col).cast("string").alias("input_all_tokens"),
                     F.coalesce(F.col(label_col).cast("string"), F.lit("nan")).alias("label"),
                     F.col(output_col).cast("string").alias("outputs"))
