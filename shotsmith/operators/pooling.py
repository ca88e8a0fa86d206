"""A5: masked mean pooling of token vectors into one vector per group.

pooled[d] = sum_i(v_i[d] * mask_i) / max(sum_i mask_i, 1e-9)

Long form: vectors are exploded to (group, dim, value) and summed with a
partial-then-final aggregation, so a group holding a third of all rows is
folded map-side and never gathered into one task; only ``dim`` numbers per
group per partition cross the network.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MASK_CLAMP = 1e-9


def masked_mean_pool(df: DataFrame, group_col: str, vec_col: str,
                     mask: str | Column) -> DataFrame:
    """(group, dim INT (0-based), value DOUBLE)."""
    m = (F.col(mask) if isinstance(mask, str) else mask).cast("double")
    exploded = df.select(F.col(group_col), m.alias("_m"),
                         F.posexplode(vec_col).alias("dim", "_x"))
    return (exploded.groupBy(group_col, "dim")
            .agg((F.sum(F.col("_x").cast("double") * F.col("_m"))
                  / F.greatest(F.sum("_m"), F.lit(MASK_CLAMP))).alias("value"))
            .withColumn("dim", F.col("dim").cast("int")))


def pooled_vectors(long_form: DataFrame, group_col: str) -> DataFrame:
    """(group, vector ARRAY<DOUBLE>) from the long form; a group holds dim values."""
    return (long_form.groupBy(group_col)
            .agg(F.array_sort(F.collect_list(F.struct("dim", "value"))).alias("_s"))
            .select(group_col, F.col("_s.value").alias("vector")))
