"""Ranking inside groups: top-k (W1/W2/W3 core) and full permutations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shotsmith.operators.positions import dense_positions


# A window may sort one whole group in one task only below this many rows.
WINDOW_GROUP_ROWS = 250_000


def rank_within(df: DataFrame, group_cols: list[str], order: list[F.Column],
                k: int | None, max_group_rows: int | None = None) -> DataFrame:
    """rank = 1.. inside each group; top k via WindowGroupLimit, or all rows.

    A full ranking uses one window per group only when every group is known
    to be small (``max_group_rows``, e.g. the pool size); otherwise -- a group
    may be a third of all rows -- a range-partitioned global sort and
    distributed dense positions.
    """
    small = max_group_rows is not None and max_group_rows <= WINDOW_GROUP_ROWS
    if k is not None or small:
        w = Window.partitionBy(*group_cols).orderBy(*order)
        ranked = df.withColumn("rank", F.row_number().over(w))
        return ranked if k is None else ranked.where(F.col("rank") <= k)
    keep = [c for c in df.columns if c not in group_cols]
    pos = dense_positions(df, order, group_cols=group_cols, keep=keep, pos_col="_p")
    return pos.withColumn("rank", F.col("_p") + 1).drop("_p")
