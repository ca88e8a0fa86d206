"""Dense row positions and range generators, distributed.

Spark rows have no order; several operators need the i-th row of a table in
some total order (positional pools, uniform draws by position, full
rankings).  ``dense_positions`` sorts with a range-partitioned ``orderBy``
(a single hot group spreads over many tasks), writes the sorted ids to the
reliable checkpoint folder so the order cannot change if a task is re-run,
and numbers rows as  partition offset + index inside the partition; the
offsets are a running sum over one count per partition, computed in Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotsmith.session import BROADCAST_ROW_LIMIT, checkpoint_dir

_PART_SHIFT = 33  # monotonically_increasing_id = partition << 33 | row index


def index_in_order(df: DataFrame, id_col: str) -> DataFrame:
    """0-based index of each row in the frame's current partition order.

    ``df`` must be deterministic (a file scan or a checkpointed frame).  The
    offset of each partition is a running sum over the per-partition counts
    (one row per partition), joined back on the partition id.
    """
    tagged = df.withColumn("_mid", F.monotonically_increasing_id()) \
        .withColumn("_pid", F.shiftright(F.col("_mid"), _PART_SHIFT))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
               .withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
               .select("_pid", "_off"))
    if df.rdd.getNumPartitions() <= BROADCAST_ROW_LIMIT:   # rows <= partitions
        offsets = F.broadcast(offsets)
    local = F.col("_mid") - F.shiftleft(F.col("_pid"), _PART_SHIFT)
    return (tagged.join(offsets, "_pid")
            .withColumn(id_col, (F.col("_off") + local).cast("bigint"))
            .drop("_mid", "_pid", "_off"))


def dense_positions(df: DataFrame, order: list[Column], group_cols: list[str] = (),
                    keep: list[str] = (), pos_col: str = "pos") -> DataFrame:
    """Position 0..n-1 of each row in ``order``, restarting in every group.

    Returns ``group_cols + keep + [pos_col]``.  ``order`` must be a total
    order inside a group (end it with a unique id).
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    group_cols, keep = list(group_cols), list(keep)
    ordered = (df.select(*group_cols, *keep)
               .orderBy(*[F.col(g) for g in group_cols], *order)
               .checkpoint(eager=True))
    indexed = index_in_order(ordered, "_gpos")
    if not group_cols:
        return indexed.withColumnRenamed("_gpos", pos_col)
    starts = indexed.groupBy(*group_cols).agg(F.min("_gpos").alias("_start"))
    if starts.limit(BROADCAST_ROW_LIMIT + 1).count() <= BROADCAST_ROW_LIMIT:
        starts = F.broadcast(starts)
    return (indexed.join(starts, group_cols)
            .withColumn(pos_col, F.col("_gpos") - F.col("_start"))
            .drop("_gpos", "_start"))


def explode_range(df: DataFrame, n: int | Column, out_col: str,
                  chunk: int = 50_000) -> DataFrame:
    """Repeat each row for ``out_col`` = 0 .. n-1 (n <= 0 gives no rows).

    Rows are spread over tasks first, large ranges in chunks: neither a small
    file of rows nor one row with a huge ``n`` is expanded inside a single task.
    """
    n_col = F.lit(n) if isinstance(n, int) else n
    n_col = n_col.cast("bigint")
    tasks = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if isinstance(n, int) and n <= chunk:
        if n <= 0:
            return df.withColumn(out_col, F.lit(None).cast("bigint")).where("false")
        rows = df.repartition(tasks, *[F.col(c) for c in df.columns])
        return rows.withColumn(out_col, F.explode(F.sequence(F.lit(0).cast("bigint"),
                                                             n_col - 1)))
    starts = (df.withColumn("_n", n_col).where(F.col("_n") > 0)
              .withColumn("_c", F.explode(F.sequence(F.lit(0).cast("bigint"),
                                                     F.floor((F.col("_n") - 1) / chunk)
                                                     .cast("bigint")))))
    # numbered, by row and chunk: every task gets its share of every row's range
    starts = starts.repartition(tasks, *[F.col(c) for c in df.columns], F.col("_c"))
    lo = F.col("_c") * chunk
    hi = F.least(lo + chunk, F.col("_n")) - 1
    return (starts.withColumn(out_col, F.explode(F.sequence(lo, hi)))
            .drop("_n", "_c"))
