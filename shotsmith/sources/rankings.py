"""Ranking tables <-> storage, and the JSON map-of-lists format.

The table form ``(query_id BIGINT, rank INT, cand_id BIGINT)`` is the
contract between retrieval and selection; it is stored as parquet
partitioned by run parameters.  The JSON form is ``{"<query>": ["<id>", ...]}``
(ids may also be bare integers, as random mode wrote them).  We write one
object per query per line (JSON Lines), which any number of tasks can write
and read; a file holding a single object for all queries (one line) reads
the same way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RANKING_JSON_SCHEMA = "map<string,array<string>>"


# Ids in one JSON line.  A longer ranking takes several lines per query; the
# key of a later line carries the ranks before it: "<query>@<ranks>".
LINE_IDS = 100_000


def rankings_to_json(ranking: DataFrame, line_ids: int = LINE_IDS) -> DataFrame:
    """JSON objects of at most ``line_ids`` ids, in rank order -> (query_id, value).

    Ranks run 1..n without gaps; a line's ids are a bounded group, so a
    ranking of any length is written by many tasks.
    """
    before = (F.floor((F.col("rank") - 1) / line_ids) * line_ids).cast("bigint")
    key = F.concat(F.col("query_id").cast("string"),
                   F.when(F.col("_before") > 0, F.concat(F.lit("@"), F.col("_before").cast("string")))
                   .otherwise(F.lit("")))
    return (ranking.groupBy("query_id", before.alias("_before"))
            .agg(F.array_sort(F.collect_list(F.struct("rank", "cand_id"))).alias("_r"))
            .select("query_id", F.to_json(F.create_map(
                key, F.transform("_r", lambda s: s["cand_id"].cast("string")))).alias("value")))


def _id(text: F.Column, what: str) -> F.Column:
    """The id, or an error for a text that is none (as the original's reader fails)."""
    number = text.try_cast("bigint")
    return F.when(number.isNull(), F.raise_error(F.concat(
        F.lit(f"bad {what} in a ranking: "), F.coalesce(text, F.lit("null")))).cast("bigint")).otherwise(number)


def rankings_from_json(lines: DataFrame, col: str = "value", spread: int = 0) -> DataFrame:
    """JSON text rows -> (query_id, rank, cand_id); a bad id raises."""
    parsed = lines.select(F.explode(F.from_json(F.col(col), RANKING_JSON_SCHEMA))
                          .alias("_q", "_ids"))
    if spread:      # one value may hold all queries: deal them out before their ids are opened
        parsed = parsed.repartition(spread, "_q")
    key = F.split("_q", "@")
    return parsed.select(
        _id(key[0], "query id").alias("query_id"),
        F.coalesce(F.get(key, F.lit(1)).cast("int"), F.lit(0)).alias("_before"),
        F.posexplode("_ids").alias("_p", "_c")) \
        .select("query_id", (F.col("_before") + F.col("_p") + 1).cast("int").alias("rank"),
                _id(F.col("_c"), "candidate id").alias("cand_id"))


def write_rankings_json(ranking: DataFrame, path: str, mode: str = "overwrite") -> None:
    """S3 (JSON): JSON Lines text files, one object per query."""
    rankings_to_json(ranking).select("value").write.mode(mode).text(path)


def read_rankings_json(spark: SparkSession, path: str, whole_file: bool = False) -> DataFrame:
    """JSON Lines files or a single-object file -> ranking table.

    ``whole_file`` reads each file as one value (a pretty-printed object
    spanning lines); one task parses a file, and its queries are dealt out after.
    """
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions")) if whole_file else 0
    return rankings_from_json(spark.read.text(path, wholetext=whole_file), spread=tasks)


def write_rankings(ranking: DataFrame, path: str, partition_cols: list[str] = (),
                   mode: str = "overwrite") -> None:
    """S3 (table): parquet, partitioned by run parameters (task, dataset, mode,
    ...).  Overwriting replaces the partitions of this ranking and no others."""
    w = ranking.write.mode(mode).option("partitionOverwriteMode", "dynamic")
    if partition_cols:
        w = w.partitionBy(*partition_cols)
    w.parquet(path)


def read_rankings(spark: SparkSession, path: str, **filters) -> DataFrame:
    """S4 (table): filters on partition columns prune directories."""
    df = spark.read.parquet(path)
    for k, v in filters.items():
        df = df.where(F.col(k) == F.lit(v))
    return df
