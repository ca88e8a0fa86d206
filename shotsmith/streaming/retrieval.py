"""Rank each micro-batch of arriving queries against a static pool.

Structured Streaming reads new query files; ``foreachBatch`` runs the batch
operators on each micro-batch (ranking windows are not allowed on a stream
itself) against a BM25 index prepared once.  Each batch writes its own
folder ``batch_id=<n>`` with overwrite, so a batch re-run after a failure
(before the stream committed it) replaces its earlier output instead of
adding to it; the stream's checkpoint records which files were consumed, so a
restarted query continues where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from shotsmith.operators.bm25 import BM25Index


def batch_writer(index: BM25Index, k: int, out_path: str):
    """The ``foreachBatch`` function: rank one batch, overwrite its folder."""
    def run(batch: DataFrame, batch_id: int) -> None:
        ranked = index.rank(batch.select("query_id", "sentence"), k)
        ranked.write.mode("overwrite").parquet(f"{out_path.rstrip('/')}/batch_id={batch_id}")
    return run


def stream_bm25_rankings(index: BM25Index, queries: DataFrame, k: int, out_path: str,
                         checkpoint_location: str, available_now: bool = False
                         ) -> StreamingQuery:
    """Start a query that writes (query_id, rank, cand_id, score) parquet rows
    under ``batch_id=<n>`` for every micro-batch of the streaming ``queries``
    frame (query_id, sentence)."""
    writer = (queries.writeStream.foreachBatch(batch_writer(index, k, out_path))
              .option("checkpointLocation", checkpoint_location))
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start()
