import os
import tempfile

from shared import SF0001, rows
from shotsmith.operators.bm25 import BM25Index
from shotsmith.sources import tables
from shotsmith.streaming.retrieval import stream_bm25_rankings


def test_stream_matches_batch(spark):
    pool = tables.pool(spark, SF0001)
    q = tables.queries(spark, SF0001).select("query_id", "sentence")
    base = tempfile.mkdtemp(prefix="shotsmith-stream-")
    src = os.path.join(base, "in")
    q.where("query_id < 20").write.parquet(os.path.join(src, "a"))
    q.where("query_id >= 20").write.parquet(os.path.join(src, "b"))
    index = BM25Index(pool)
    stream = (spark.readStream.schema(q.schema).option("recursiveFileLookup", True)
              .option("maxFilesPerTrigger", 1).parquet(src))
    out = os.path.join(base, "out")
    sq = stream_bm25_rankings(index, stream, 5, out, os.path.join(base, "ck"),
                              available_now=True)
    sq.awaitTermination(300)
    got = spark.read.parquet(out)
    assert got.select("batch_id").distinct().count() >= 2
    assert rows(got, "query_id", "rank", "cand_id") == \
        rows(index.rank(q, 5), "query_id", "rank", "cand_id")


def test_rerun_batch_replaces_its_output(spark):
    from shotsmith.streaming.retrieval import batch_writer
    pool = tables.pool(spark, SF0001)
    q = tables.queries(spark, SF0001).select("query_id", "sentence").where("query_id < 10")
    out = os.path.join(tempfile.mkdtemp(prefix="shotsmith-stream-"), "out")
    write = batch_writer(BM25Index(pool), 3, out)
    write(q, 0)
    write(q, 0)     # the same batch again, as after a failure before commit
    got = spark.read.parquet(out)
    assert got.count() == q.count() * 3
