"""A4 / M1: an inverted index of the pool, written once and extended by files.

Layout under one folder, one sub-folder ``gen=<i>`` per added pool file:

* ``blocks`` (token, cls, block, max_tf, min_dl, df, ctf, rows) -- postings of
  one token in one document block.  The marker token holds every document of
  the block (tf 0; its ctf is the block's total length);
* ``docs``   (cand_id, cls, dl) -- one row per document;
* ``vocab``  (token, df, ctf) -- statistics of that file alone.  They add up, so
  N, mean length and idf of the whole pool come from the vocabulary tables and
  never need the earlier text again (``stats``).  The marker row holds N and
  the total length.

Blocks are made where the text is scanned: a task tokenises its documents, and
groups about ``CHUNK`` postings at a time by token and block.  Neither text nor
single postings are shuffled; a hot token is spread over the files of all tasks.
A document block holds at most ``BLOCK_DOCS`` documents of one class and of nearly
equal length (quarter octaves of ``dl``, cut in order of length).  Hence ``max_tf``
and ``min_dl`` bound every weight of the block closely, whatever statistics
later files bring: block maxima stay valid and nothing is rewritten when the
pool grows.
"""

from __future__ import annotations

import uuid
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from shotsmith.functions.text import TOKEN_SEPARATOR, as_text
from shotsmith.session import checkpoint_dir, ship_package

MARKER = " "          # never a token: tokens are cut at spaces
BLOCK_DOCS = 128
SLICE = 1 << 20       # characters tokenised at a time
BATCH = 200_000       # postings kept as Python values
CHUNK = 2_000_000     # postings grouped at a time
GIVE = 20_000         # rows of one output batch


def count_tokens(text: str) -> tuple[int, Counter]:
    """Length in tokens (cut at every single space), and each token's count."""
    n, seen, at = 0, Counter(), 0
    while True:
        end = text.find(TOKEN_SEPARATOR, at + SLICE)
        parts = text[at: len(text) if end < 0 else end].split(TOKEN_SEPARATOR)
        n += len(parts)
        seen.update(parts)
        if end < 0:
            return n, seen
        at = end + 1


def _group(table, first_block: int):
    """Posting blocks of ``table`` (cls, cand_id, dl, token, tf; the marker row of each
    document among them) in token order, numbered from ``first_block`` on, and
    the number of blocks."""
    import pyarrow as pa
    import pyarrow.compute as pc
    dl, tf = table["dl"].to_numpy(), table["tf"].to_numpy()
    token, cls = (table[c].combine_chunks().dictionary_encode(null_encoding="encode") for c in ("token", "cls"))
    # documents by class, quarter octave of length and length; runs of at most BLOCK_DOCS
    at = np.flatnonzero(tf == 0)
    doc = np.cumsum(tf == 0) - 1                    # a marker row begins its document
    part, size = cls.indices.to_numpy()[at], dl[at]
    band = np.floor(4 * np.log2(size)).astype(np.int64)
    order = np.lexsort((size, band, part))
    new = np.r_[True, (np.diff(part[order]) != 0) | (np.diff(band[order]) != 0)]
    start = np.flatnonzero(new)
    inside = np.arange(len(at)) - start[np.cumsum(new) - 1]
    block = np.empty(len(at), np.int64)
    block[order] = np.cumsum(inside % BLOCK_DOCS == 0) - 1
    blocks = int(block.max(initial=-1)) + 1
    # postings by token, then block
    rank = np.empty(len(token.dictionary), np.int64)
    rank[pc.sort_indices(token.dictionary).to_numpy()] = np.arange(len(rank))
    key = rank[token.indices.to_numpy()] * blocks + block[doc]
    order = np.argsort(key, kind="stable")
    start = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0])
    dl, tf = dl[order], tf[order]
    head = pa.array(order[start])
    marker = pc.equal(token.dictionary, MARKER).to_numpy(zero_copy_only=False)[token.indices.to_numpy()[order]]
    edge = np.r_[start, len(order)]
    rows = pa.StructArray.from_arrays(
        [table["cand_id"].combine_chunks().take(pa.array(order)), pa.array(tf), pa.array(dl)],
        names=["cand_id", "tf", "dl"])
    return pa.RecordBatch.from_arrays(
        [table["token"].combine_chunks().take(head), table["cls"].combine_chunks().take(head),
         pa.array(first_block + block[doc[order[start]]]), pa.array(np.maximum.reduceat(tf, start)),
         pa.array(np.minimum.reduceat(dl, start)), pa.array(np.diff(edge)),
         pa.array(np.add.reduceat(np.where(marker, dl, tf), start)),
         pa.ListArray.from_arrays(pa.array(edge, pa.int32()), rows)],
        names=["token", "cls", "block", "max_tf", "min_dl", "df", "ctf", "rows"]), blocks


def _scan_blocks(pool: DataFrame, by: str | None, gen: int) -> DataFrame:
    """The posting blocks of ``pool``, a marker block of every document block among them."""
    import pyarrow as pa
    ship_package(pool.sparkSession)
    cls = F.col(by) if by else F.lit(0)
    rows = pool.select(cls.alias("cls"), F.col("cand_id").cast("bigint").alias("cand_id"),
                       as_text("sentence").alias("text"))
    posting = StructType([StructField(c, LongType()) for c in ("cand_id", "tf", "dl")])
    schema = StructType([StructField("token", StringType()), rows.schema["cls"]]
                        + [StructField(c, LongType()) for c in ("block", "max_tf", "min_dl", "df", "ctf")]
                        + [StructField("rows", ArrayType(posting))])

    def run(batches):
        from pyspark import TaskContext
        block = (gen << 44) + (TaskContext.get().partitionId() << 24)
        held, n = [], 0

        def give():
            nonlocal block
            out, blocks = _group(pa.Table.from_batches(held), block)
            block += blocks
            held.clear()
            for i in range(0, out.num_rows, GIVE):
                yield out.slice(i, GIVE)

        for batch in batches:
            at, dl, token, tf = [], [], [], []

            def hold():
                ids = pa.array(at, pa.int64())
                held.append(pa.RecordBatch.from_arrays(
                    [batch.column(0).take(ids), batch.column(1).take(ids), pa.array(dl, pa.int64()),
                     pa.array(token, pa.string()), pa.array(tf, pa.int64())],
                    names=["cls", "cand_id", "dl", "token", "tf"]))
                for part in (at, dl, token, tf):
                    part.clear()

            for i in range(batch.num_rows):
                length, seen = count_tokens(batch.column(2)[i].as_py())
                size = len(seen) + 1
                at += [i] * size
                dl += [length] * size
                token.append(MARKER)
                token += seen
                tf.append(0)
                tf += seen.values()
                n += size
                if len(at) >= BATCH:
                    hold()
                    if n >= CHUNK:
                        yield from give()
                        n = 0
            if at:
                hold()
        if held:
            yield from give()

    return rows.mapInArrow(run, schema)


class PostingsStore:
    """The index in ``path``; ``add`` appends a pool file, readers see all files."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def create(cls, pool: DataFrame, by: str | None = None, path: str | None = None) -> "PostingsStore":
        """Index ``pool`` (cand_id, sentence[, ``by``]) in a new folder (default:
        inside the checkpoint folder)."""
        spark = pool.sparkSession
        store = cls(spark, path or f"{checkpoint_dir(spark)}/postings-{uuid.uuid4().hex}")
        store.add(pool, by)
        return store

    def _generations(self) -> int:
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(f"{self.path}/docs")
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return len(fs.listStatus(root)) if fs.exists(root) else 0

    def add(self, pool: DataFrame, by: str | None = None) -> None:
        """Index the documents of one more pool file; their ids must be new.  The
        ``docs`` folder is written last: a file counts once it is whole."""
        gen = self._generations()
        spark = self.spark
        at = lambda kind: f"{self.path}/{kind}/gen={gen}"
        _scan_blocks(pool, by, gen).write.mode("overwrite").parquet(at("blocks"))
        blocks = spark.read.parquet(at("blocks"))
        (blocks.groupBy("token").agg(F.sum("df").alias("df"), F.sum("ctf").alias("ctf"))
         .write.mode("overwrite").parquet(at("vocab")))
        (blocks.where(F.col("token") == MARKER).select("cls", F.explode("rows").alias("p"))
         .select("p.cand_id", "cls", "p.dl").write.mode("overwrite").parquet(at("docs")))

    def read(self, kind: str) -> DataFrame:
        """One of the tables over all complete files."""
        paths = [f"{self.path}/{kind}/gen={g}" for g in range(self._generations())]
        return self.spark.read.parquet(*paths)

    def vocabulary(self) -> DataFrame:
        """(token, df, ctf) of the whole pool: the files' tables added up."""
        vocab = self.read("vocab")
        if self._generations() == 1:
            return vocab.select("token", "df", "ctf")
        return vocab.groupBy("token").agg(F.sum("df").alias("df"), F.sum("ctf").alias("ctf"))
