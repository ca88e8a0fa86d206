"""Rows that repeat one id, or have none, spread like any others."""

import numpy as np
import public_tokenizers

from shotsmith.llm import packing, quality


def test_packing_spreads_null_and_repeated_ids(spark):
    n = 6000
    docs = spark.createDataFrame(
        [(None if i % 2 else 7, f"word {i % 50} " * (1 + i % 9)) for i in range(n)],
        "doc_id bigint, text string")
    path = public_tokenizers.path("word_bpe_49k.json")
    got = packing.pack_documents(docs, path).toPandas()
    assert list(got.columns) == ["doc_id", "piece", "start", "length", "ids_crc32",
                                 "sequence_id", "offset"]
    assert len(got) == n
    groups = -(-n // packing.GROUP)
    assert sorted((got["sequence_id"] % groups).unique()) == list(range(groups))
    share = (got["sequence_id"] % groups).value_counts() / n
    assert share.max() < 0.6
    for _, seq in got.sort_values("offset").groupby("sequence_id"):
        ends = seq["offset"] + seq["length"]
        assert seq["offset"].tolist() == [0, *ends[:-1]] and ends.iloc[-1] <= 2048
    want = packing.tokenize(docs, path).toPandas()
    keys = ["length", "ids_crc32"]
    assert sorted(map(tuple, got[keys].values)) == sorted(map(tuple, want[keys].values))


def test_training_sample_takes_one_text_of_a_repeated_id(spark):
    base = [(i, ("good words here " if i % 3 else "bad bad bad ") + str(i)) for i in range(40)]
    more = [(5, base[5][1] + " zz")] * 300 + [(5, None)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(40)],
                                   "doc_id bigint, quality bigint")
    frame = lambda rows: spark.createDataFrame(rows, "doc_id bigint, text string")
    assert np.array_equal(quality.fit(frame(base), labels), quality.fit(frame(base + more), labels))
