import json
import os
import tempfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from shared import rows
from shotsmith.sources.labelled import read_labelled
from shotsmith.sources.rankings import (rankings_from_json, read_rankings, read_rankings_json,
                                        rankings_to_json,
                                        write_rankings, write_rankings_json)
from shotsmith.sources.results import write_results


def scratch():
    return tempfile.mkdtemp(prefix="shotsmith-test-")


def test_read_labelled_csv_quotes_ids_and_nan(spark):
    d = scratch()
    path = os.path.join(d, "train_1.csv")
    with open(path, "w", encoding="utf-8") as f:
        f.write('sentence,label_id,label,prediction\n')
        f.write('"he said ""hi"", then left",0,negative,positive\n')
        f.write('plain text ,1,positive,\n')
        f.write('emoji 😀 ok,1,positive,positive\n')
    df = read_labelled(spark, path)
    got = {r["cand_id"]: r for r in df.collect()}
    assert sorted(got) == [0, 1, 2]
    assert got[0]["sentence"] == 'he said "hi", then left'
    assert got[0]["label"] == "negative" and got[0]["label_id"] == 0
    assert got[1]["sentence"] == "plain text "
    assert got[1]["prediction"] == "nan"
    assert got[2]["sentence"] == "emoji 😀 ok"


def test_rankings_json_lines_roundtrip(spark):
    r = spark.createDataFrame([(q, i + 1, c) for q in range(3) for i, c in
                               enumerate([5, 3, 8, 1])], "query_id bigint, rank int, cand_id bigint")
    d = os.path.join(scratch(), "rank_json")
    write_rankings_json(r, d)
    assert rows(read_rankings_json(spark, d)) == rows(r)
    lines = rankings_to_json(r).collect()
    assert json.loads(lines[0]["value"]) in ({"0": ["5", "3", "8", "1"]},
                                             {"1": ["5", "3", "8", "1"]},
                                             {"2": ["5", "3", "8", "1"]})


def test_rankings_single_object_file_with_int_ids(spark):
    d = scratch()
    path = os.path.join(d, "random_each_1.json")
    with open(path, "w") as f:
        json.dump({"0": [4, 2, 9], "1": ["7", "0"]}, f)
    got = rows(read_rankings_json(spark, path))
    assert got == [(0, 1, 4), (0, 2, 2), (0, 3, 9), (1, 1, 7), (1, 2, 0)]


def test_rankings_parquet_partition_pruning(spark):
    r = spark.createDataFrame([(0, 1, 5), (0, 2, 3)], "query_id bigint, rank int, cand_id bigint")
    d = os.path.join(scratch(), "rankings")
    write_rankings(r.withColumn("mode", F.lit("bm25")).withColumn("train_idx", F.lit(1)), d,
                   ["mode", "train_idx"])
    write_rankings(r.withColumn("mode", F.lit("sbert")).withColumn("train_idx", F.lit(1)), d,
                   ["mode", "train_idx"], mode="append")
    got = read_rankings(spark, d, mode="bm25", train_idx=1)
    assert rows(got, "query_id", "rank", "cand_id") == [(0, 1, 5), (0, 2, 3)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan


def test_write_results_partitioned_csv(spark):
    res = spark.createDataFrame([("0", "p,\"q\"", "nan", "positive")],
                                "id string, input_all_tokens string, label string, outputs string")
    d = os.path.join(scratch(), "results")
    write_results(res, d, fmt="csv", model="m", dataset="sst2", method="feedback")
    back = (spark.read.option("header", True).option("escape", '"').csv(d)
            .where("dataset = 'sst2'"))
    assert back.first()["input_all_tokens"] == 'p,"q"'


def test_rankings_pretty_printed_file(spark):
    d = scratch()
    path = os.path.join(d, "bm25_1.json")
    with open(path, "w") as f:
        json.dump({"3": ["1", "0"], "4": ["2"]}, f, indent=2)
    got = rows(read_rankings_json(spark, path, whole_file=True))
    assert got == [(3, 1, 1), (3, 2, 0), (4, 1, 2)]


def test_read_labelled_pandas_missing_texts(spark):
    d = scratch()
    path = os.path.join(d, "train.csv")
    with open(path, "w", encoding="utf-8") as f:
        f.write("sentence,label_id,label,prediction\n")
        f.write("NA,x,positive,null\n")
        f.write("fine,1,None,positive\n")
    got = {r["cand_id"]: r for r in read_labelled(spark, path).collect()}
    assert got[0]["sentence"] is None and got[0]["prediction"] == "nan"
    assert got[0]["label_id"] is None and got[1]["label_id"] == 1
    assert got[1]["label"] == "nan"


def test_json_export_cuts_long_rankings(spark):
    r = spark.createDataFrame([(q, i + 1, 10 * i) for q in (1, 2) for i in range(5)],
                              "query_id bigint, rank int, cand_id bigint")
    lines = rankings_to_json(r, line_ids=2)
    assert lines.count() == 6
    assert rows(rankings_from_json(lines)) == rows(r)


def test_bad_ids_raise(spark):
    for text in ('{"1": ["5", "x"]}', '{"q": ["5"]}'):
        with pytest.raises(Exception, match="in a ranking"):
            rankings_from_json(spark.createDataFrame([(text,)], "value string")).collect()


def test_overwriting_keeps_other_runs(spark):
    r = spark.createDataFrame([(0, 1, 5)], "query_id bigint, rank int, cand_id bigint")
    d = os.path.join(scratch(), "rankings")
    for mode in ("bm25", "sbert", "bm25"):
        write_rankings(r.withColumn("mode", F.lit(mode)), d, ["mode"])
    assert sorted(x["mode"] for x in read_rankings(spark, d).collect()) == ["bm25", "sbert"]
    res = spark.createDataFrame([("0", "Sentence: x\nLabel: ", "nan", "positive")],
                                "id string, input_all_tokens string, label string, outputs string")
    out = os.path.join(scratch(), "results")
    for _ in range(2):
        write_results(res, out, fmt="csv", model="m")
    back = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(out).collect()
    assert [x["input_all_tokens"] for x in back] == ["Sentence: x\nLabel: "]


def test_quoted_newline_reads_with_multi_line(spark):
    path = os.path.join(scratch(), "q.csv")
    with open(path, "w") as f:
        f.write('sentence,label\n"two\nlines",positive\n')
    assert read_labelled(spark, path, multi_line=True).first()["sentence"] == "two\nlines"


def test_row_ids_follow_file_order_across_splits(spark):
    d = tempfile.mkdtemp(prefix="shotsmith-csv-")
    path = os.path.join(d, "pool.csv")
    with open(path, "w") as f:
        f.write("sentence,label\n")
        for i in range(3000):
            f.write(f"row {i} text,{'positive' if i % 3 else 'negative'}\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = read_labelled(spark, path)
        assert df.rdd.getNumPartitions() > 4
        got = df.select("cand_id", "sentence").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((r["cand_id"], r["sentence"]) for r in got) == \
        [(i, f"row {i} text") for i in range(3000)]


def test_row_ids_follow_the_file_order(spark):
    for fmt in ("csv", "parquet"):
        d, want = scratch(), []
        for k, n in enumerate((3, 4000, 300)):       # Spark scans the largest file first
            texts = [f"file {k} row {i}" for i in range(n)]
            want += texts
            path = os.path.join(d, f"train_{k}.{fmt}")
            if fmt == "csv":
                with open(path, "w", encoding="utf-8") as f:
                    f.write("sentence,label\n" + "".join(f"{t},x\n" for t in texts))
            else:
                pd.DataFrame({"sentence": texts, "label": "x"}).to_parquet(path)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        try:
            got = rows(read_labelled(spark, d, fmt=fmt), "cand_id", "sentence")
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert got == list(enumerate(want))
