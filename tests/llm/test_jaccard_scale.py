"""N-gram Jaccard join: what is sent and kept when many documents share text without being near-duplicates."""

import os
import random

import numpy as np
import pytest

from shotsmith.llm import common, components, jaccard
from test_text_operators import brute_components

SCHEMA = "doc_id bigint, text string"


def template_rows(seed, near):
    """Documents of 12 of 24 common lines in any order (no two are near), and near copies of the first."""
    r = random.Random(seed)
    lines = [" ".join(f"w{r.randrange(500)}" for _ in range(40)) for _ in range(24)]
    texts = ["\n".join(r.sample(lines, 12)) for _ in range(130)]
    first = texts[0].split(" ")
    for k in range(near):
        at = r.randrange(len(first) - 30)
        texts.append(" ".join(first[:at] + [f"x{k}"] + first[at + 20:]))
    return [(7 * i % 1009, t) for i, t in enumerate(texts)]


def test_texts_of_a_large_tile_are_sent_once(spark, monkeypatch):
    """130 documents without links and 24 near copies in one component of 16-class blocks: a text goes
    to its own block, and to pairs of blocks only where a bitmap allows a link of components."""
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    folder = common.run_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    written = {}

    def counted(df, name, real=common.write_once):
        copy = real(df, name)
        if name != "edges":
            written.setdefault(name, []).append(copy.count())
        return copy

    monkeypatch.setattr(jaccard, "write_once", counted)
    docs = spark.createDataFrame(template_rows(5, 24), SCHEMA).repartition(4)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link_components(docs).collect()}
    assert found == brute_components(docs.collect())
    assert len({c for _, c in found.values()}) == 130
    members = written["members"][0]
    assert members > 140                                # tied by common shingles, in about ten blocks
    assert written["tiles"][0] == members               # before: a row, and a text, for each pair of blocks
    assert sum(written["near"]) < members               # at most two for each pair of blocks
    # leading shingles are gone when nothing reads them
    names = {n.split("-")[0] for n in set(os.listdir(folder)) - before}
    assert {"rows", "classes", "members"} <= names and not names & {"sets", "led", "frequent"}


def test_order_puts_common_shingles_last_and_keeps_the_prefix_rule(spark):
    rows = template_rows(3, 30)
    order = jaccard.order(spark.createDataFrame(rows, SCHEMA))
    leads = []
    for _, text in rows:
        s, first = order.sets(text)
        assert np.array_equal(s, jaccard.shingles(text)) and len(first) == jaccard.lead(len(s))
        leads.append((set(s.tolist()), set(first.tolist())))
    for i, (a, x) in enumerate(leads):
        for b, y in leads[:i]:
            if 4 * len(a & b) >= 3 * len(a | b):
                assert x & y
    hot = np.array([5, 9], np.int64)
    words = jaccard._words("rare1 rare2 rare3 rare4 rare5 the of and to in on")
    made = jaccard.Order(jaccard._shingles(words)[:1].view(np.int64), words[5:].view(np.int64), np.full(6, 1000))
    s, first = made.sets("rare1 rare2 rare3 rare4 rare5 the of and to in on")
    assert len(s) == 7 and len(first) == 2
    # the shingle of rare words only is known as frequent; those with the most rare words are next
    assert set(first.tolist()) == set(jaccard._shingles(words)[1:3].tolist())
    assert jaccard.Order(hot, hot[:0], hot[:0]).sets("")[1].size == 0


def test_may_link_keeps_every_pair_that_links():
    r = np.random.default_rng(4)
    for seed in range(20):
        base = np.unique(r.integers(0, 1 << 62, 300).astype(np.uint64))
        sets = [np.unique(r.choice(base, r.integers(200, len(base)), replace=False)) for _ in range(40)]
        size = np.array([len(s) for s in sets], np.int64)
        left = r.random(40) < 0.5
        component = r.integers(0, 30, 40)
        maps = [jaccard.full_map(s) for s in sets]
        flags = jaccard.may_link(size, maps, left, component, True)
        some = jaccard.may_link(size, maps, left, component, False)
        linked = [(i, j) for i in range(40) for j in range(40) if left[i] and not left[j] and component[i] != component[j]
                  and 4 * len(np.intersect1d(sets[i], sets[j])) >= 3 * len(np.union1d(sets[i], sets[j]))]
        assert linked and all(flags[i] and flags[j] for i, j in linked)
        assert not (some & ~flags).any() and some.any()


def test_bitmap_of_wanted_rows_loses_none(spark):
    rows = [(None if i % 50 == 0 else i, f"t{i}", i) for i in range(5000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, key bigint")
    got = {(r.doc_id, r.key) for r in jaccard._some_of(docs, docs.where("key % 10 = 3").select("doc_id", "key")).collect()}
    assert {(i, i) for i in range(3, 5000, 10)} <= got and len(got) < 1000
    assert jaccard._some_of(docs, docs.where("false")).count() == 0


@pytest.mark.parametrize("few", [0, 100_000])
def test_components_at_once_and_in_rounds(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW", few)
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(r.randrange(60), r.randrange(60)) for _ in range(40)]
    edges += [(7, 7), (500, 900), (900, 300), (-5, 900), (2 ** 62, 2 ** 62 + 1)] + [(1000, 1000 + k) for k in range(40)]
    r.shuffle(edges)
    root = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in range(200):
        for u, v in edges:
            if u != v:
                root[u] = root[v] = min(root[u], root[v])
    got = components.components(spark.createDataFrame(edges, "u bigint, v bigint").repartition(3)).collect()
    assert sorted(map(tuple, got)) == sorted(root.items())
    assert components.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_rows_that_stay_are_not_shuffled(spark):
    docs = spark.createDataFrame([(None if i % 40 == 0 else i % 900, f"t{i}") for i in range(4000)], SCHEMA)
    go = spark.createDataFrame([(i,) for i in range(3, 900, 90)] * 2, "_gone bigint")
    kept = jaccard.without(docs, go)
    assert kept.columns == docs.columns
    gone = set(range(3, 900, 90))
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(
        ((r.doc_id, r.text) for r in docs.collect() if r.doc_id not in gone), key=str)
    marked = jaccard._flagged(docs, go.withColumnRenamed("_gone", "doc_id"), ["doc_id"])
    assert marked.where("_maybe").count() < 400 and marked.where("doc_id = 93 AND NOT _maybe").count() == 0
