"""N-gram Jaccard join over rows that repeat an id, whole or with other texts, and rows without one."""

import random

import pytest

from shotsmith.llm import jaccard

SCHEMA = "doc_id bigint, text string, n string"


def brute_rows(rows):
    """(doc_id, set size, component) of every row; rows of one id are linked if both hold words."""
    sets = []
    for key, text, *_ in rows:
        w = (text or "").lower().split()
        s = {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        sets.append(s)
    component = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if not a or not b or rows[i][0] is None or rows[j][0] is None:
                continue
            both = len(a & b)
            if rows[i][0] == rows[j][0] or 100 * both >= 75 * (len(a) + len(b) - both):
                old, new = component[i], component[j]
                component = [new if c == old else c for c in component]
    least = {}
    for (key, *_), c in zip(rows, component):
        if key is not None:
            least[c] = min(key, least.get(c, key))
    return sorted(((key, len(s), None if key is None else least[c])
                   for (key, *_), s, c in zip(rows, sets, component)), key=str)


def made(seed):
    r = random.Random(seed)
    words = ["w%d" % i for i in range(400)]
    texts = [" ".join(r.choice(words) for _ in range(60)) for _ in range(14)]

    def near(t):
        return " ".join(t.split()[:-3] + ["x%d" % r.randrange(99) for _ in range(3)])

    rows = [(1, texts[0]), (1, texts[1]), (2, near(texts[0])), (3, near(texts[1])),     # 1 joins 2 and 3
            (9, texts[2]), (9, texts[3]), (8, texts[3]), (7, near(texts[2])),           # 9 joins 7 and 8
            (2 ** 53 + 1, texts[4]), (2 ** 53 + 3, near(texts[4])), (-2 ** 63, texts[5]),
            (None, texts[0]), (None, texts[4]), (None, None), (None, ""),
            (20, None), (20, ""), (20, texts[6]), (21, "few words"), (22, "FEW  words"), (23, "")]
    rows += [(30, texts[7])] * 40                                       # one row very often
    rows += [(31, near(texts[8 + i % 3])) for i in range(30)]           # one id, many texts
    rows += [(40 + i, near(near(texts[11]))) for i in range(12)]
    r.shuffle(rows)
    return [(k, t, "x") for k, t in rows]


@pytest.mark.parametrize("small,block", [(48, 1024), (2, 3)])
def test_rows_against_brute_force(spark, monkeypatch, small, block):
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = made(small)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = jaccard.link_components(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute_rows(rows)
    three = {r["doc_id"]: r["component_id"] for r in got}
    assert three[3] == three[2] == three[1] and three[9] == three[8] == 7


def test_keep_one_keeps_rows_without_id(spark):
    rows = made(5)
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    firsts = {c for _, _, c in brute_rows(rows) if c is not None}
    ids = [r["doc_id"] for r in kept.collect()]
    assert set(ids) - {None} <= firsts and ids.count(None) == 4
    assert {c for k, n, c in brute_rows(rows) if n} - {None} <= set(ids)
