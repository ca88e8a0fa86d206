"""Language identification, ranked lexical search and the Merkle manifest
against plain versions on a small corpus of odd rows."""
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from shotsmith.llm import langid, lexical, merkle

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, rank string, path int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- op13 ----------------------------------------------------------------

def tree(nodes, n=3):
    """(root, siblings of every leaf as (left, right) pairs)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    level = list(nodes)
    while len(level) > 1:
        for i, p in enumerate(at):
            run = level[p // n * n: p // n * n + n]
            paths[i].append(("".join(run[: p % n]), "".join(run[p % n + 1:])))
        level = [sha("".join(level[p: p + n])) for p in range(0, len(level), n)]
        at = [p // n for p in at]
    return level[0], paths


def brute_manifest(rows):
    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(r, text):
        return sha(field(r[0]) + field(r[3]) + field(r[2]) + field(r[4]) + field(text))

    groups = defaultdict(list)
    for r in rows:
        spoiled = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
        other = r[1].replace("\n", "") if spoiled and r[1] is not None else r[1]
        groups[r[3]].append((r[0] is not None, r[0] or 0, leaf(r, r[1]), leaf(r, other), r[0]))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = [tree([x[2] for x in sorted(groups[s])]) for s in names]
    root, above = tree([t[0] for t in trees])
    out = []
    for s, (sub, paths), up in zip(names, trees, above):
        for x, path in zip(sorted(groups[s]), paths):
            acc = x[3]
            for left, right in path + up:
                acc = sha(left + acc + right)
            out.append((x[4], x[2], sub, root, sha("".join(a + b for a, b in path + up)), acc, acc == root))
    return out


def key(row):
    return tuple((x is not None, x) if not isinstance(x, bool) else x for x in row)


@pytest.mark.parametrize("sources, n", [(1, 1), (1, 10), (5, 31), (11, 200)])
def test_manifest_equals_the_plain_tree(spark, sources, n):
    r = random.Random(n)
    names = [None, "é", "z", "src1"] + [f"s{i}" for i in range(20)]
    rows = [(i * 7 - 50, r.choice(["a\nb", "", None, "x" * 5000 + "\n", "é\n"]), r.choice([None, "en"]),
             names[r.randrange(sources) if r.random() < 0.6 else 0], r.choice([None, 3]), "r", 1) for i in range(n)]
    rows += [(None, "t\n", None, names[0], 1, "r", 1), rows[0], (rows[0][0], "other", *rows[0][2:])]
    got = merkle.verify(spark.createDataFrame(rows, SCHEMA).repartition(4))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = [tuple(x) for x in got.collect()]
    assert sorted(got, key=key) == sorted(brute_manifest(rows), key=key)


def test_manifest_of_one_row_and_of_none(spark):
    one = [(5, "a", "en", "s", 1, "r", 1)]
    frame = spark.createDataFrame(one, SCHEMA)
    assert [tuple(x) for x in merkle.verify(frame).collect()] == brute_manifest(one)
    assert merkle.verify(frame.where("false")).collect() == []
    got = merkle.manifest(spark.createDataFrame([(1, "a\nb")], "doc_id bigint, text string")).first()
    assert got["leaf"] == sha("1:1---3:a\nb") == got["root"] and got["altered_leaf"] == got["leaf"]


# --- op12 ----------------------------------------------------------------

def plain_terms(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute_search(docs, items, k):
    """docs: (doc_id, text); items: (item_id, text)."""
    bags = [(d, Counter(plain_terms(t))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    n_docs, length = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    queries = defaultdict(Counter)
    for item, text in items:
        if item is not None:
            queries[item].update(plain_terms(text))
    for item, q in queries.items():
        scored = []
        for d, b in bags:
            m = 100 - 25 + 25 * sum(b.values()) * n_docs // length
            s = sum(c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    * (10 ** 9 * b[t] // (1000 * b[t] + 12 * m)) for t, c in q.items() if b[t])
            if s > 0:
                scored.append((-s, d is None, d))
        out += [(item, i + 1, d, -s) for i, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out)


def lexical_case(seed):
    r = random.Random(seed)
    vocabulary = ["the", "of", "x" * 45, "y" * 45, "über", "ÜBER", "A1"] + [f"w{i}" for i in range(60)]
    pick = lambda n: " ".join(vocabulary[min(int(r.expovariate(0.12)), 66)] for _ in range(n))
    docs = [(i, pick(r.randint(0, 60))) for i in range(150)]
    docs += [(200, None), (201, ""), (202, " \n--!"), (203, docs[3][1]), (2 ** 53 + 1, docs[3][1]),
             (-2 ** 63, docs[3][1]), (204, pick(4000)), (205, "a\x00b\x7fc the_of"), docs[7], docs[7]]
    items = [(i, pick(r.randint(1, 12))) for i in range(8)] + [
        (90, None), (91, "..."), (92, "nowhere"), (93, "w1 w1 W1 the"), (93, "x" * 45), (None, "the")]
    return docs, items


def test_search_equals_scoring_every_document(spark, monkeypatch):
    docs, items = lexical_case(1)
    docs += [(None, docs[3][1])]
    frame = spark.createDataFrame([(d, t, "s") for d, t in docs], "doc_id bigint, text string, score string").repartition(3)
    queries = spark.createDataFrame(items, "item_id bigint, text string")
    want = brute_search(docs, items, 20)
    run = lambda: sorted(map(tuple, lexical.search(frame, queries).collect()))
    assert run() == want
    # many shards (seeded by the first), several passes over the terms, several query blocks
    monkeypatch.setattr(lexical, "SHARD_DOCS", 20)
    monkeypatch.setattr(lexical, "TERMS", 9)
    monkeypatch.setattr(lexical, "QUERY_ROWS", 15)
    assert run() == want
    assert lexical.search(frame.where("false"), queries).collect() == []
    assert lexical.search(frame, queries.where("false")).collect() == []


def test_best_positions_stop_early(spark):
    """Reading stops before the lists end, and the result is the same."""
    r = np.random.default_rng(2)
    n, terms = 3000, 6
    start, ids, impact = [0], [], []
    for _ in range(n):
        own = np.flatnonzero(r.random(terms) < 0.6)
        ids.append(own)
        impact.append((r.random(len(own)) ** 6 * 1e6).astype(np.int64) + 1)
        start.append(start[-1] + len(own))
    ids, impact = np.concatenate(ids), np.concatenate(impact)
    shard = lexical.Shard(np.array(start), ids, impact, terms)
    coef = np.array([5, 3, 0, 8, 1, 2], np.int64)
    docs, score = shard.best(np.arange(terms), coef, 10, 0)
    every = np.array([int((coef[ids[a:b]] * impact[a:b]).sum()) for a, b in zip(start, start[1:])])
    want = np.lexsort((np.arange(n), -every))[:10]
    assert docs.tolist() == want.tolist() and score.tolist() == every[want].tolist()
    assert 0 < shard.read < shard.total / 2
    seeded, read = shard.best(np.arange(terms), coef, 10, int(every[want[-1]])), shard.read
    assert seeded[0].tolist() == want.tolist()


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 8), st.integers(0, 2 ** 32), st.integers(1, 5))
def test_equal_scores_stay_in_document_order(k, seed, values):
    r = np.random.default_rng(seed)
    n, terms = 60, 4
    rows = [np.flatnonzero(r.random(terms) < 0.5) for _ in range(n)]
    start = np.concatenate(([0], np.cumsum([len(x) for x in rows])))
    ids = np.concatenate(rows) if start[-1] else np.zeros(0, np.int64)
    impact = r.integers(1, values + 1, len(ids))
    coef = r.integers(0, 3, terms)
    shard = lexical.Shard(start, ids, impact, terms)
    docs, score = shard.best(np.arange(terms), coef, k, 0)
    every = [(-int((coef[ids[a:b]] * impact[a:b]).sum()), i) for i, (a, b) in enumerate(zip(start, start[1:]))]
    want = [(i, -s) for s, i in sorted(every) if s < 0][:k]
    got = [(int(i), int(s)) for i, s in zip(docs, score) if s > 0]
    assert got == want


def test_terms_in_slices(monkeypatch):
    text = ("Ab cd\x0bé_f " * 500).encode()
    whole = lexical.count_terms(text)
    monkeypatch.setattr(lexical, "SLICE", 7)
    assert lexical.count_terms(text) == whole
    assert whole[0] == len(plain_terms(text.decode()))


# --- op11 ----------------------------------------------------------------

@pytest.mark.parametrize("count", ["count_words", "count_grams"])
def test_counts_leave_a_task_in_bounded_batches(spark, monkeypatch, count):
    """A task holds about HELD counts, whatever an Arrow batch holds, and gives GIVE at a time."""
    import pyarrow as pa
    monkeypatch.setattr(langid, "HELD", 3000, raising=False)
    monkeypatch.setattr(langid, "GIVE", 100, raising=False)
    words = ["".join(chr(97 + int(c)) for c in f"{i:06d}") for i in range(6000)]

    class Caught(Exception):
        pass

    class Frame:
        def select(self, *_):
            return self

        def unionByName(self, *_):
            return self

        def mapInArrow(self, run, _):
            raise Caught(run)

    if count == "count_words":
        columns = [pa.array(["x"] * 60), pa.array([" ".join(words[i: i + 100]) for i in range(0, 6000, 100)])]
        want = Counter(words)
    else:
        columns = [pa.array(["x"] * 6000), pa.array(words), pa.array([2] * 6000)]
        want = Counter(g for w in words for n in range(1, 6) for i in range(9 - n) for g in [f" {w} "[i: i + n]]
                       if g != " ")
        want = {k: 2 * v for k, v in want.items()}
    with pytest.raises(Caught) as caught:
        getattr(langid, count)(Frame())
    got, largest = Counter(), 0
    for batch in caught.value.args[0]([pa.RecordBatch.from_arrays(columns, names=["lang", "key", "n"][: len(columns)])]):
        largest = max(largest, batch.num_rows)
        for key, n in zip(batch.column("key").to_pylist(), batch.column("n").to_pylist()):
            got[key] += n
    assert got == want and largest <= 100


def plain_words(text):
    out = []
    for run in re.findall(r"[^\W\d_]+", (text or "").lower()):
        for part in "".join(c if c.isalpha() else " " for c in run).split():
            out += [part[i: i + 40] for i in range(0, len(part), 40)]
    return out


def brute_languages(rows, texts):
    """The method in dictionaries, for a model that holds every count."""
    learned = [(lang, t) for i, t, lang in rows
               if i is not None and lang is not None and zlib.crc32(str(i).encode()) % 5]
    shares = Counter(lang for lang, _ in learned)
    langs = sorted(shares)
    counts = defaultdict(Counter)       # (level, lang) -> key -> n
    for lang, t in learned:
        for w in plain_words(t):
            counts[0, lang][w] += 1
            p = f" {w} "
            for g in range(1, 6):
                for i in range(len(p) - g + 1):
                    if p[i: i + g] != " ":
                        counts[g, lang][p[i: i + g]] += 1
    width = [max([len(counts[g, x]) for x in langs] + [1]) for g in range(6)]

    def value(g, lang, k):
        c = counts[g, lang]
        return math.log((c[k] + 0.1) / (sum(c.values()) + 0.1 * width[g]))

    def word(lang, w):
        if any(w in counts[0, x] for x in langs):
            return value(0, lang, w)
        p = f" {w} "
        for g in range(5, 0, -1):
            known = [p[i: i + g] for i in range(len(p) - g + 1) if any(p[i: i + g] in counts[g, x] for x in langs)]
            if known:
                return sum(value(g, lang, k) for k in known) / len(known)
        return 0.0

    out = []
    for t in texts:
        ws = plain_words(t)
        if not ws:
            out.append(("und", 0.0))
            continue
        total = [math.log(shares[x] / sum(shares.values())) + sum(word(x, w) for w in ws) for x in langs]
        at = max(range(len(langs)), key=lambda i: (total[i], -i))
        out.append((langs[at], 1 / sum(math.exp(v - total[at]) for v in total)))
    return out


def language_rows(seed=3, n=120):
    r = random.Random(seed)
    sounds = {"xx": ["ba", "ti", "lo"], "yy": ["ta", "lo", "né"], "zz": ["ß", "ung", "ti"]}
    rows = [(i, " ".join("".join(r.choice(sounds[lang]) for _ in range(r.randint(1, 3)))
                         for _ in range(r.randint(1, 15))), lang)
            for i in range(n) for lang in [r.choice(list(sounds))]]
    return rows + [(500, None, "xx"), (501, "", "yy"), (502, "12 _ --", None), (503, "日本語 Ⅷ²x", None),
                   (504, "É" * 100, "yy"), (None, "bati", "yy"), (505, "q", None), (506, "ba" * 3000, None), rows[0], rows[0]]


def test_languages_equal_the_plain_method(spark):
    rows = language_rows()
    docs = spark.createDataFrame([(i, t, x, "s") for i, t, x in rows], "doc_id bigint, text string, lang string, score string").repartition(3)
    model = langid.fit(docs)
    got = langid.predict(docs.drop("score").withColumnRenamed("lang", "was"), model).collect()
    assert len(got) == len(rows)
    want = dict(zip([t for _, t, _ in rows], brute_languages(rows, [t for _, t, _ in rows])))
    for g in got:
        lang, score = want[g["text"]]
        assert g["lang_pred"] == lang and 0 <= g["score"] <= 1 and abs(g["score"] - score) < 1e-6, g
    right = [g["lang_pred"] == g["was"] for g in got if g["doc_id"] is not None and g["doc_id"] < 120
             and zlib.crc32(str(g["doc_id"]).encode()) % 5 == 0]
    assert len(right) > 10 and sum(right) / len(right) > 0.9


def test_languages_without_training_rows(spark):
    docs = spark.createDataFrame([(1, "abc", None), (None, "abc", "xx")], "doc_id bigint, text string, lang string")
    assert {(r["lang_pred"], r["score"]) for r in langid.predict(docs, langid.fit(docs)).collect()} == {("und", 0.0)}
    none = docs.where("false")
    assert langid.predict(none, langid.fit(none)).collect() == []


def test_words_in_slices_and_a_full_cache(monkeypatch):
    text = "Aé bc Ⅷx " * 300
    whole = Counter(w for part in langid.word_lists(text) for w in part)
    monkeypatch.setattr(langid, "SLICE", 5)
    assert Counter(w for part in langid.word_lists(text) for w in part) == whole
    model = langid.Model(["a", "b"], np.array([0.5, 0.5]), [(0, "bc", 1, 3), (1, "x", 0, 2)], {(0, 1): (3, 1), (1, 0): (2, 1)})
    scorer = langid.Scorer(model)
    first = scorer.predict(text)
    scorer.limit = 2
    assert scorer.predict(text) == first == langid.Scorer(model).predict(text)
