"""Whole-text operators against brute force on a small corpus of odd rows."""
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from shotsmith.llm import bpe, jaccard, linededup, packing, quality, secretscan, substring

BPE, WORDS = P.path("byte_bpe_50k.tiktoken"), P.path("word_bpe_49k.json")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


# --- op1 -----------------------------------------------------------------

def check_substring(docs, size):
    rows = docs.select("doc_id", "text").collect()
    seen = Counter(tuple(w[i:i + size]) for r in rows for w in [words(r.text)] for i in range(len(w) - size + 1))
    expect = []
    for r in rows:
        w = words(r.text)
        keep = [True] * len(w)
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i:i + size])] > 1:
                keep[i:i + size] = [False] * size
        kept = " ".join(x for x, k in zip(w, keep) if k)
        expect.append((r.doc_id, len(w), len(w) - sum(keep), kept))
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring.remove_repeats(docs, size).collect()]
    assert sorted(got, key=repr) == sorted(expect, key=repr)
    return expect


@pytest.mark.parametrize("size,wide", [(35, 1000), (35, 1), (4, 2)])
def test_substring_dedup(corpus, monkeypatch, size, wide):
    monkeypatch.setattr(substring, "WIDE", wide)
    monkeypatch.setattr(substring, "SHARD", 40)
    expect = check_substring(corpus, size)
    assert any(0 < e[2] < e[1] for e in expect)


def test_substring_keeps_other_columns(corpus, no_rows):
    out = substring.remove_repeats(corpus)
    assert set(corpus.columns) | {"n_removed", "kept"} == set(out.columns)
    assert out.schema["n_words"].dataType.simpleString() == "bigint"     # a clashing name is replaced
    assert out.where("score <> array(1, 2)").count() == 0
    assert substring.remove_repeats(no_rows).count() == 0


@given(st.lists(st.lists(st.integers(0, 2), min_size=1, max_size=12), min_size=1, max_size=5), st.integers(1, 4))
@settings(max_examples=60, deadline=None)
def test_automaton_counts_repeats(seqs, size):
    auto = substring.Automaton()
    for s in seqs:
        auto.add(s, 1)
    auto.finish()
    seen = Counter(tuple(s[i:i + size]) for s in seqs for i in range(len(s) - size + 1))
    for s in seqs:
        got = {i for w, m in auto.repeated(s, size) for i in range(w, w + m)}
        assert got == {i for i in range(len(s) - size + 1) if seen[tuple(s[i:i + size])] > 1}


# --- op4 -----------------------------------------------------------------

def test_line_dedup(corpus, no_rows, monkeypatch):
    monkeypatch.setattr(linededup, "SHARD_KEYS", 3)
    monkeypatch.setattr(linededup, "PROBES", 2)
    rows = corpus.select("doc_id", "text").collect()
    where = defaultdict(set)
    for r in rows:
        if r.doc_id is not None:
            for x in (r.text or "").split("\n"):
                where[low(x.strip(" \t\n\x0b\x0c\r"))].add(r.doc_id)
    expect = []
    for r in rows:
        lines = (r.text or "").split("\n")
        kept = [x for x in lines for k in [low(x.strip(" \t\n\x0b\x0c\r"))]
                if r.doc_id is None or len(k) < 10 or len(where[k]) < 2 or r.doc_id == min(where[k])]
        expect.append((r.doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    out = linededup.drop_lines(corpus)
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in out.collect()]
    assert sorted(got, key=repr) == sorted(expect, key=repr) and any(e[2] for e in expect)
    assert out.columns[:len(corpus.columns)] == corpus.columns
    assert linededup.drop_lines(no_rows).count() == 0


@given(st.sets(st.integers(0, 2**64 - 1), max_size=300))
@settings(max_examples=30, deadline=None)
def test_perfect_hash_is_minimal_and_survives_storage(keys):
    keys = np.array(sorted(keys), np.uint64)
    index = linededup.PerfectHash.load(*linededup.PerfectHash.build(keys).dump())
    assert sorted(index.slot(keys).tolist()) == list(range(len(keys)))


# --- op5 -----------------------------------------------------------------

def test_packing_round_trip(corpus, no_rows):
    from tokenizers import Tokenizer
    model = Tokenizer.from_file(WORDS)
    rows = corpus.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    got = packing.pack_documents(rows, WORDS).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for r in rows.collect():
        ids = model.encode(r.text or "", add_special_tokens=False).ids + [0]
        pieces = sorted(by_doc[r.doc_id], key=lambda p: p.piece)
        assert [p.piece for p in pieces] == list(range(len(pieces)))
        for p, at in zip(pieces, range(0, len(ids), 2048), strict=True):
            part = ids[at:at + 2048]
            assert (p.start, p.length) == (at, len(part))
            assert p.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
    for seq in by_seq.values():
        at = 0
        for p in sorted(seq, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
    assert packing.pack_documents(no_rows, WORDS).count() == 0


@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
@settings(max_examples=80, deadline=None)
def test_bin_completion_is_optimal_on_small_groups(sizes):
    def fits(items, bins):
        if not items:
            return True
        for i in {b: i for i, b in enumerate(bins)}.values():
            if bins[i] >= items[0] and fits(items[1:], [b - items[0] * (j == i) for j, b in enumerate(bins)]):
                return True
        return False
    got = packing.complete(np.array(sizes), 20)
    assert sorted(x for b in got for x in b) == sorted(sizes) and max(map(sum, got)) <= 20
    assert packing.lower_bound(np.bincount(sizes, minlength=21), 20) <= len(got)
    best = next(n for n in range(1, 10) if fits(sorted(sizes, reverse=True), [20] * n))
    assert len(got) <= best + (best > 2)       # a group's node budget is finite


@given(st.lists(st.integers(1, 20), min_size=1, max_size=11))
@settings(max_examples=150, deadline=None)
def test_small_groups_get_the_optimum(sizes):
    def fits(items, bins):
        if not items:
            return True
        return any(b >= items[0] and fits(items[1:], bins[:i] + [b - items[0]] + bins[i + 1:])
                   for b, i in {b: i for i, b in enumerate(bins)}.items())
    best = next(n for n in range(1, 12) if fits(sorted(sizes, reverse=True), [20] * n))
    got = packing.complete(np.array(sizes), 20)
    assert sorted(x for b in got for x in b) == sorted(sizes) and max(map(sum, got)) <= 20
    assert len(got) == best


def test_bins_of_many_pieces():
    assert len(packing.complete(np.array([9, 8, 5, 4, 4, 4, 2, 2, 2]), 20)) == 2
    sizes = np.random.default_rng(1).integers(300, 379, 4092)
    got = packing.complete(sizes, 2048)
    assert sorted(x for b in got for x in b) == sorted(sizes.tolist()) and max(map(sum, got)) <= 2048
    assert len(got) == 682                     # no seven pieces share a bin: best-fit gives 733


def test_word_lookup_equals_the_tokenizer():
    import random
    r, tok = random.Random(1), packing.Tokens.of(WORDS)
    texts = ["".join(r.choice("abßÉK'st  \ṉ̈İ1.,日🎉\x1c\x85ǅH") for _ in range(30)) for _ in range(3000)]
    for t, got in zip(texts, tok.encode(texts)):
        assert np.frombuffer(got, "<u4").tolist() == tok.model.encode(t, add_special_tokens=False).ids


# --- op6 -----------------------------------------------------------------

def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scored = quality.classify(docs, quality.fit(docs, labels)).join(labels, "doc_id").where(quality.held_out())
    rows = scored.select("score", "quality").collect()
    assert len(rows) > 50
    assert sum((r.score >= 0.7) == (r.quality == 1) for r in rows) >= 0.95 * len(rows)


def test_quality_odd_rows(spark, corpus, no_rows):
    labels = spark.createDataFrame([(0, 1), (1, 0), (1, 1), (None, 1), (2, None), (3, 1)],
                                   "doc_id bigint, quality int")
    out = quality.classify(corpus, quality.fit(corpus, labels))
    assert out.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert out.count() == corpus.count()
    blank = quality.fit(no_rows, labels)
    assert quality.classify(no_rows, blank).count() == 0 and not blank.any()
    assert {r.score for r in quality.classify(corpus, blank).collect()} == {0.5}


# --- op8 -----------------------------------------------------------------

ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


ODD = ["password=abcdefgh", "x token: 'short' token: longenough1", "token: token: abcdefgh", "API_KEY = \"a.b/c=d-e_f\" end",
       "é🎉 secret=éabcdefghi AKIAABCDEFGHIJKL12", "AKIA", "AKIAAKIAAKIAAKI", "AKIAAKIAAKIAAKIA", "f" * 31, "0" * 32 + "g" + "a" * 40,
       "passwd", "ſecret=abcdefghij", "toKen=abcdefghij", "password=" + "0123456789abcdef" * 3 + " password='12345678",
       "kq7Zp2Xw9Lb4Vn8Tj3Rm6Yc1Hd5Gf0Sa", "thethethethethethethethethe the", None, ""]


def test_secret_base_spans(spark, corpus, no_rows):
    sf = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(ODD)], "doc_id bigint, text string")
    docs = corpus.select("doc_id", "text").unionByName(odd).unionByName(sf)
    rows = secretscan.scan(docs).select("doc_id", "base", "spans").collect()
    texts = defaultdict(list)
    for r in docs.collect():
        texts[r.doc_id].append(base_spans(r.text or ""))
    got = defaultdict(list)
    for r in rows:
        got[r.doc_id].append([tuple(s) for s in r.base])
        assert {tuple(s) for s in r.base} <= {tuple(s) for s in r.spans}
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in texts.items()}
    assert secretscan.scan(no_rows).count() == 0


def test_battery_tells_random_from_words(spark):
    import random
    import string
    r = random.Random(2)
    key = string.ascii_letters + string.digits
    texts = ["".join(r.choice("ertionhande") for _ in range(26)) for _ in range(400)]
    texts += ["".join(r.choice(key) for _ in range(40)) for _ in range(20)]
    texts += ["a1" * 16, "abcabcabcabcabcabcabc1", "1111111111111111111111222"]
    docs = spark.createDataFrame([(i, f"word {t} end") for i, t in enumerate(texts)], "doc_id bigint, text string")
    found = {r.doc_id for r in secretscan.scan(docs).collect() if any(s.kind == 3 for s in r.spans)}
    assert len(found & set(range(400, 420))) >= 14
    assert not found - set(range(400, 420))


def test_keys_are_found_without_long_words(spark):
    import random
    r = random.Random(4)
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    kinds = {"HEX": "0123456789ABCDEF", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base64": b64}
    rows = [(1000 * k + i, "".join(r.choice(a) for _ in range(24 if i % 2 else 40)))
            for k, a in enumerate(kinds.values()) for i in range(20)]
    plain = ["src/main/python/tests/core", "MAX_NUMBER_OF_ALL_RETRIES", "test_that_all_the_tests_test", "a1" * 16]
    rows += [(9000 + i, plain[i % 4] + "_" * (i // 4)) for i in range(20)]
    docs = spark.createDataFrame([(i, f"\u7801 is {x} so") for i, x in rows], "doc_id bigint, text string")
    found = {x.doc_id for x in secretscan.scan(docs).collect() if any(s.kind == 3 for s in x.spans)}
    for k in range(len(kinds)):
        assert len(found & set(range(1000 * k, 1000 * k + 20))) >= 17
    assert not [i for i in found if i >= 9000]
    key = docs.where("doc_id = 2001")          # alone in its table it is judged alike
    assert [s.kind for s in secretscan.scan(key).first().spans] == [3]


def test_secret_plan_is_native(spark, corpus):
    plan = secretscan.scan(corpus)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_mask_leaves_clean_texts(spark, corpus):
    docs = spark.createDataFrame([(1, "a password=abcdefgh1 b"), (2, "clean"), (None, "token=abcdefgh1"), (3, None)],
                                 "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in secretscan.mask(docs).collect()}
    assert got[1] == "a [SECRET] b" and got[2] == "clean" and got[3] is None
    assert secretscan.mask(corpus).columns == corpus.columns


def test_mask_cuts_each_row_by_its_own_spans(spark):
    rows = [(None, "token=abcdefgh1 z", "a"), (None, "all clean here", "b"), (7, "password=abcdefgh1 end", "c"),
            (7, "clean words, and clean words again", "d"), (7, "xx token: abcdefgh9", "e"), (None, None, "f")]
    got = secretscan.mask(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    assert sorted((r.source, r.doc_id, r.text) for r in got) == [
        ("a", None, "[SECRET] z"), ("b", None, "all clean here"), ("c", 7, "[SECRET] end"),
        ("d", 7, "clean words, and clean words again"), ("e", 7, "xx [SECRET]"), ("f", None, None)]


def mixed_text(r, n):
    """``n`` secrets of every kind, some overlapping, between words."""
    pick = [lambda: "".join(r.choice("0123456789abcdef") for _ in range(32)), lambda: "AKIA" + "AB12" * 4,
            lambda: "token=" + "".join(r.choice("abcXYZ019") for _ in range(9)), lambda: "\u7801\U0001f389",
            lambda: "password: " + "".join(r.choice("0123456789abcdef") for _ in range(40)),
            lambda: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(24))]
    return " ".join(r.choice(pick)() for _ in range(n))


def cut(text, spans, mark="[SECRET]"):
    out, at = [], 0
    for start, _, stop in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, stop)
    return "".join(out) + text[at:]


def test_spans_and_mask_of_many_matches(spark):
    import random
    import time
    r = random.Random(8)
    texts = [mixed_text(r, n) for n in (1, 2, 3, 5, 17, 64, 65, 1000)]
    texts += ["\ufefftoken=abcdefgh1\ufeff token=abcdefgh1", "token=abcdefgh1" * 40]
    texts.append(" ".join("%032x" % r.getrandbits(128) for _ in range(100_000)))      # 3.3 MB, one row
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    began = time.time()
    found = {x.doc_id: x for x in secretscan.scan(docs).collect()}
    masked = {x.doc_id: x.text for x in secretscan.mask(docs).collect()}
    assert time.time() - began < 120
    for i, text in enumerate(texts):
        base, spans = [tuple(s) for s in found[i].base], [tuple(s) for s in found[i].spans]
        assert base == base_spans(text) and [s for s in spans if s[1] < 3] == base and spans == sorted(spans)
        if len(base) < 2000:
            assert not [(s, b) for s in spans if s[1] == 3 for b in base if b[0] < s[2] and s[0] < b[2]]
        assert masked[i] == cut(text, spans)
    assert any(s.kind == 3 for s in found[7].spans)


# --- op9 -----------------------------------------------------------------

def tiktoken_model():
    import tiktoken
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(BPE), special_tokens={})


def test_byte_bpe_equals_tiktoken(corpus, no_rows):
    ref = tiktoken_model()
    ids = bpe.encode(corpus.where("doc_id IS NOT NULL"), BPE, P.PATTERN)
    texts = {r.doc_id: r.text or "" for r in corpus.collect()}
    back = bpe.decode(ids, BPE, P.PATTERN)
    for r in ids.collect():
        assert list(r.ids) == ref.encode_ordinary(texts[r.doc_id])
    for r in back.collect():
        assert bytes(r.decoded).decode() == texts[r.doc_id]
    got = {r.doc_id: r for r in bpe.digests(corpus, BPE, P.PATTERN).collect()}
    for i, t in texts.items():
        want = ref.encode_ordinary(t)
        assert got[i].n_tokens == len(want) and got[i].ids_sha256 == sha(" ".join(map(str, want)))
        assert got[i].decoded_sha256 == sha(t)
    assert bpe.digests(no_rows, BPE, P.PATTERN).count() == 0


@given(st.lists(st.text(alphabet="abtheinr \n\t \x1c\x85é日🎉1.,'s", max_size=40), max_size=20))
@settings(max_examples=60, deadline=None)
def test_replay_equals_tiktoken(texts):
    ref, enc = tiktoken_model(), bpe.Encoder.of(BPE, P.PATTERN)
    enc.known, enc.older = {}, {}
    assert [x.tolist() for x in enc.encode(texts)] == [ref.encode_ordinary(t) for t in texts]


def test_replay_when_a_new_pair_ranks_lower():
    ranks = {bytes([i]): 100 + i for i in range(256)} | {b"bc": 1000, b"ab": 1001, b"abc": 900, b"cd": 1002, b"ca": 999}
    merges = bpe.Merges(ranks)
    for many in (1, 10**9):
        bpe.MANY, old = many, bpe.MANY
        try:
            words_ = [b"abc", b"abab", b"abcabc", b"aabbcc", b"cabcab", b"abcd" * 9]
            got = [np.frombuffer(x, np.int32).tolist() for x in bpe.replay(words_, merges)]
        finally:
            bpe.MANY = old
        assert got == [bpe._replay_one(w, ranks) for w in words_]


# --- op10 ----------------------------------------------------------------

def brute_components(rows):
    sets = {}
    for r in rows:
        if r.doc_id is not None:
            w = words(low(r.text or ""))
            s = {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
            sets[r.doc_id] = s
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("small,block", [(48, 1024), (2, 3)])
def test_jaccard_join(corpus, no_rows, monkeypatch, small, block):
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = corpus
    expect = brute_components(rows.collect())
    found = jaccard.link_components(rows).collect()
    assert len(found) == rows.count()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in found if r.doc_id is not None}
    assert got == expect and len({c for _, c in expect.values()}) < len(expect) - 5
    if small == 48:
        kept = jaccard.keep_one(rows)
        assert kept.columns == rows.columns
        assert {r.doc_id for r in kept.collect()} == {c for _, c in expect.values()} | {None}
        assert jaccard.link_components(no_rows).count() == 0


def test_bitmap_bound_never_below_the_overlap():
    r = np.random.default_rng(0)
    for _ in range(50):
        a, b = (np.unique(r.integers(0, 90, r.integers(1, 60)).astype(np.uint64)) for _ in range(2))
        x, y = jaccard._bitmaps([a, b], 64)
        most = min(len(a) - int(np.bitwise_count(x & ~y).sum()), len(b) - int(np.bitwise_count(y & ~x).sum()))
        assert most >= len(np.intersect1d(a, b))
