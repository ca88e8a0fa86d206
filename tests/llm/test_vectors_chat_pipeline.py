import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from shotsmith.llm import ann, chat, components, covertree

NAN, INF = float("nan"), float("inf")


def vector_rows(n=700, dim=12, seed=3):
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, dim)).round(2)
    x[100:140] = x[99]                       # many equal vectors: ties
    rows = [(i, [float(v) for v in a], "e") for i, a in enumerate(x)]
    odd = [(None, [1.0] * dim, "e"), (5000, None, "e"), (5050, [None] + [1.0] * (dim - 1), "e"),
           (5100, [NAN] * dim, "e"), (5150, [INF] * dim, "e"), (5200, [1.0] * 3, "e"), (5201, [2.0] * 3, "e"),
           (5300, [0.0] * dim, "e"), (7, rows[7][1], "e")]
    return rows + odd


def usable(rows, zero):
    return {i: np.array(v) for i, v, _ in rows if i is not None and v is not None and None not in v
            and np.isfinite(v).all() and (zero or any(v))}


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame(vector_rows(), "vec_id bigint, embedding array<double>, score string").repartition(4)


def test_neighbours_recall_and_scores(spark, vectors):
    have = usable(vector_rows(), False)
    got = {}
    for r in ann.nearest(vectors, 50, 10).collect():
        got.setdefault(r.query_id, []).append(r)
    assert set(got) == {i for i in have if i % 50 == 0}
    hit = total = 0
    for q, rows in got.items():
        rows.sort(key=lambda r: r["rank"])
        true = sorted((float(np.sqrt(((have[q] - v) ** 2).sum())), i) for i, v in have.items()
                      if i != q and len(v) == len(have[q]))[:10]
        assert [r["rank"] for r in rows] == list(range(1, len(true) + 1))
        assert [(r.score, r.vec_id) for r in rows] == sorted((r.score, r.vec_id) for r in rows)
        assert all(abs(r.score - np.sqrt(((have[q] - have[r.vec_id]) ** 2).sum())) < 1e-12 for r in rows)
        hit += len({round(r.score, 9) for r in rows} & {round(d, 9) for d, _ in true})
        total += len({round(d, 9) for d, _ in true})
    assert hit >= 0.9 * total
    assert ann.nearest(vectors.limit(0)).count() == 0


def test_top_products_are_exact(spark, vectors):
    have = {i: np.floor(256 * v).astype(int) for i, v in usable(vector_rows(), True).items()}
    got = {}
    for r in covertree.top_products(vectors, 20, 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for q in (i for i in have if i % 20 == 0):
        true = sorted((-int(have[q] @ v), i) for i, v in have.items() if i != q and len(v) == len(have[q]))[:5]
        assert sorted(got.get(q, [])) == [(k + 1, i, -s) for k, (s, i) in enumerate(true)]
    assert covertree.top_products(vectors.limit(0)).count() == 0


def test_empty_vectors(spark):
    """Only null or non-finite ones stay out: without components products are 0."""
    rows = [(i, [], "e") for i in (0, 3, 50, 51, 60, 70, 71)] + [(100, [1.0], "e"), (101, [2.0], "e")]
    docs = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, score string")
    got = sorted(map(tuple, covertree.top_products(docs, 50, 5).collect()))
    assert got == ([(0, k + 1, i, 0) for k, i in enumerate((3, 50, 51, 60, 70))]
                   + [(50, k + 1, i, 0) for k, i in enumerate((0, 3, 51, 60, 70))] + [(100, 1, 101, 256 * 512)])
    assert [tuple(r) for r in ann.nearest(docs, 100, 5).collect()] == [(100, 1, 101, 1.0)]


def test_neighbours_of_very_large_and_small_vectors(spark):
    rows = [(0, [1e308, 1e308]), (1, [-1e308, 0.0]), (2, [9e307, 1e308]), (3, [1e-200, 0.0]), (100, [3e-200, 0.0]),
            (4, [1.0, 2.0]), (200, [1.0, 2.5])]
    docs = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {}
    for r in sorted(ann.nearest(docs, 100, 3).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got[0][0] == (2, pytest.approx(1e307)) and len(got[0]) == 3
    assert got[100][0] == (3, pytest.approx(2e-200)) and got[200][0] == (4, 0.5)
    assert np.array_equal(ann.distances(np.array([[3.0, 4.0]]), np.array([[0.0, 0.0]])), [5.0])


@pytest.mark.parametrize("size", [1.0, 1e-320, 1e300])
def test_true_distances_only_near_the_best(monkeypatch, size):
    """Vectors without clusters collide nearly everywhere; the true distance is taken of
    the few pairs that a bound leaves open.  Scores are true distances, in order."""
    r = np.random.default_rng(4)
    points = r.standard_normal((1500, 16)) * size
    done = []
    true = ann.distances
    monkeypatch.setattr(ann, "distances", lambda a, b: done.append(len(a)) or true(a, b))
    got = ann.Index(points, ann.unit(points)).query(points[:100], 5, np.arange(100))
    assert size < 1e-300 or sum(done) < 0.05 * 100 * len(points)
    found = 0
    for q, (rows, dist) in enumerate(got):
        d = true(points, np.repeat(points[q:q + 1], 1500, axis=0))
        assert np.array_equal(dist, d[rows]) and q not in rows
        assert list(zip(dist, rows)) == sorted(zip(dist, rows)) and len(rows) == 5
        d[q] = np.inf
        found += (dist <= np.sort(d)[4]).sum()
    assert found >= 0.9 * 500


def test_dual_tree_prunes_clusters():
    r = np.random.default_rng(0)
    centres = r.standard_normal((20, 8)) * 400
    points = np.floor(np.concatenate([c + r.standard_normal((100, 8)) for c in centres])).astype(np.int64)
    run = covertree.Search(points[:64], points, np.arange(2000), np.arange(64), 3)
    seen = []
    own = run._leaves
    run._leaves = lambda lo, hi, leaves: (seen.extend(run.p.hi[n] - run.p.lo[n] for n in leaves), own(lo, hi, leaves))
    found = run.run()
    assert sum(seen) < 2000
    for place, (ids, score) in enumerate(found):
        q = run.q.order[place]
        s = points @ points[q]
        s[q] = -10**12
        assert ids.tolist() == np.lexsort((np.arange(2000), -s))[:3].tolist()


# --- chat ----------------------------------------------------------------

TEXTS = ["hi", "", None, "</s>[INST] ok [/INST]", "a\\b\\[c\\\\", "<s>[ANS] x [/ANS]</s>", " lead and trail ", "[=]<", "é🎉\n"]


@pytest.fixture(scope="module")
def talks(spark):
    rows = []
    for c in range(12):
        for t in range(2 * (c % 4) + 2):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", TEXTS[(c + t) % len(TEXTS)], 1))
    rows += [(20, 0, "system", "s", 1), (20, 1, "user", "u", 1), (20, 2, "assistant", "a", 1),
             (21, 0, "assistant", "first", 1), (22, 0, "user", "no answer", 1), (23, 0, "tool", "[x", 1),
             (24, 0, None, "nobody", 1), (25, None, "user", "b", 1), (25, None, "user", "a", 1),
             (None, 0, "user", "u", 1), (None, 1, "assistant", "a", 1), (26, 3, "user", "z", 1), (26, 3, "user", "z", 1)]
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, loss int").repartition(3)


def test_chat_read_back(talks):
    by = {}
    for r in talks.collect():
        by.setdefault(r.conv_id, []).append(r)
    got = {r.conv_id: r for r in chat.format_digests(talks).collect()}
    assert set(got) == set(by)
    template = chat.Template()
    for c, rows in by.items():
        rows.sort(key=lambda r: (r.turn is not None, r.turn or 0, r.role is not None, r.role or "", r.text is not None, r.text or ""))
        turns = "".join(f"{r.role or ''}\n{r.text or ''}\n" for r in rows)
        loss = "".join(r.text or "" for r in rows if r.role == "assistant")
        out = "".join(p for r in rows for p, _ in template.segments(r.role, r.text))
        assert got[c].n_turns == len(rows) and got[c].formatted_chars == len(out)
        assert got[c].turns_sha256 == hashlib.sha256(turns.encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[20].valid and got[0].valid
    assert not any(got[c].valid for c in (21, 22, 23, 24, 25, 26))


def test_chat_segments_rebuild_the_output(talks):
    got = chat.format_segments(talks).where("conv_id = 3").orderBy("turn_no", "seg_no").collect()
    out = "".join(r.text for r in got)
    reader, at, back = chat.Reader(chat.Template()), 0, []
    while at < len(out):
        name, _, text, at = reader.turn(out, at)
        back.append((name, text))
    want = [(r.role, r.text or "") for r in talks.where("conv_id = 3").orderBy("turn").collect()]
    assert back == want
    assert chat.format_digests(talks.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (102, 100), (200, 200), (7, 6)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[102] == 100 and got[100] == 100


# --- registration and pipeline -------------------------------------------

def test_every_operator_is_registered():
    names = list(E.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names


def test_pipeline_stages(spark, corpus):
    import corpus_pipeline as C
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(None, None, "en", "s", None), (900001, "", "en", "s", 0)], docs.schema)
    now, seen = docs.unionByName(odd), {}
    for name, stage in C.STAGES:
        now = C.write_once(stage(spark, now, sf), name)
        seen[name] = now
        if name != "best_fit_packing":
            assert now.columns == list(C.COLUMNS)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = seen["quality_classifier"].join(labels, "doc_id").select("quality")
    good = labels.where("quality = 1").count()
    assert kept.where("quality = 1").count() >= 0.97 * good
    assert kept.where("quality = 0").count() <= 0.1 * labels.where("quality = 0").count()
    lines = seen["line_dedup"].where("doc_id IS NOT NULL")
    assert (lines.select("doc_id", F.explode(F.split("text", "\n")).alias("x"))
            .where(F.length(F.trim("x")) >= 12).select("doc_id", F.translate(F.trim("x"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("k")).distinct()
            .groupBy("k").count().where("count > 1").count()) == 0
    from test_text_operators import brute_components
    firsts = {c for _, c in brute_components(lines.collect()).values()}
    assert {r.doc_id for r in seen["ngram_jaccard_join"].collect()} - {None} == firsts
    assert seen["secret_scans"].where(F.col("text").rlike("AKIA[A-Z0-9]{12}")).count() == 0
    pieces = seen["best_fit_packing"]
    assert pieces.where("doc_id IS NOT NULL").select("doc_id").distinct().count() == \
        seen["secret_scans"].where("doc_id IS NOT NULL").select("doc_id").distinct().count()
    assert pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
