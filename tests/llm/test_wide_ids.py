"""64-bit ids beside nulls in one Arrow batch come back unchanged."""
import public_tokenizers as P

from shotsmith.llm import (
    bpe, chat, langid, lexical, linededup, merkle, packing, quality, secretscan, substring)

IDS = [None, 2 ** 53 + 1, 2 ** 53 + 3, -2 ** 63, 7]


def test_ids_of_every_document_operator(spark):
    docs = spark.createDataFrame([(i, f"a text of some words {k}", "en", "s", k) for k, i in enumerate(IDS)],
                                 "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(1)
    labels = spark.createDataFrame([(i, k % 2) for k, i in enumerate(IDS)], "doc_id bigint, quality int")
    items = spark.createDataFrame([(2 ** 53 + 1, "words"), (2 ** 53 + 3, "text")], "item_id bigint, text string")
    want = sorted(IDS, key=str)
    path, pattern = P.path("byte_bpe_50k.tiktoken"), P.PATTERN
    found = {
        "packing": packing.pack_documents(docs, P.path("word_bpe_49k.json")),
        "bpe": bpe.digests(docs, path, pattern),
        "lines": linededup.drop_lines(docs),
        "repeats": substring.remove_repeats(docs.select("doc_id", "text")),
        "quality": quality.classify(docs, quality.fit(docs, labels)),
        "secrets": secretscan.digests(docs.select("doc_id", "text")),
        "language": langid.predict(docs, langid.fit(docs)),
        "manifest": merkle.verify(docs),
    }
    for name, frame in found.items():
        assert sorted((r["doc_id"] for r in frame.collect()), key=str) == want, name
    got = lexical.search(docs.where("doc_id IS NULL OR doc_id > 9"), items).collect()
    assert {r["item_id"] for r in got} <= {2 ** 53 + 1, 2 ** 53 + 3}
    assert {r["doc_id"] for r in got} <= {None, 2 ** 53 + 1, 2 ** 53 + 3}


def test_ids_of_conversations(spark):
    rows = [(i, t, "user" if t == 0 else "assistant", f"{k} {t}") for k, i in enumerate(IDS) for t in (0, 1)]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").coalesce(1)
    got = chat.format_digests(frame).collect()
    assert sorted((r["conv_id"] for r in got), key=str) == sorted(IDS, key=str)
    assert {r["n_turns"] for r in got} == {2}
    segments = chat.format_segments(frame)
    assert {r["conv_id"] for r in segments.select("conv_id").distinct().collect()} == set(IDS)
