"""Registered queries of the training-data operators and their DuckDB SQL.

Each query applies its operator, with production parameters, to the whole
intended table; paths of the public tokenizers are parameters with defaults.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotsmith.llm import (
    ann, bpe, chat, covertree, jaccard, langid, lexical, linededup, merkle, packing, quality, secretscan, substring)
from shotsmith.llm.common import read


def _tokenizer(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return substring.remove_repeats(docs).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(planted).alias("text"))
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.format_digests(rows.unionByName(extra))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read(spark, sf_dir, "embeddings"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = linededup.drop_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped",
                      F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, read(spark, sf_dir, "labels"))
    return quality.classify(docs, model).select(
        "doc_id", quality.held_out().alias("held_out"), "score",
        F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.top_products(read(spark, sf_dir, "embeddings"))


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.digests(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return bpe.digests(read(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.tiktoken"),
                       public_tokenizers.PATTERN)


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_components(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return langid.predict(docs.select("doc_id", "text"), langid.fit(docs)).select(
        "doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_substring_dedup, op2_chat_formatting, op3_nearest_neighbours, op4_line_dedup, op5_best_fit_packing,
    op6_quality_classifier, op7_exact_top_k, op8_secret_scans, op9_byte_bpe, op10_ngram_jaccard, op11_language_id,
    op12_lexical_search, op13_merkle_manifest)}

_WS = r"[ \t\n\x0b\x0c\r]"

ORACLE = {
    "op7_exact_top_k": """
WITH v AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e
           FROM embeddings),
s AS (SELECT q.vec_id AS query_id, p.vec_id,
             CAST(list_sum([q.e[i] * p.e[i] FOR i IN range(1, len(q.e) + 1)]) AS BIGINT) AS score
      FROM v q JOIN v p ON q.vec_id <> p.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER)
             AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5""",
    "op4_line_dedup": rf"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (
  SELECT doc_id, pos, line, translate(regexp_replace(regexp_replace(line, '^{_WS}+', ''), '{_WS}+$', ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
many AS (SELECT k, min(doc_id) AS first FROM keyed WHERE length(k) >= 10
         GROUP BY k HAVING count(DISTINCT doc_id) > 1),
flag AS (SELECT y.doc_id, y.pos, y.line, m.k IS NOT NULL AND y.doc_id <> m.first AS gone
         FROM keyed y LEFT JOIN many m ON y.k = m.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM flag GROUP BY doc_id""",
    "op2_chat_formatting": r"""
WITH c AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
o AS (SELECT *, lag(role, 1, 'start') OVER w AS prev, lead(role) OVER w AS nxt FROM c
      WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(text) + length(regexp_replace(text, '[^\[<\\]', '', 'g'))
           + CASE role WHEN 'system' THEN 20 WHEN 'user' THEN 22 ELSE 20 END) AS BIGINT) AS formatted_chars,
       bool_and((prev, role) IN (('start','system'),('start','user'),('system','user'),('user','assistant'),
                ('assistant','user')) AND (nxt IS NOT NULL OR role = 'assistant')) AS valid
FROM o GROUP BY conv_id""",
    "op12_lexical_search": r"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
c AS (SELECT count(*) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS total FROM t WHERE len(terms) > 0),
q AS (SELECT item_id, term, count(*) AS times FROM (
        SELECT item_id, unnest(regexp_extract_all(
                 translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (
        SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM t) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2.0 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
      FROM p, c GROUP BY term),
s AS (SELECT q.item_id, p.r, p.doc_id, CAST(sum(q.times * w.w * ((1000000000 * p.tf) //
             (1000 * p.tf + 12 * (100 - 25 + (25 * p.n * n_docs) // total)))) AS BIGINT) AS score
      FROM q JOIN p ON p.term = q.term JOIN w ON w.term = q.term, c GROUP BY q.item_id, p.r, p.doc_id),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, r) AS place
      FROM s WHERE score > 0)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM k WHERE place <= 20""",
    "op13_merkle_manifest": r"""
WITH RECURSIVE
crc_table AS (
  SELECT list_transform(range(0, 256), lambda i: list_reduce(list_concat([i], range(0, 8)),
           lambda c, step: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (
  SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, source, lang, n_chars, text,
         CASE WHEN xor(list_reduce(list_concat([4294967295], list_transform(
                string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
                lambda c, b: xor(c >> 8, t[1 + xor(c, b) % 256])), 4294967295) % 2 = 0
              THEN replace(text, chr(10), '') ELSE text END AS other
  FROM documents, crc_table),
fields AS (
  SELECT r, doc_id, source,
         concat_ws('', coalesce(CAST(strlen(CAST(doc_id AS VARCHAR)) AS VARCHAR) || ':' || doc_id, '-'),
                   coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'),
                   coalesce(CAST(strlen(CAST(n_chars AS VARCHAR)) AS VARCHAR) || ':' || n_chars, '-')) AS head,
         coalesce(strlen(text) || ':' || text, '-') AS tail, coalesce(strlen(other) || ':' || other, '-') AS tail2
  FROM d),
leaves AS (
  SELECT r, doc_id, source, sha256(head || tail) AS leaf, sha256(head || tail2) AS leaf2,
         row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos,
         count(*) OVER (PARTITION BY source) AS size FROM fields),
low AS (
  SELECT 0 AS lev, source, pos, leaf AS node, size FROM leaves
  UNION ALL
  SELECT lev + 1, source, pos // 3, sha256(string_agg(node, '' ORDER BY pos)), CAST(max(size) + 2 AS BIGINT) // 3
  FROM low WHERE size > 1 GROUP BY lev, source, pos // 3),
runs AS (SELECT lev, source, pos // 3 AS parent, list(node ORDER BY pos) AS l FROM low WHERE size > 1
         GROUP BY lev, source, pos // 3),
subroots AS (SELECT source, node AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos,
                    count(*) OVER () AS size FROM low WHERE size = 1),
high AS (
  SELECT 0 AS lev, pos, subroot AS node, size FROM subroots
  UNION ALL
  SELECT lev + 1, pos // 3, sha256(string_agg(node, '' ORDER BY pos)), CAST(max(size) + 2 AS BIGINT) // 3
  FROM high WHERE size > 1 GROUP BY lev, pos // 3),
hruns AS (SELECT lev, pos // 3 AS parent, list(node ORDER BY pos) AS l FROM high WHERE size > 1
          GROUP BY lev, pos // 3),
climb AS (
  SELECT r, 0 AS lev, source, pos, leaf2 AS node, '' AS proof FROM leaves
  UNION ALL
  SELECT c.r, c.lev + 1, c.source, c.pos // 3,
         sha256(array_to_string(l[1:c.pos % 3], '') || c.node || array_to_string(l[c.pos % 3 + 2:], '')),
         c.proof || array_to_string(l[1:c.pos % 3], '') || array_to_string(l[c.pos % 3 + 2:], '')
  FROM climb c JOIN runs u ON u.lev = c.lev AND u.source IS NOT DISTINCT FROM c.source AND u.parent = c.pos // 3),
done AS (SELECT r, source, node, proof FROM climb QUALIFY lev = max(lev) OVER (PARTITION BY r)),
hclimb AS (
  SELECT x.r, 0 AS lev, s.pos, x.node, x.proof FROM done x JOIN subroots s ON s.source IS NOT DISTINCT FROM x.source
  UNION ALL
  SELECT c.r, c.lev + 1, c.pos // 3,
         sha256(array_to_string(l[1:c.pos % 3], '') || c.node || array_to_string(l[c.pos % 3 + 2:], '')),
         c.proof || array_to_string(l[1:c.pos % 3], '') || array_to_string(l[c.pos % 3 + 2:], '')
  FROM hclimb c JOIN hruns u ON u.lev = c.lev AND u.parent = c.pos // 3),
top AS (SELECT r, node, proof FROM hclimb QUALIFY lev = max(lev) OVER (PARTITION BY r)),
root AS (SELECT node AS root FROM high WHERE size = 1)
SELECT v.doc_id, v.leaf, s.subroot, root.root, sha256(top.proof) AS proof_sha256, top.node AS folded_root,
       top.node = root.root AS verified
FROM leaves v JOIN top ON top.r = v.r JOIN subroots s ON s.source IS NOT DISTINCT FROM v.source, root""",
}
