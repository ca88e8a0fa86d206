"""Oracle SQL (DuckDB dialect) for the registered queries.

Each query is written independently of the Spark code, straight from the
definitions: whole tables, brute force where that is simplest (e.g. the full
BM25 score matrix), so it checks the Spark plans' shortcuts.
"""

from __future__ import annotations

from shotsmith.functions.hashing import sql_seeded_hash
from shotsmith.functions.permutation import sql_grid, sql_permuted
from shotsmith.functions.templates import FEEDBACK, task_config
from shotsmith.sources.tables import DATASET, SQL_POOL, SQL_QUERIES

CFG = task_config(DATASET)


def lit(s: str) -> str:
    """A SQL string literal with real newlines (E'' strings are not needed
    in DuckDB: chr(10) concatenation keeps it portable)."""
    parts = s.split("\n")
    quoted = ["'" + p.replace("'", "''") + "'" for p in parts]
    return " || chr(10) || ".join(quoted) if len(parts) > 1 else quoted[0]


def template(alias: str) -> str:
    return f"'Sentence: ' || coalesce({alias}.sentence, 'nan') || chr(10)"


BM25_CTES = f"""
pool AS ({SQL_POOL}),
q AS ({SQL_QUERIES}),
pdocs AS (SELECT cand_id, string_split(coalesce(sentence, 'nan'), ' ') AS toks FROM pool),
ptok AS (SELECT cand_id, len(toks) AS dl, unnest(toks) AS token FROM pdocs),
post AS (SELECT cand_id, dl, token, count(*) AS tf FROM ptok GROUP BY cand_id, dl, token),
st AS (SELECT count(*) AS n, CAST(sum(len(toks)) AS DOUBLE) / count(*) AS avgdl FROM pdocs),
voc AS (SELECT token, count(*) AS df FROM post GROUP BY token),
vidf AS (SELECT token, df,
                ln(CAST(st.n AS DOUBLE) - CAST(df AS DOUBLE) + 0.5)
                - ln(CAST(df AS DOUBLE) + 0.5) AS raw
         FROM voc, st),
fl AS (SELECT count(*) AS vocab,
              CAST(sum(CAST(raw AS DECIMAL(18,10))) AS DOUBLE) / count(*) AS mean_idf,
              CAST(0.25 * (CAST(sum(CAST(raw AS DECIMAL(18,10))) AS DOUBLE) / count(*))
                   AS DECIMAL(18,10)) AS floor_idf
       FROM vidf),
idf AS (SELECT token, df, raw,
               CASE WHEN raw < 0 THEN fl.floor_idf ELSE CAST(raw AS DECIMAL(18,10)) END AS idf
        FROM vidf, fl),
qt AS (SELECT query_id, token, count(*) AS qtf
       FROM (SELECT query_id, unnest(string_split(coalesce(sentence, 'nan'), ' ')) AS token FROM q)
       GROUP BY query_id, token),
matched AS (
  SELECT qt.query_id, post.cand_id,
         sum(qt.qtf * CAST(CAST(idf.idf AS DOUBLE)
             * (CAST(post.tf AS DOUBLE) * 2.5
                / (CAST(post.tf AS DOUBLE)
                   + 1.5 * (1.0 - 0.75 + 0.75 * CAST(post.dl AS DOUBLE) / st.avgdl)))
             AS DECIMAL(18,10))) AS score
  FROM qt JOIN idf ON qt.token = idf.token JOIN post ON post.token = qt.token, st
  GROUP BY qt.query_id, post.cand_id),
allpairs AS (
  SELECT q.query_id, pool.cand_id,
         pool.label = pool.prediction AS is_correct,
         CAST(coalesce(m.score, 0) AS DOUBLE) AS score
  FROM q CROSS JOIN pool
  LEFT JOIN matched m ON m.query_id = q.query_id AND m.cand_id = pool.cand_id),
bm25 AS (
  SELECT query_id, cand_id, is_correct, score,
         CAST(row_number() OVER (PARTITION BY query_id
                                 ORDER BY score DESC, cand_id DESC) AS INTEGER) AS rank,
         CAST(row_number() OVER (PARTITION BY query_id, is_correct
                                 ORDER BY score DESC, cand_id DESC) AS INTEGER) AS class_rank
  FROM allpairs)
"""


def with_bm25(body: str) -> str:
    return "WITH " + BM25_CTES.strip() + "\n" + body


def quota_sql(n: int, wrong: int) -> str:
    n_wrong, n_right = min(n, wrong), max(0, n - wrong)
    return f"""
picked AS (
  SELECT query_id, cand_id, is_correct, class_rank FROM bm25
  WHERE (NOT is_correct AND class_rank <= {n_wrong})
     OR (is_correct AND class_rank <= {n_right})),
quota AS (
  SELECT query_id,
         CAST(CASE WHEN NOT is_correct THEN class_rank
              ELSE class_rank + sum(CASE WHEN NOT is_correct THEN 1 ELSE 0 END)
                                OVER (PARTITION BY query_id) END AS INTEGER) AS pos,
         cand_id, is_correct
  FROM picked)"""


def prompt_sql(sel_cte: str, method: str, template=template, cfg=CFG) -> str:
    """Prompts for every query from a (query_id, pos, cand_id) CTE named sel;
    ``template(alias)`` is the SQL of one row's input text."""
    if method == "feedback":
        block = (f"{template('p')} || 'Prediction: ' || "
                 "CASE WHEN p.label = p.prediction THEN p.label ELSE p.prediction END"
                 " || chr(10) || 'Correct Label: ' || p.label || chr(10) || "
                 f"CASE WHEN p.label = p.prediction THEN {lit(FEEDBACK['correct'])} "
                 f"ELSE {lit(FEEDBACK['wrong'])} END")
        tail = "'Correct Label: '"
    else:
        block = f"{template('p')} || 'Label: ' || p.label || chr(10) || chr(10)"
        tail = "'Label: '"
    return f""",
{sel_cte},
blocks AS (SELECT s.query_id, s.pos, {block} AS block
           FROM sel s JOIN pool p ON p.cand_id = s.cand_id),
demo AS (SELECT query_id, string_agg(block, '' ORDER BY pos) AS demo_text
         FROM blocks GROUP BY query_id)
SELECT q.query_id,
       {lit(cfg.instruction)} || coalesce(d.demo_text, '') || {template('q')} || {tail}
         AS prompt,
       coalesce(q.label, 'nan') AS label
FROM q LEFT JOIN demo d ON d.query_id = q.query_id"""


def seeded(seed: int, *parts: str) -> str:
    return sql_seeded_hash(seed, *parts)


def decode_sql(scores: str, labels, row_id: str, seed: int = 123) -> str:
    """M7 in SQL: first maximum; all equal -> 'others' or md5 seeded label."""
    arr = "[" + ", ".join(lit(x) for x in labels) + "]"
    if "others" in labels:
        oi = list(labels).index("others")
        tie = (f"(CASE WHEN {scores}[1] < 1.0 THEN {oi} WHEN {scores}[1] > 1.0 "
               f"THEN {0 if oi != 0 else 1} ELSE 0 END)")
    else:
        tie = f"({seeded(seed, row_id)} % {len(labels)})"
    return (f"({arr})[1 + CASE WHEN list_max({scores}) = list_min({scores}) THEN {tie} "
            f"ELSE list_position({scores}, list_max({scores})) - 1 END]")


def vote_sql(prompt: str, labels) -> str:
    parts = []
    for lab in labels:
        nd = lit(f"Label: {lab}\n")
        parts.append(f"CAST(floor((length({prompt}) - length(replace({prompt}, {nd}, ''))) "
                     f"/ length({nd})) AS DOUBLE)")
    return "[" + ", ".join(parts) + "]"


def draws_sql(rows_cte: str, key: str, n_expr: str, m: int, seed: int, exclude_self: bool) -> str:
    """The first m places of each row's seeded permutation of the pool positions,
    one more where the row itself is left out (CTE bodies)."""
    self_cond = f"WHERE pp.cand_id <> d.{key}" if exclude_self else ""
    return f"""
pp AS (SELECT cand_id, row_number() OVER (ORDER BY cand_id) - 1 AS pos FROM pool),
nn AS ({sql_grid(f"SELECT {n_expr} AS n")}),
draws AS (SELECT r.{key}, t.i, {sql_permuted('t.i', 'nn.n', 'nn.a', 'nn.b', seed, 'r.' + key)} AS pos
          FROM {rows_cte} r, range(0, {m + exclude_self}) t(i), nn WHERE t.i < nn.n),
drawn AS (SELECT d.{key}, pp.cand_id,
                 CAST(row_number() OVER (PARTITION BY d.{key} ORDER BY d.i) AS INTEGER) AS draw_rank
          FROM draws d JOIN pp ON pp.pos = d.pos {self_cond})"""
