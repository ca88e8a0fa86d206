"""Prompt assembly -- ordered string aggregation per query.

Layouts (every prompt starts with the task instruction):

* prior / baseline: per demonstration ``template + "Label: " + label + "\\n\\n"``,
  tail ``template + "Label: "``.
* feedback: per demonstration ``template + "Prediction: " + shown + "\\n" +
  "Correct Label: " + label + "\\n" + feedback text`` (``shown`` is the prior
  prediction when it was wrong, the label otherwise), tail
  ``template + "Correct Label: "``.

Demonstration text joins the selection after top-k (J3), so only n rows per
query carry text.  Each query's group holds at most n blocks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotsmith.functions.labels import is_correct
from shotsmith.functions.templates import (CORRECT_LABEL_PREFIX, FEEDBACK, LABEL_PREFIX,
                                           PREDICTION_PREFIX, TaskConfig, input_template)
from shotsmith.functions.text import as_text
from shotsmith.session import BROADCAST_ROW_LIMIT

METHODS = ("prior", "baseline", "feedback")


def demo_blocks(demos: DataFrame, pool: DataFrame, cfg: TaskConfig, method: str,
                feedback: dict[str, str] = FEEDBACK,
                max_rows: int | None = None,
                template: Callable[[TaskConfig], Column] | None = None) -> DataFrame:
    """(query_id, pos, block) for selected demonstrations (query_id, pos, cand_id).

    ``max_rows`` bounds the selection's size (queries x n) without running
    it; without it the selection is counted first.  ``template`` (U1) replaces
    the dataset's input template: a function of the task config returning a
    Column over the row's columns (no UDF involved).
    """
    template = template or input_template
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    sel = demos.select("query_id", "pos", "cand_id")
    if max_rows is None:
        max_rows = sel.limit(BROADCAST_ROW_LIMIT + 1).count()
    if max_rows <= BROADCAST_ROW_LIMIT:
        rows = pool.join(F.broadcast(sel), "cand_id")   # stream the pool once
    else:
        rows = sel.join(pool, "cand_id")               # AQE splits hot ids
    label = as_text("label")
    if method in ("prior", "baseline"):
        block = F.concat(template(cfg), F.lit(LABEL_PREFIX), label, F.lit("\n\n"))
    else:
        right = is_correct("label", "prediction")
        shown = F.when(right, label).otherwise(as_text("prediction"))
        block = F.concat(template(cfg), F.lit(PREDICTION_PREFIX), shown, F.lit("\n"),
                         F.lit(CORRECT_LABEL_PREFIX), label, F.lit("\n"),
                         F.when(right, F.lit(feedback["correct"]))
                          .otherwise(F.lit(feedback["wrong"])))
    return rows.select("query_id", "pos", block.alias("block"))


def assemble_prompts(queries: DataFrame, demos: DataFrame, pool: DataFrame,
                     cfg: TaskConfig, method: str, feedback: dict[str, str] = FEEDBACK,
                     n: int | None = None,
                     template: Callable[[TaskConfig], Column] | None = None) -> DataFrame:
    """(query_id, prompt, label) for every query; no demonstrations -> bare prompt.

    ``n``: at most n demonstrations per query (bounds the selection by
    queries x n, counted on the cheap query table).
    """
    max_rows = None if n is None else queries.count() * n
    template = template or input_template
    blocks = demo_blocks(demos, pool, cfg, method, feedback, max_rows, template)
    joined = (blocks.groupBy("query_id")
              .agg(F.array_join(
                  F.transform(F.array_sort(F.collect_list(F.struct("pos", "block"))),
                              lambda s: s["block"]), "").alias("demo_text")))
    tail = F.lit(CORRECT_LABEL_PREFIX if method == "feedback" else LABEL_PREFIX)
    return (queries.join(joined, "query_id", "left")
            .select("query_id",
                    F.concat(F.lit(cfg.instruction), F.coalesce("demo_text", F.lit("")),
                             template(cfg), tail).alias("prompt"),
                    as_text("label").alias("label")))
