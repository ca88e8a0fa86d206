"""Task configuration: label spaces, instructions, feedback texts, input templates.

The strings below are fixed values: prompts must be byte-identical to the
ones the original pipeline builds, so they are stated here verbatim.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------
# Ordered label space per dataset; the order defines the score index.
LABEL_SPACE = {
    "tweet": ["negative", "neutral", "positive"],
    "fin": ["negative", "neutral", "positive"],
    "poem": ["negative", "positive", "neutral"],
    "sst2": ["negative", "positive"],
    "rest": ["negative", "neutral", "positive"],
    "laptop": ["negative", "neutral", "positive"],
    "twitter": ["negative", "neutral", "positive"],
    "tweet_emo": ["anger", "joy", "optimism", "sadness"],
    "emocontext": ["others", "happy", "sad", "angry"],
    "tweet_irony": ["non-irony", "irony"],
    "agnews": ["World", "Sports", "Business", "Technology"],
    "pstance": ["against", "favor"],
    "mnli": ["entailment", "neutral", "contradiction"],
}

# Feedback appended after a demonstration the prior model got wrong / right.
FEEDBACK = {
    "wrong": "You are wrong ! Make sure your prediction is accurate.\n\n",
    "correct": "You are correct ! Stay determined and keep moving forward.\n\n",
}

_SENTIMENT = "Recognize the sentiment of the sentence. Here are some examples:\n\n"
_ASPECT = ("Recognize the sentiment polarity for the given aspect term in the "
           "sentence. Here are some examples:\n\n")
_EMOTION = "Recognize the emotion of the sentence. Here are some examples:\n\n"

# Instruction that opens every prompt.
INSTRUCTION = {
    "poem": _SENTIMENT,
    "tweet": _SENTIMENT,
    "fin": _SENTIMENT,
    "sst2": _SENTIMENT,
    "rest": _ASPECT,
    "laptop": _ASPECT,
    "twitter": _ASPECT,
    "tweet_emo": _EMOTION,
    "emocontext": _EMOTION,
    "tweet_irony": ("Determine whether the sentence is ironic or not. Here are "
                    "some examples:\n\n"),
    "pstance": ("Recognize the stance of the sentence to the given target. "
                "Here are some examples:\n\n"),
    "mnli": ("Recognize textual entailment between the 2 texts. Here are some "
             "examples:\n\n"),
}

# Input template family per dataset.
SENTENCE_DATASETS = ["tweet", "sst2", "poem", "fin", "tweet_emo", "emocontext",
                     "tweet_irony"]
ASPECT_DATASETS = ["rest", "laptop", "twitter"]
STANCE_DATASETS = ["pstance"]
PAIR_DATASETS = ["mnli"]

# Input text of one row per template family ({column} is the row's value).
TEMPLATES = {
    "sentence": "Sentence: {sentence}\n",
    "aspect": "Sentence: {sentence} What is the sentiment polarity of the aspect {aspect} ?\n",
    "stance": "Sentence: {sentence} What is the attitude of sentence toward target {target} ?\n",
    "pair": "Premise: {text1}\nHypothesis: {text2}\n",
}

# Prompt layout words.
LABEL_PREFIX = "Label: "
PREDICTION_PREFIX = "Prediction: "
CORRECT_LABEL_PREFIX = "Correct Label: "
# --- end of fixed values ----------------------------------------------------


@dataclass(frozen=True)
class TaskConfig:
    dataset: str
    labels: tuple[str, ...]
    instruction: str
    template: str  # one of: sentence, aspect, stance, pair


def task_config(dataset: str) -> TaskConfig:
    """Label space, instruction and template family of a dataset."""
    if dataset not in LABEL_SPACE:
        raise ValueError(f"unknown dataset {dataset!r}")
    if dataset not in INSTRUCTION:
        raise ValueError(f"dataset {dataset!r} has no instruction text")
    if dataset in SENTENCE_DATASETS:
        family = "sentence"
    elif dataset in ASPECT_DATASETS:
        family = "aspect"
    elif dataset in STANCE_DATASETS:
        family = "stance"
    elif dataset in PAIR_DATASETS:
        family = "pair"
    else:
        raise ValueError(f"dataset {dataset!r} has no input template")
    return TaskConfig(dataset, tuple(LABEL_SPACE[dataset]), INSTRUCTION[dataset],
                      family)


def _text(c: str) -> Column:
    # An f-string renders a missing value as "nan"; keep that.
    return F.coalesce(F.col(c).cast("string"), F.lit("nan"))


def format_columns(pattern: str, prefix: str = "") -> Column:
    """``concat`` of the literal parts of ``pattern`` and its ``{column}``
    fields (read as text, missing -> "nan").  JVM-side, no UDF."""
    parts = []
    for i, piece in enumerate(re.split(r"\{(\w+)\}", pattern)):
        if i % 2:
            parts.append(_text(prefix + piece))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts)


def input_template(cfg: TaskConfig, prefix: str = "") -> Column:
    """P5: the per-row input text of the dataset's family, ending in a newline.

    ``prefix`` reads prefixed columns (e.g. ``"d_"`` reads ``d_sentence``).
    """
    return format_columns(TEMPLATES[cfg.template], prefix)


def label_space_table(spark: SparkSession) -> DataFrame:
    """Dimension table (dataset, label_pos, label): D10 as data."""
    rows = [(ds, i, lab) for ds, labs in LABEL_SPACE.items()
            for i, lab in enumerate(labs)]
    schema = T.StructType([
        T.StructField("dataset", T.StringType(), False),
        T.StructField("label_pos", T.IntegerType(), False),
        T.StructField("label", T.StringType(), False),
    ])
    return spark.createDataFrame(rows, schema)
