"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors: one per hashed word, per hashed
word pair and per hashed character n-gram (over the bytes, spaces included).
A softmax layer over the average gives the two class probabilities.  Vectors
and output layer are trained together by stochastic gradient descent in numpy.

Training reads a bounded sample of labelled rows (``TRAIN_ROWS``, smallest
hashed ids first; held-out rows never), gathered in one task.  Scoring is one
pass over all documents, whole texts: because the output layer is linear, each
bucket's vector is folded into one number first, and a document's score is the
average of its buckets' numbers.  The model sent to the tasks has a fixed size
(``BUCKETS`` floats).

A word pair of twice the same word goes to one shared bucket, so repetition is
learned whatever the word.  Null and empty texts have no features; they get the
score of the output bias alone.  Label, language, source and id are no inputs.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotsmith.llm.common import by_chars, mix, with_columns, word_spans

TRAIN_ROWS = 3000
BITS = 17
BUCKETS = 1 << BITS
GRAMS = (2, 3, 4)
DIM = 8
EPOCHS = 6
LEAST_STEPS = 6000     # small samples are passed more often
RATE = 0.5
VECTOR_RATE = 60.0     # the average divides a vector's gradient by thousands of features
SAME = np.uint64(1)    # key of the bucket of repeated words
SHIFT = np.uint64(64 - BITS)


def _bucket(h: np.ndarray) -> np.ndarray:
    return ((h * np.uint64(0x9E3779B97F4A7C15)) >> SHIFT).astype(np.int32)


def features(raw: bytes) -> list[np.ndarray]:
    """Bucket ids of a text: words, word pairs, byte n-grams."""
    data = np.frombuffer(raw, np.uint8)
    out = []
    _, _, words = word_spans(raw)
    if len(words):
        out.append(_bucket(words))
    if len(words) > 1:
        pair = mix(words[:-1] * np.uint64(3) + words[1:])
        pair[words[:-1] == words[1:]] = SAME
        out.append(_bucket(pair))
    acc = np.zeros(len(data), np.uint64)
    wide = data.astype(np.uint64) + np.uint64(1)
    n = 0
    for size in GRAMS:
        while n < size:
            acc = acc[: max(0, len(data) - n)] * np.uint64(0x100000001B3) + wide[n:]
            n += 1
        if len(acc):
            out.append(_bucket(acc + np.uint64(size << 56)))
    return out


def train(texts: list[str | None], labels: np.ndarray, seed: int = 0) -> np.ndarray:
    """The folded model: BUCKETS + 1 floats (value of each bucket, bias)."""
    rng = np.random.default_rng(seed)
    docs = []
    for t in texts:
        got = features((t or "").encode())
        flat = np.concatenate(got) if got else np.zeros(0, np.int32)
        ids, n = np.unique(flat, return_counts=True)
        docs.append((ids.astype(np.int32), (n / max(1, len(flat))).astype(np.float32)))
    vec = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out = rng.uniform(-0.1, 0.1, (2, DIM)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    epochs = max(EPOCHS, -(-LEAST_STEPS // max(1, len(docs))))
    steps, k = epochs * max(1, len(docs)), 0
    for _ in range(epochs if docs else 0):
        for i in rng.permutation(len(docs)):
            rate = RATE * (1 - k / steps)
            k += 1
            ids, w = docs[i]
            hidden = w @ vec[ids]
            z = out @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[int(labels[i])] -= 1
            back = p @ out
            out -= rate * np.outer(p, hidden).astype(np.float32)
            bias -= rate * p.astype(np.float32)
            vec[ids] -= (rate * VECTOR_RATE) * np.outer(w, back).astype(np.float32)
    fold = out[1] - out[0]
    return np.append(vec @ fold, bias[1] - bias[0]).astype(np.float32)


def score(texts: list[str | None], model: np.ndarray) -> np.ndarray:
    """Probability of label 1 for every text."""
    value, bias = model[:-1], float(model[-1])
    out = np.empty(len(texts))
    for i, t in enumerate(texts):
        got = features((t or "").encode())
        n = sum(map(len, got))
        z = bias + (sum(float(value[g].sum(dtype=np.float64)) for g in got) / n if n else 0.0)
        out[i] = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
    return out


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> np.ndarray:
    """Train on at most ``rows`` labelled rows outside the held-out quarter.
    Rows without id or label are left out; of several labels, or several texts of
    one id, the least counts, so repeated ids do not widen the sample.
    Without any row the model is all zero (every score is 0.5)."""
    sample = (labels.select("doc_id", "quality").where("doc_id IS NOT NULL AND quality IN (0, 1)")
              .where(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    # the sample holds at most ``rows`` rows, and so does the grouped result
    chosen = (docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
              .groupBy("doc_id").agg(F.min("text").alias("text"),
                                     F.min("quality").cast("int").alias("quality"))
              .select("text", "quality", F.xxhash64("doc_id").alias("h")))

    def run(batches):
        pdfs = [p for p in batches if len(p)]
        if not pdfs:
            return
        pdf = pd.concat(pdfs).sort_values(["h", "text"], kind="stable")
        model = train(pdf["text"].tolist(), pdf["quality"].to_numpy())
        buf = io.BytesIO()
        np.save(buf, model)
        yield pd.DataFrame({"model": [buf.getvalue()]})

    got = chosen.repartition(1).mapInPandas(run, "model binary").collect()   # one row, fixed size
    if not got:
        return np.zeros(BUCKETS + 1, np.float32)
    return np.load(io.BytesIO(bytes(got[0]["model"])))


def classify(docs: DataFrame, model: np.ndarray, column: str = "score") -> DataFrame:
    """``docs`` with the probability of good quality in ``column``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)   # BUCKETS + 1 floats

    def run(texts):
        return [[x for a, b in by_chars([t or "" for t in texts])
                 for x in score(texts[a:b], sent.value).tolist()]]

    return with_columns(docs, ["text"], run, {column: "double"})
