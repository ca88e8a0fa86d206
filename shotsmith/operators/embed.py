"""M3: batch sentence encoding through a user encoder (``mapInPandas``).

An encoder is an object with ``load()`` (called once per task, e.g. to read
model weights) returning a function ``list[str] -> numpy array [n, d]``;
token encoders return a list of ([t_i, d] array, [t_i] mask) pairs.  Text goes to
Python in Arrow batches; vectors come back as ARRAY<FLOAT>.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotsmith.operators.pooling import MASK_CLAMP
from shotsmith.session import checkpoint_dir, ship_package


class HashingEncoder:
    """Offline stand-in encoder: signed feature hashing of space tokens.

    Token t adds sign(t) to bucket(t), both from md5(t) (first 8 hex digits
    mod dim; parity of the 9th digit: even +1, odd -1); the vector is then
    L2-normalised.  Deterministic and reproducible in SQL; needs no model.
    """

    def __init__(self, dim: int = 64):
        self.dim = dim

    def load(self):
        import hashlib
        dim = self.dim

        def encode(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dim), dtype=np.float64)
            for i, t in enumerate(texts):
                for tok in str(t).split(" "):
                    h = hashlib.md5(tok.encode("utf-8")).hexdigest()
                    out[i, int(h[:8], 16) % dim] += 1.0 if int(h[8], 16) % 2 == 0 else -1.0
            n = np.linalg.norm(out, axis=1, keepdims=True)
            return out / np.maximum(n, 1e-12)
        return encode


class HashingTokenEncoder(HashingEncoder):
    """Its token form: one signed unit vector per space token, nothing masked."""

    def load(self):
        encode = super().load()

        def tokens(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
            words = [str(t).split(" ") for t in texts]
            return [(encode(w), np.ones(len(w))) for w in words]
        return tokens


ENCODE_CHARS = 1 << 17      # characters a token encoder gets at a time
ENCODE_ROWS = 512           # texts an encoder gets at a time


def text_slices(texts: list[str], rows: int = ENCODE_ROWS) -> Iterator[tuple[int, int]]:
    """(start, end) of consecutive texts: ``rows`` and ENCODE_CHARS at most, but a
    text at least, so that vectors in memory do not grow with the Arrow batch."""
    at = size = 0
    for i, t in enumerate(texts):
        if i > at and (i - at >= rows or size + len(t) > ENCODE_CHARS):
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


class PooledEncoder:
    """A sentence encoder from a token encoder: the masked mean (A5) is taken in
    the slice of texts that made the token vectors, so these never leave the task
    and only a slice's are held."""

    def __init__(self, tokens):
        self.tokens = tokens

    def load(self):
        encode = self.tokens.load()

        def pooled(texts: list[str]) -> list[np.ndarray]:
            return [mask @ vecs / max(mask.sum(), MASK_CLAMP) for at, end in text_slices(texts)
                    for vecs, mask in encode(texts[at:end])]
        return pooled


def embed_tokens(df: DataFrame, encoder, id_col: str, text_col: str = "sentence") -> DataFrame:
    """(id, toks ARRAY<ARRAY<DOUBLE>>): the unmasked token vectors of every row,
    written once to the checkpoint folder (the F1 probes and joins read them)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder.load()
        for pdf in batches:
            texts = pdf[text_col].fillna("nan").astype(str).tolist()
            for at, end in text_slices(texts):
                yield pd.DataFrame({id_col: pdf[id_col].to_numpy()[at:end],
                                    "toks": [vecs[mask > 0].tolist() for vecs, mask in encode(texts[at:end])]})
    ship_package(df.sparkSession)
    checkpoint_dir(df.sparkSession)
    return df.select(id_col, text_col).mapInPandas(
        run, f"{id_col} bigint, toks array<array<double>>").checkpoint(eager=True)


def embed(df: DataFrame, encoder, id_col: str, text_col: str = "sentence",
          out_col: str = "embedding", dtype: str = "float",
          materialize: bool = True) -> DataFrame:
    """(id, embedding ARRAY<FLOAT>) for every row (``dtype='double'`` keeps
    float64).

    ``materialize``: the vectors are written once to the checkpoint folder,
    so later uses (row counts, the dimension probe, KMeans iterations, block
    joins) read them instead of running the encoder again.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder.load()
        for pdf in batches:
            texts = pdf[text_col].fillna("nan").astype(str).tolist()
            for at, end in text_slices(texts):
                yield pd.DataFrame({id_col: pdf[id_col].to_numpy()[at:end],
                                    out_col: [v.astype(np_type) for v in encode(texts[at:end])]})
    ship_package(df.sparkSession)
    np_type = np.float32 if dtype == "float" else np.float64
    out = df.select(F.col(id_col), F.col(text_col)).mapInPandas(
        run, f"{id_col} bigint, {out_col} array<{dtype}>")
    if materialize:
        checkpoint_dir(df.sparkSession)
        out = out.checkpoint(eager=True)
    return out
