"""Embedder contract and the Spark job that applies one."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terralex import fixed_values as fv
from terralex.functions.text import trimmed
from terralex.session import require


class Embedder(Protocol):
    """Texts in, one vector per text out, in order."""

    dimension: int

    def encode(self, texts: Sequence[str]) -> np.ndarray: ...


class CharacterGrams:
    """A model-free embedder: hashed character trigrams, unit length. Equal texts get equal vectors."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension
        self._slots: dict[str, tuple[int, float]] = {}

    def _slot(self, gram: str) -> tuple[int, float]:
        if gram not in self._slots:
            if len(self._slots) > 1_000_000:
                self._slots.clear()
            number = int.from_bytes(hashlib.blake2b(gram.encode(), digest_size=8).digest(), "big")
            self._slots[gram] = (number % self.dimension, 1.0 if number >> 63 else -1.0)
        return self._slots[gram]

    def encode(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension), dtype=np.float32)
        for row, text in enumerate(texts):
            padded = f"  {text.lower()} "
            for gram, count in Counter(padded[i:i + 3] for i in range(len(padded) - 2)).items():
                slot, sign = self._slot(gram)
                out[row, slot] += sign * count
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        out[:, 0] = np.where(norms[:, 0] == 0, 1.0, out[:, 0])
        return out / np.where(norms == 0, 1.0, norms)


def bounded_batches(lengths: np.ndarray, rows: int, letters: int | None) -> Iterator[np.ndarray]:
    """Positions of the texts of each model call, at most `rows` of them.

    With a bound of `letters`, texts of like length go together, shortest first, and a call holds as many as keep
    (number of texts) x (longest text) within it, which is what a model pads a batch to; a longer text goes alone.
    """
    order = np.arange(len(lengths)) if letters is None else np.argsort(lengths, kind="stable")
    start = 0
    for at in range(1, len(order) + 1):
        full = at == len(order) or at - start == rows
        if full or letters is not None and (at - start + 1) * lengths[order[at]] > letters:
            yield order[start:at]
            start = at


def embed_texts(
    df: DataFrame, text: str, make_embedder: Callable[[], Embedder], batch_size: int = 64, output: str = "embedding",
    parallelism: int | None = None, batch_letters: int | None = None,
) -> DataFrame:
    """Add a vector column. The model is built once per task; texts go to it in slices of `batch_size`, with
    `batch_letters` in batches of like length that it bounds; rows keep their order.

    `parallelism` spreads the rows first, which pays when the input has fewer splits than there are workers.
    Blank texts, wrong counts, wrong dimensions and non-finite values fail the job.
    """
    if not 1 <= batch_size <= fv.MAX_EMBED_BATCH:
        raise ValueError(f"batch size must be between 1 and {fv.MAX_EMBED_BATCH}")
    if batch_letters is not None and batch_letters < 1:
        raise ValueError("batch letters must be positive")
    if parallelism:
        df = df.repartition(parallelism)
    schema = T.StructType([*df.schema.fields, T.StructField(output, T.ArrayType(T.FloatType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embedder = None
        for frame in frames:
            if len(frame) == 0:
                continue
            embedder = embedder or make_embedder()
            vectors = np.empty((len(frame), embedder.dimension), np.float32)
            lengths = frame[text].str.len().fillna(0).to_numpy(np.int64)
            for rows in bounded_batches(lengths, batch_size, batch_letters):
                vectors[rows] = _encode(embedder, frame[text].iloc[rows])
            yield frame.assign(**{output: list(vectors)})

    return df.mapInPandas(run, schema)


def _encode(embedder: Embedder, texts: pd.Series) -> np.ndarray:
    if texts.isna().any() or (texts.str.strip() == "").any():
        raise ValueError("texts must contain non-empty strings")
    vectors = np.asarray(embedder.encode(texts.str.strip().tolist()), dtype=np.float32)
    if vectors.shape != (len(texts), embedder.dimension):
        raise ValueError(f"expected {len(texts)} vectors of dimension {embedder.dimension}, got {vectors.shape}")
    if not np.isfinite(vectors).all():
        raise ValueError("embedding values must be finite")
    return vectors


def embed_by_columns(df: DataFrame, text: str, embedding: Callable[[Column], Column], output: str = "embedding") -> DataFrame:
    """Add a vector column by an embedder stated as a Column of the trimmed text. Blank texts fail the job."""
    clean = trimmed(F.col(text))
    return df.where(require(clean != "", "texts must contain non-empty strings")).withColumn(output, embedding(clean))


def embed_distinct(
    df: DataFrame, text: str, make_embedder: Callable[[], Embedder], batch_size: int = 64, output: str = "embedding",
    batch_letters: int | None = None, parallelism: int | None = None,
) -> DataFrame:
    """Embed each distinct text once and join the vectors back (repeated queries cost one call)."""
    unique = df.select(F.col(text).alias("_text")).distinct()
    vectors = embed_texts(unique, "_text", make_embedder, batch_size, output, parallelism, batch_letters)
    return df.join(vectors, df[text] == vectors["_text"]).drop("_text")
