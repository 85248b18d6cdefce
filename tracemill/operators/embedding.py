"""Batch embedding of a text column, with a caller's model or a model-free default."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIMS = 64
_SPACE = re.compile(r"[ \t\n\r\f\v]+")

Model = Callable[[pd.Series], np.ndarray]


def hashed_pairs(dims: int = DIMS) -> Model:
    """Unit vectors of signed hashed word pairs; the word itself when a text has only one.

    md5 gives 16 bits per pair: the top bit is the sign, the rest modulo
    ``dims`` the place.
    """
    def run(texts: pd.Series) -> np.ndarray:
        vectors = np.zeros((len(texts), dims))
        for row, text in enumerate(texts):
            # bytes are split at the six white space characters of ASCII
            words = (text or "").lower().encode().split()
            pairs = map(b" ".join, zip(words, words[1:])) if len(words) > 1 else words
            digests = b"".join([hashlib.md5(pair).digest() for pair in pairs])
            numbers = np.frombuffer(digests, ">u2")[::8]
            vectors[row] = np.bincount(numbers % dims, np.where(numbers < 32_768, 1.0, -1.0), dims)
        norms = np.linalg.norm(vectors, axis=1, keepdims=True)
        return np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)

    return run


def embed(df: DataFrame, text: Column, out: str = "embedding", load_model: Callable[[], Model] = hashed_pairs) -> DataFrame:
    """Add a vector column. ``load_model`` runs once per Python worker; its model sees whole Arrow batches."""
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load_model()
        for texts in batches:
            yield pd.Series(list(np.asarray(model(texts), dtype=np.float32)))

    return df.withColumn(out, vectors(text))


def score_pairs(df: DataFrame, left: str, right: str, load_model: Callable[[], Callable], out: str = "score") -> DataFrame:
    """Add the score of a caller's pair model, loaded once per worker, over two columns."""
    @F.pandas_udf(T.DoubleType())
    def scores(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load_model()
        for a, b in batches:
            yield pd.Series(np.asarray(model(a, b), dtype=np.float64))

    return df.withColumn(out, scores(left, right))


def shared_words() -> Callable:
    """Model-free pair scorer: share of the first text's distinct words found in the second."""
    def run(left: pd.Series, right: pd.Series) -> list[float]:
        found = []
        for a, b in zip(left, right):
            words = {w for w in _SPACE.split((a or "").lower()) if w}
            other = {w for w in _SPACE.split((b or "").lower()) if w}
            found.append(len(words & other) / len(words) if words else 0.0)
        return found

    return run
