"""Vectors of texts: a protocol for models and a stand-in that needs none."""

from __future__ import annotations

from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from skein.runtime import ship


class ModelMissing(Exception):
    """The files of a model are not where they should be."""


class Embedder(Protocol):
    model_id: str
    dim: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class ByteEmbedder:
    """Four sums over the bytes of a text, normalised; an empty text gives zeros."""

    model_id, dim = "bytes-4", 4

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            b = np.frombuffer(t.encode("utf-8", "replace"), np.uint8)
            v = np.bincount(b % 4, b % 13 + 1, minlength=4)
            n = np.linalg.norm(v)
            out.append((v / n if n else v).astype(np.float32).tolist())
        return out


EMBEDDERS: dict[str, type] = {ByteEmbedder.model_id: ByteEmbedder}


def embedder(model_id: str) -> Embedder:
    """The embedder of a name; ModelMissing if there is none here."""
    if model_id not in EMBEDDERS:
        raise ModelMissing(f"no files of model {model_id!r}; known: {', '.join(EMBEDDERS)}")
    return EMBEDDERS[model_id]()


def byte_vector(c: Column) -> Column:
    """Vector of a text by ByteEmbedder, in Arrow batches; null has none."""

    ship(SparkSession.active())

    @F.pandas_udf("array<float>")
    def vec(s: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else v for t, v in zip(s, ByteEmbedder().embed([t or "" for t in s]))], dtype=object)

    return vec(c)
