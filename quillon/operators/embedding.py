"""Pluggable models: embedders, rerankers and text generators behind small protocols.

No model is shipped; ``HashingEmbedder`` is a deterministic stand-in for tests.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    name: str
    dim: int

    def embed(self, texts: list[str], query: bool) -> np.ndarray: ...


class Generator(Protocol):
    def complete(self, system: str, user: str) -> str: ...


class NotConfigured(RuntimeError):
    """No model is set up."""


class HashingEmbedder:
    """Signed feature hashing of words, length 1."""

    def __init__(self, dim: int = 64):
        self.name, self.dim = f"hashing-{dim}", dim

    def embed(self, texts: list[str], query: bool) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for row, text in zip(out, texts, strict=True):
            for w in text.lower().split():
                h = zlib.crc32(w.encode())
                row[h % self.dim] += 1 if h >> 31 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


PROVIDERS: dict[str, Callable[..., Embedder]] = {"hashing": HashingEmbedder}


@functools.lru_cache(maxsize=4)
def provider(kind: str, *parameters) -> Embedder:
    if kind not in PROVIDERS:
        raise NotConfigured(kind)
    return PROVIDERS[kind](*parameters)


def prefixed(name: str, text: str, query: bool) -> str:
    """The prefixes that the e5 models were trained with; other models get none."""
    return f"{'query' if query else 'passage'}: {text}" if "e5" in name.lower() else text


def embed(texts: DataFrame, key: str, text: str, kind: str, *parameters, query: bool = False, batch: int = 64) -> DataFrame:
    """key, embedding.  The model is made once a worker; texts go in batches."""

    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = provider(kind, *parameters)
        for s in series:
            made = [model.embed([prefixed(model.name, t or "", query) for t in s.iloc[i : i + batch]], query) for i in range(0, len(s), batch)]
            yield pd.Series(list(np.concatenate(made).astype(np.float32)) if made else [], dtype=object)

    vector = F.pandas_udf(run, "array<float>", F.PandasUDFType.SCALAR_ITER)
    return texts.select(key, vector(text).alias("embedding"))
