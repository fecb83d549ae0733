"""Embedding and pair scoring as vectorised functions: a provider is any callable from texts to vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.pieces import pieces

# Fixed values of the deterministic provider and of the query form.
MULTIPLIER, INCREMENT = 6364136223846793005, 1
QUERY_TEMPLATE = "Instruct: Given a query, retrieve relevant passages that answer it\nQuery: {}"

Provider = Callable[[list[str]], list[list[float]]]


def deterministic(texts: list[str], dim: int = 64) -> list[list[float]]:
    """Vectors that depend on the text alone: a congruential sequence seeded by the text's SHA-256, in [-1, 1)."""
    digests = [hashlib.sha256(t.encode()).digest() for t in texts]
    state = np.array([int.from_bytes(d[:8], "little") for d in digests], np.uint64)
    salt = np.array([list(d) for d in digests], np.uint64).reshape(len(texts), 32)
    out = np.empty((len(texts), dim), np.float32)
    for i in range(dim):
        state = state * np.uint64(MULTIPLIER) + np.uint64(INCREMENT)
        out[:, i] = ((state ^ salt[:, i % 32]) & np.uint64(0xFFFF)).astype(np.float32) / np.float32(32768) - np.float32(1)
    return out.tolist()


def embed(provider: Provider = deterministic) -> Callable[[Column], Column]:
    """A column function; the provider sees pieces of batches."""

    @F.arrow_udf("array<float>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for piece in pieces(texts):
                yield pa.array(list(provider(pc.fill_null(piece, "").to_pylist())), pa.list_(pa.float32()))

    return run


def score_pairs(scorer: Callable[[list[str], list[str]], list[float]]) -> Callable[[Column, Column], Column]:
    @F.pandas_udf("float")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(scorer(a.fillna("").tolist(), b.fillna("").tolist()), dtype="float32")

    return run


def query_text(query: Column, instructed: bool) -> Column:
    return F.format_string(QUERY_TEMPLATE.replace("{}", "%s"), query) if instructed else query
