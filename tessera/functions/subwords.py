"""Subword tokens with byte offsets: windows for embedding, texts cut to a token budget, token counts.

Ids come from the tiktoken library over a vocabulary file, which is a parameter and is read on each machine where it lies. A token stands for bytes of the text, so the offsets of tokens are the running sum of their lengths, and what
is cut from a text are its own bytes: nothing is decoded anew. Where a cut falls inside a character, the dangling part of it is left out. All in Arrow batches; null texts stay null."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.pieces import pieces
from tessera.functions.text import CHUNK_OVERLAP, CHUNK_TOKENS, redact

WINDOWS = "array<struct<start:bigint,stop:bigint,text:string>>"
ARROW_WINDOWS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("text", pa.string())]))
LEAST_BUDGET = 8


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


class Subwords:
    """A vocabulary of ranked byte strings."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("subwords", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        self.lengths[list(ranks.values())] = [len(token) for token in ranks]

    def ends(self, text: str) -> np.ndarray:
        """Where each token ends, in bytes of UTF-8."""
        return np.cumsum(self.lengths[self.encoding.encode_ordinary(text)])

    def windows(self, text: str, size: int, overlap: int) -> list[tuple[int, int, str]]:
        """(start, stop, text) of windows of `size` tokens, each `overlap` into the one before, without partial characters at their ends; a text that fits is one window."""
        size = max(1, size)
        step = size - min(overlap, size - 1)
        data, ends = text.encode("utf-8", "surrogatepass"), self.ends(text)
        if len(ends) <= size:
            return [(0, len(data), text)]
        out = []
        for at in range(0, len(ends), step):
            last = min(at + size, len(ends))
            out.append(whole(data, int(ends[at - 1]) if at else 0, int(ends[last - 1])))
            if last == len(ends):
                break
        return out

    def fitted(self, text: str, budget: int) -> str:
        """At most max(8, budget) tokens; the cut moves back to the last white space if that keeps more than half of the bytes."""
        ends, most = self.ends(text), max(LEAST_BUDGET, budget)
        if len(ends) <= most:
            return text
        cut = whole(text.encode("utf-8", "surrogatepass"), 0, int(ends[most - 1]))[2]
        at = max((i for i, c in enumerate(cut) if c.isspace()), default=-1)
        return cut[:at].rstrip() if at >= 0 and len(cut[:at].encode()) > len(cut.encode()) // 2 else cut


def whole(data: bytes, start: int, stop: int) -> tuple[int, int, str]:
    """The characters that lie whole between two places, and their place."""
    while start < stop and data[start] & 0xC0 == 0x80:
        start += 1
    end = stop
    while end > start and end < len(data) and data[end] & 0xC0 == 0x80:
        end -= 1
    return start, end, data[start:end].decode("utf-8", "replace")


@lru_cache(maxsize=2)
def loaded(path: str) -> Subwords:
    return Subwords(path)


def windows_of(batches: Iterator[pa.Array], own: Subwords, size: int, overlap: int) -> Iterator[pa.Array]:
    """Windows of whole batches, given on piece by piece."""
    for texts in batches:
        for piece in pieces(texts):
            yield pa.array([None if t is None else [{"start": a, "stop": b, "text": s} for a, b, s in own.windows(t, size, overlap)] for t in piece.to_pylist()], ARROW_WINDOWS)


def subword_windows(text: Column, size: int = CHUNK_TOKENS, overlap: int = CHUNK_OVERLAP, vocabulary: str | None = None) -> Column:
    """Windows of a text: start, stop (bytes of UTF-8) and text."""
    path = vocabulary or default_vocabulary()

    @F.arrow_udf(WINDOWS)
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from windows_of(batches, loaded(path), size, overlap)

    return cut(text)


def subword_chunks(text: Column, size: int = CHUNK_TOKENS, overlap: int = CHUNK_OVERLAP, vocabulary: str | None = None) -> Column:
    """The texts of the windows alone."""
    return F.transform(subword_windows(text, size, overlap, vocabulary), lambda w: w["text"])


def fit_tokens(text: Column, budget: Column | int, vocabulary: str | None = None) -> Column:
    """Secrets masked, then cut to the budget of subword tokens."""
    path = vocabulary or default_vocabulary()

    @F.pandas_udf("string")
    def fit(texts: pd.Series, budgets: pd.Series) -> pd.Series:
        own = loaded(path)
        return pd.Series([None if t is None else own.fitted(t, int(n)) for t, n in zip(texts, budgets, strict=True)], dtype=object)

    return fit(redact(text), (budget if isinstance(budget, Column) else F.lit(budget)).cast("int"))


def count_subwords(text: Column, vocabulary: str | None = None) -> Column:
    path = vocabulary or default_vocabulary()

    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        own = loaded(path)
        return pd.Series([None if t is None else len(own.ends(t)) for t in texts], dtype="Int64")

    return count(text)
