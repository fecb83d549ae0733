"""Byte-level BPE with a two-tier lookup.

Tier 1: a minimal perfect hash over the vocabulary resolves every pre-token that is itself in it (its slot holds one id, whose bytes are then
compared). Tier 2: other pre-tokens are merged by a heap of candidate pairs over a doubly linked list of bytes, lowest rank first, leftmost
first among equals. Pre-tokens are resolved once per distinct one and batch. Each worker builds the hash once, from the rank file.

Whole texts in one stage: no shuffle, nothing gathered. Defined results: null and empty texts have no ids. Repeated rows get equal ids; null
doc_ids pass; extra columns pass through encode_column. A lone surrogate cannot occur in a Spark string.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import xxhash
from pyspark.sql import DataFrame

from tessera.llm.common import map_rows

RANKS = "byte_bpe_multi_50k.tiktoken"


class MinimalPerfectHash:
    """n keys onto 0..n-1, by levels: a key whose position in a level's bits is its alone stays there, the rest try the next level. A slot is
    the number of set bits before it. Keys are given as 64-bit hashes, all different."""

    LOAD = 1.5

    def __init__(self, hashes: np.ndarray):
        if len(np.unique(hashes)) != len(hashes):
            raise ValueError("two keys have one hash")
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        before, rest = 0, hashes
        while len(rest):
            size = max(64, int(self.LOAD * len(rest)))
            at = self.position(rest, len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            rank = before + np.cumsum(alone) - alone
            self.levels.append((alone, rank.astype(np.int32), size))
            before += int(alone.sum())
            rest = rest[~alone[at]]

    @staticmethod
    def position(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
        x = (hashes + np.uint64(level)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((x >> np.uint64(32)) % np.uint64(size)).astype(np.int64)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """Slot of each hash; for one that is not a key, any slot or -1."""
        out = np.full(len(hashes), -1, np.int64)
        rest = np.arange(len(hashes))
        for level, (alone, rank, size) in enumerate(self.levels):
            at = self.position(hashes[rest], level, size)
            hit = alone[at]
            out[rest[hit]] = rank[at[hit]]
            rest = rest[~hit]
            if not len(rest):
                break
        return out


class Bpe:
    #: Distinct pre-tokens remembered from one batch to the next, at most.
    REMEMBER = 200_000

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.tokens = list(ranks)
        self.ids = np.fromiter(ranks.values(), np.int64, len(ranks))
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, self.tokens), np.uint64, len(ranks))
        self.mph = MinimalPerfectHash(hashes)
        self.by_slot = np.empty(len(ranks), np.int64)
        self.by_slot[self.mph.slots(hashes)] = np.arange(len(ranks))
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.known: dict[str, tuple[int, ...]] = {}

    def resolve(self, pre_tokens: list[str]) -> dict[str, tuple[int, ...]]:
        """Ids of each of some distinct pre-tokens: first tier for all at once, second for what it leaves."""
        data = [p.encode() for p in pre_tokens]
        slots = self.mph.slots(np.fromiter(map(xxhash.xxh3_64_intdigest, data), np.uint64, len(data)))
        out = {}
        for p, piece, slot in zip(pre_tokens, data, slots.tolist(), strict=True):
            k = self.by_slot[slot] if slot >= 0 else -1
            out[p] = (int(self.ids[k]),) if k >= 0 and self.tokens[k] == piece else tuple(self.merge(piece))
        return out

    def merge(self, piece: bytes) -> list[int]:
        """Merges by a heap over linked bytes: O(n log n) for a pre-token of any length."""
        n = len(piece)
        ranks = self.ranks
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = after[i]
            if j >= n or end[i] < 0 or end[j] != stop:
                continue  # one side has since been merged
            end[i], end[j] = stop, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get(piece[i : end[k]])) is not None:
                    heapq.heappush(heap, (r, i, end[k]))
            if (h := before[i]) >= 0 and (r := ranks.get(piece[h:stop])) is not None:
                heapq.heappush(heap, (r, h, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = after[i]
        return out

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids (uint32) of each text."""
        split = [self.split(t) if t else [] for t in texts]
        pieces = set(chain.from_iterable(split))
        if len(self.known) > self.REMEMBER:  # what this batch uses stays
            self.known = {p: self.known[p] for p in pieces if p in self.known}
        self.known.update(self.resolve(list(pieces.difference(self.known))))
        ids = self.known.__getitem__
        return [np.fromiter(chain.from_iterable(map(ids, x)), np.uint32) for x in split]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def bpe_for(name: str = RANKS) -> Bpe:
    """Once per worker process."""
    import public_tokenizers

    lines = Path(public_tokenizers.path(name)).read_bytes().splitlines()
    return Bpe({base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x)}, public_tokenizers.PATTERN)


def encode_documents(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """doc_id, ids (array of int) and decoded (bytes) for each row of docs (doc_id, text)."""

    def run(doc_id: list, text: list) -> dict[str, list]:
        bpe = bpe_for(ranks)
        ids = bpe.encode(text)
        return {"doc_id": doc_id, "ids": [x.astype(np.int32) for x in ids], "decoded": [bpe.decode(x) for x in ids]}

    return map_rows(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded binary")


def digest_documents(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """As encode_documents, but ids and decoded bytes leave the worker as digests: ids as little-endian unsigned 32-bit integers."""

    def run(doc_id: list, text: list) -> dict[str, list]:
        bpe = bpe_for(ranks)
        ids = bpe.encode(text)
        return {
            "doc_id": doc_id,
            "n_tokens": list(map(len, ids)),
            "ids_sha256": [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids],
            "decoded_sha256": [hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids],
        }

    return map_rows(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
