"""Document fingerprints: one-permutation MinHash.

Every word shingle is hashed once; its top bits name one of `bins` bins and each bin keeps its least hash. Empty bins are filled by optimal
densification: bin j tries bins h(j, 1), h(j, 2), ... until one is not empty, a choice that depends on j and the attempt alone. The low `bits` bits
of each bin are packed. The likeness of two fingerprints is the share of equal bins, corrected for equality by chance (2^-bits).

Defined results: rows without a doc_id come first in the order and have a next document like all others; rows that repeat a doc_id follow each other by
text. doc_id is an integer, or text that reads as one; other text counts as no doc_id. Very long texts are hashed whole, one at a time. Extra columns, whatever their names, do no harm.
Texts without words have an all-zero fingerprint marked `-` (empty string for the packed form); two of them are alike (1.0), one
of them and any other are not (0.0). Texts of fewer words than a shingle are one shingle. Equal texts have equal fingerprints.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import WordHashes, ensure_importable, mix64, pa_schema, shingle_hashes, tidy, words_of

BINS, BITS, SHINGLE = 512, 4, 5


class OnePermutation:
    def __init__(self, bins: int = BINS, bits: int = BITS, shingle: int = SHINGLE):
        if bins & (bins - 1) or 8 % bits:
            raise ValueError("bins must be a power of two, and bits a divisor of 8")
        self.bins, self.bits, self.shingle = bins, bits, shingle
        self.words = WordHashes()
        self.tries = np.empty((0, bins), np.int64)

    def attempts(self, start: int, stop: int) -> np.ndarray:
        """Row a, column j: the bin that empty bin j tries at attempt a."""
        if stop > len(self.tries):
            a, j = np.arange(max(stop, 64), dtype=np.uint64)[:, None], np.arange(self.bins, dtype=np.uint64)[None]
            self.tries = (mix64(mix64(j + np.uint64(1)) * np.uint64(31) + a) & np.uint64(self.bins - 1)).astype(np.int64)
        return self.tries[start:stop]

    def fill(self, values: np.ndarray, empty: np.ndarray) -> np.ndarray:
        """Values of all bins. With one filled bin every chain ends there."""
        full = np.flatnonzero(~empty)
        if len(full) == 1:
            return np.full(self.bins, values[full[0]])
        todo, at, step = np.flatnonzero(empty), 0, 8
        while len(todo):
            to = self.attempts(at, at + step)[:, todo]
            hit = ~empty[to]
            found = hit.any(axis=0)
            values[todo[found]] = values[to[hit.argmax(axis=0)[found], np.flatnonzero(found)]]
            todo, at, step = todo[~found], at + step, min(step * 2, 1024)
        return values

    def fingerprint(self, text: str | None) -> bytes:
        hashes = shingle_hashes(self.words.of(words_of(text)), self.shingle)
        if not len(hashes):
            return b""
        shift = np.uint64(64 - self.bins.bit_length() + 1)
        bins = (hashes >> shift).astype(np.int64)  # sorted hashes: the first of each bin is its least
        first = np.concatenate(([True], bins[1:] != bins[:-1]))
        low = np.zeros(self.bins, np.uint8)
        empty = np.ones(self.bins, bool)
        low[bins[first]] = (mix64(hashes[first]) & np.uint64((1 << self.bits) - 1)).astype(np.uint8)
        empty[bins[first]] = False
        if empty.any():
            low = self.fill(low, empty)
        per = 8 // self.bits
        packed = np.zeros(self.bins // per, np.uint8)
        for i in range(per):
            packed |= low[i::per] << np.uint8(i * self.bits)
        return packed.tobytes()

    def unpack(self, packed: bytes) -> np.ndarray:
        data = np.frombuffer(packed, np.uint8)
        return np.stack([(data >> np.uint8(i * self.bits)) & np.uint8((1 << self.bits) - 1) for i in range(8 // self.bits)], axis=1).ravel()

    def likeness(self, a: bytes, b: bytes) -> float:
        if not a or not b:
            return float(a == b)
        chance = 2.0**-self.bits
        equal = float(np.mean(self.unpack(a) == self.unpack(b)))
        return max(0.0, (equal - chance) / (1 - chance))


@lru_cache(maxsize=4)
def sketcher(bins: int = BINS, bits: int = BITS, shingle: int = SHINGLE) -> OnePermutation:
    """Once per worker process."""
    return OnePermutation(bins, bits, shingle)


def edited(text: str, following: str) -> str:
    """The last floor(n/2) characters replaced by the first as many of the next document, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def in_order_with_next(docs: DataFrame, ranges: int) -> DataFrame:
    """Rows (doc_id, text, part, ghost), dealt by ranges of doc_id and sorted in each: a range ends with a copy (ghost) of the first row of the
    next range that has rows, so each row meets its successor without a global window. One shuffle of texts; the driver sees one id per range."""
    rows = docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = rows.select("doc_id").where("doc_id is not null")
    cuts = np.array(sorted({int(x) for x in ids.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 1 / (4 * ranges))}), np.int64)

    def part_of(doc_id: pd.Series) -> pd.Series:
        return pd.Series(np.where(doc_id.isna(), 0, np.searchsorted(cuts, doc_id.fillna(0).astype("int64"), side="right")).astype(np.int32))

    dealt = rows.withColumn("part", F.pandas_udf(part_of, "int")("doc_id"))
    firsts = sorted((r["part"], None if r["nulls"] else r["first"]) for r in dealt.groupBy("part").agg(F.min("doc_id").alias("first"), F.max(F.col("doc_id").isNull()).alias("nulls")).collect())
    # the head of each range goes to the range before it as well, that of the first to the last; a null head is the first range's
    to = [firsts[i - 1][0] for i in range(len(firsts))]
    null_to = next((t for (_, head), t in zip(firsts, to, strict=True) if head is None), -1)
    heads, goals = (np.array(x, np.int64) for x in ([h for _, h in firsts if h is not None], [t for (_, h), t in zip(firsts, to, strict=True) if h is not None]))

    def ghost_of(doc_id: pd.Series) -> pd.Series:
        ids = doc_id.fillna(0).astype("int64").to_numpy()
        place = np.minimum(np.searchsorted(heads, ids), max(len(heads) - 1, 0))
        hit = (heads[place] == ids) if len(heads) else np.zeros(len(ids), bool)
        goal = np.where(hit, goals[place] if len(heads) else 0, -1)
        goal = np.where(doc_id.isna(), null_to, goal)
        return pd.Series(goal, dtype="Int32").where(goal >= 0)

    ghost = F.pandas_udf(ghost_of, "int")("doc_id")
    places = F.array_compact(F.array(F.struct(F.col("part").alias("part"), F.lit(False).alias("ghost")), F.when(F.col("to").isNotNull(), F.struct(F.col("to").alias("part"), F.lit(True).alias("ghost")))))
    return (
        dealt.withColumn("to", ghost).withColumn("place", F.explode(places)).select("doc_id", "text", "place.part", "place.ghost")
        .repartitionById(ranges, F.col("part")).sortWithinPartitions("part", "ghost", F.asc_nulls_first("doc_id"), "text")
    )


def fingerprint_documents(docs: DataFrame, ranges: int | None = None, bins: int = BINS, bits: int = BITS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row of docs (doc_id, text).

    The next document is the next row by (doc_id, text), nulls first; a single row is its own next one."""
    spark = docs.sparkSession
    ensure_importable(spark)
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    target = pa_schema(spark, schema)

    def run(batches):
        import pyarrow as pa

        sketch = sketcher(bins, bits, shingle)
        held = None  # the row that waits for its next one: (part, doc_id, text, fingerprint)
        for batch in batches:
            out = []
            for doc_id, text, part, ghost in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if ghost and held is None:
                    continue  # a second row with the same first id
                own = sketch.fingerprint(text)
                if held is not None and held[0] == part:
                    _, h_id, h_text, h_own = held
                    other = edited(h_text, text)
                    changed = sketch.fingerprint(other)
                    out.append((h_id, len(h_text), hashlib.sha256(other.encode()).hexdigest(), h_own.hex(), changed.hex(), sketch.likeness(h_own, changed), sketch.likeness(h_own, own)))
                held = None if ghost else (part, doc_id, text, own)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), target, strict=True)], schema=target)

    return in_order_with_next(docs, ranges).select("doc_id", "text", "part", "ghost").mapInArrow(tidy(run), schema)
