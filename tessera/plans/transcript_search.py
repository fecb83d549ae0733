"""Transcript search: channels, union, score, filters, context, merged windows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import redact
from tessera.operators import retrieval as R
from tessera.operators import transcripts as X

# How far beyond the limit channels look.
OVERSAMPLE, FILTERED = 4, 4


@dataclass
class TranscriptSearch:
    tenant: str
    query: str
    vector: list[float] | None = None
    limit: int = 10
    session_id: str | None = None
    role: str | None = None
    block_type: str | None = None
    since: str | None = None
    until: str | None = None
    anchor_session: str | None = None
    context: int = 2


def search(blocks: DataFrame, vectors: DataFrame | None, s: TranscriptSearch) -> DataFrame:
    """The best blocks: block_id, session_id, score. Filters apply after the score; both time bounds are inclusive."""
    filters = [c for c in (s.session_id and F.col("session_id") == s.session_id, s.role and F.col("role") == s.role, s.block_type and F.col("block_type") == s.block_type, s.since and F.col("created_at") >= s.since, s.until and F.col("created_at") <= s.until) if c is not None and not isinstance(c, str)]
    k = s.limit * OVERSAMPLE * (FILTERED if filters else 1)
    eligible = blocks.where("embed_eligible")
    spark = blocks.sparkSession
    none = spark.createDataFrame([], "block_id string, rank int")
    lexical = R.bm25(eligible, F.col("content"), "block_id", s.query, k, F.col("tenant") == s.tenant).select("block_id", "rank") if R.query_terms(s.query) else none
    semantic = R.nearest(vectors, s.vector, k, "block_id").select("block_id", "rank") if vectors is not None and s.vector else none
    ids = lexical.select("block_id").unionByName(semantic.select("block_id"))
    if not R.query_terms(s.query):
        ids = ids.unionByName(X.newest(blocks, s.tenant, k).select("block_id"))
    if s.anchor_session:
        ids = ids.unionByName(X.newest(blocks, s.tenant, k, s.anchor_session).select("block_id"))
    pool = eligible.where(F.col("tenant") == s.tenant).join(ids.distinct(), "block_id", "left_semi")
    scored = X.score_hits(pool, lexical, semantic, s.anchor_session)
    for c in filters:
        scored = scored.where(c)
    return scored.orderBy(F.desc("score"), "block_id").limit(s.limit)


def windows(blocks: DataFrame, hits: DataFrame, s: TranscriptSearch) -> DataFrame:
    """Hits with their context, overlapping ones merged, best first."""
    around = X.context_windows(blocks.where(F.col("tenant") == s.tenant), hits.select("block_id", "score"), s.context, s.context)
    return X.merge_windows(around).orderBy(F.desc("score"), "key", "island")


def shown(blocks: DataFrame) -> DataFrame:
    """What leaves the store: secrets masked."""
    return blocks.withColumn("content", redact(F.col("content")))
