"""Named reads and writes of a store's smaller tables: each a plain filter that reaches the scan, or state in and state out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.storage import delete_by_key, first_of_each, replace_by_key


def equal(**values) -> Column:
    """All given columns equal their values; None asks nothing."""
    return reduce(lambda a, b: a & b, (F.col(c) == v for c, v in values.items() if v is not None), F.lit(True))


# vectors, of capsules and of blocks alike: rows of (id, chunk, embedding, content_hash)


def vectors_of(vectors: DataFrame, id_column: str, value: str) -> DataFrame:
    return vectors.where(F.col(id_column) == value).orderBy("chunk")


def first_vector(vectors: DataFrame, id_column: str, value: str) -> DataFrame:
    """The vector that stands for a row: its first chunk."""
    return vectors.where((F.col(id_column) == value) & (F.col("chunk") == 0)).select("embedding")


def replace_vectors(vectors: DataFrame, incoming: DataFrame, id_column: str) -> DataFrame:
    """All chunks of the incoming ids give way, so that a text which became shorter leaves none behind."""
    return replace_by_key(vectors, incoming, [id_column])


def delete_vectors(vectors: DataFrame, ids: DataFrame, id_column: str) -> DataFrame:
    return delete_by_key(vectors, ids, [id_column])


# cursors, candidates, episodes, feedback, blocks, jobs


def cursor(cursors: DataFrame, consumer: str) -> DataFrame:
    return cursors.where(F.col("consumer") == consumer).select("position")


def move_cursors(cursors: DataFrame, moved: DataFrame) -> DataFrame:
    """A cursor never goes back: of several positions of a consumer the farthest stays."""
    return first_of_each(cursors.unionByName(moved.select(*cursors.columns)), ["consumer"], F.desc("position"))


def upsert_candidates(candidates: DataFrame, incoming: DataFrame) -> DataFrame:
    """One row a candidate, the last one that came."""
    return replace_by_key(candidates, first_of_each(incoming.select(*candidates.columns), ["candidate_id"], F.desc("updated_at")), ["candidate_id"])


def candidates_of(candidates: DataFrame, tenant: str, status: str | None = None) -> DataFrame:
    return candidates.where(equal(tenant=tenant, status=status)).orderBy("created_at", "candidate_id")


def successful_episodes(episodes: DataFrame, tenant: str) -> DataFrame:
    return episodes.where((F.col("tenant") == tenant) & (F.lower(F.btrim("outcome")) == "success"))


def feedback_of(feedback: DataFrame, capsule_id: str) -> DataFrame:
    return feedback.where(F.col("capsule_id") == capsule_id).orderBy("created_at", "feedback_id")


def blocks_where(blocks: DataFrame, tenant: str, limit: int | None = None, **values) -> DataFrame:
    """Blocks by equal columns, in order; a limit makes it a top-k."""
    rows = blocks.where(equal(tenant=tenant, **values)).orderBy("created_at", "line_number", "block_index", "block_id")
    return rows.limit(limit) if limit else rows


def job_status(jobs: DataFrame, job_id: str) -> DataFrame:
    return jobs.where(F.col("job_id") == job_id).select("status")


# skills


def proposal(proposals: DataFrame, tenant: str, proposal_id: str | None = None, job_id: int | None = None) -> DataFrame:
    return proposals.where(equal(tenant=tenant, proposal_id=proposal_id, job_id=job_id)).limit(1)


def head(heads: DataFrame, tenant: str, skill_id: str) -> DataFrame:
    return heads.where(equal(tenant=tenant, skill_id=skill_id)).select("version_id")


def bundle_of(bundles: DataFrame, tenant: str, capsule_id: str) -> DataFrame:
    return bundles.where(equal(tenant=tenant, capsule_id=capsule_id)).orderBy("version_id").limit(1)


def pin_of(pins: DataFrame, tenant: str, session_id: str, agent_id: str, skill_id: str, now: str) -> DataFrame:
    return pins.where(equal(tenant=tenant, session_id=session_id, agent_id=agent_id, skill_id=skill_id) & (F.col("expires_at") > now)).select("version_id")
