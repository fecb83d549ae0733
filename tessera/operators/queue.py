"""Durable queues and lifecycle changes as state in, state out: each takes a table and returns the table after the change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.timefn import add_ms, sub_ms
from tessera.operators.storage import first_of_each, update_where
from tessera.schemas import FEEDBACK, VALIDATING_FEEDBACK

# How long a lease lasts, and how retries back off.
LEASE_MS = 300_000
BACKOFF_MS = (60_000, 300_000, 1_800_000)
TWIN = ["tenant", "capsule_id", "content_hash", "provider"]
TERMINAL = ("completed", "stale", "dead_letter")


def backoff_ms(attempt: Column) -> Column:
    return F.when(attempt <= 1, BACKOFF_MS[0]).when(attempt == 2, BACKOFF_MS[1]).otherwise(BACKOFF_MS[2])


def enqueue(jobs: DataFrame, incoming: DataFrame, any_twin: bool = False) -> DataFrame:
    """Jobs that land: none that has a live twin (any_twin: a twin in any state)."""
    live = jobs if any_twin else jobs.where(F.col("status").isin("pending", "processing"))
    return first_of_each(incoming, TWIN, F.asc("job_id")).join(live.select(*TWIN).distinct(), TWIN, "left_anti")


def claimable(now: str, most_attempts: int) -> Column:
    lease = F.lit(now)
    expired = (F.col("status") == "processing") & (F.col("updated_at") <= sub_ms(lease, LEASE_MS))
    return (F.col("available_at") <= now) & ((F.col("status") == "pending") | ((F.col("status") == "failed") & (F.col("attempts") < most_attempts)) | expired)


def claim(jobs: DataFrame, now: str, most_attempts: int, n: int) -> DataFrame:
    """The next n jobs: a top-k, oldest first."""
    return jobs.where(claimable(now, most_attempts)).orderBy("available_at", "created_at", "job_id").limit(n)


def claimed(jobs: DataFrame, picked: DataFrame, now: str) -> DataFrame:
    """The table after the claim."""
    ids = picked.select("job_id", F.lit(True).alias("hit_"))
    joined = jobs.join(ids, "job_id", "left")
    return update_where(joined, F.col("hit_"), status=F.lit("processing"), updated_at=F.lit(now)).select(*jobs.columns)


def heads(jobs: DataFrame, now: str, n: int) -> DataFrame:
    """The oldest open job of each serial key blocks the rest of it; heads that may start, oldest first."""
    head = first_of_each(jobs.where(~F.col("status").isin(*TERMINAL)), ["serial_key"], F.asc("created_at"), F.asc("job_id"))
    return head.where((F.col("status") == "pending") & (F.col("available_at") <= now)).orderBy("created_at", "job_id").limit(n)


def finish(jobs: DataFrame, job_ids: list[str], status: str, now: str) -> DataFrame:
    """completed or stale: only from processing."""
    return update_where(jobs, F.col("job_id").isin(job_ids) & (F.col("status") == "processing"), status=F.lit(status), updated_at=F.lit(now))


def fail(jobs: DataFrame, job_ids: list[str], most_attempts: int, now: str) -> DataFrame:
    """One attempt more: failed until a later time, or for good."""
    hit = F.col("job_id").isin(job_ids) & (F.col("status") == "processing")
    attempt = F.col("attempts") + 1
    return update_where(jobs, hit, attempts=attempt, status=F.when(attempt >= most_attempts, "dead_letter").otherwise("failed"), available_at=F.when(attempt >= most_attempts, F.col("available_at")).otherwise(add_ms(F.lit(now), backoff_ms(attempt))), updated_at=F.lit(now))


def latest_status(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("capsule_id", "content_hash").agg(F.max_by("status", F.struct("updated_at", "job_id")).alias("status"))


def embedding_state(capsules: DataFrame, vectors: DataFrame, jobs: DataFrame) -> DataFrame:
    """indexed, stale, or the state of the latest job, or none."""
    v = vectors.groupBy("capsule_id").agg(F.max("content_hash").alias("vector_hash"))
    j = jobs.groupBy("capsule_id").agg(F.max_by("status", F.struct("updated_at", "job_id")).alias("job_status"))
    state = F.when(F.col("vector_hash") == F.col("content_hash"), "indexed").when(F.col("vector_hash").isNotNull(), "stale").otherwise(F.coalesce("job_status", F.lit("none")))
    return capsules.select("capsule_id", "content_hash").join(v, "capsule_id", "left").join(j, "capsule_id", "left").select("capsule_id", state.alias("state"))


def apply_feedback(capsules: DataFrame, feedback: DataFrame) -> DataFrame:
    """Confidence and decay move by the events' deltas, never over 1; the last event that sets a status sets it."""
    kind = F.col("kind")
    pick = lambda i: F.coalesce(*(F.when(kind == k, F.lit(v[i])) for k, v in FEEDBACK.items()), F.lit(None))
    status = F.coalesce(*(F.when(kind == k, F.lit(v[2])) for k, v in FEEDBACK.items() if v[2]))
    per = feedback.groupBy("capsule_id").agg(F.sum(pick(0)).alias("dc"), F.sum(pick(1)).alias("dd"), F.max_by(status, F.when(status.isNotNull(), F.struct("created_at", "feedback_id"))).alias("new_status"), F.max(F.when(kind.isin(*VALIDATING_FEEDBACK), F.col("created_at"))).alias("validated_at"))
    out = capsules.join(per, "capsule_id", "left")
    return (
        out.withColumn("confidence", F.least(F.lit(1.0), F.col("confidence") + F.coalesce("dc", F.lit(0.0)))).withColumn("decay_score", F.least(F.lit(1.0), F.col("decay_score") + F.coalesce("dd", F.lit(0.0))))
        .withColumn("status", F.coalesce("new_status", "status")).drop("dc", "dd", "new_status")
    )


def decay(capsules: DataFrame, now: str, per_day: float = 0.01) -> DataFrame:
    """One pass: expired rows are archived; decay grows by the days since last use, up to 1; every row counts as used now."""
    anchor = F.coalesce("last_used_at", "updated_at").cast("bigint")
    days = F.greatest(F.lit(0.0), (F.lit(int(now)) - anchor) / 86_400_000.0)
    expired = F.coalesce(F.col("expires_at") <= now, F.lit(False))
    return capsules.withColumn("status", F.when(expired, "archived").otherwise(F.col("status"))).withColumn("decay_score", F.least(F.lit(1.0), F.col("decay_score") + per_day * days)).withColumn("last_used_at", F.lit(now))


def transition(capsules: DataFrame, tenant: str, capsule_id: str, status: str) -> DataFrame:
    """Compare and set: only a pending row changes."""
    return update_where(capsules, (F.col("tenant") == tenant) & (F.col("capsule_id") == capsule_id) & (F.col("status") == "pending_confirmation"), status=F.lit(status))


def touched(capsules: DataFrame, used: DataFrame, now: str) -> DataFrame:
    """last_used_at and last_recalled_at of the distinct ids used."""
    ids = used.select("tenant", "capsule_id").distinct().withColumn("hit_", F.lit(True))
    return update_where(capsules.join(ids, ["tenant", "capsule_id"], "left"), F.col("hit_"), last_used_at=F.lit(now), last_recalled_at=F.lit(now)).select(*capsules.columns)


def within_budget(rows: DataFrame, keys: list[str], most: int, *order: Column) -> DataFrame:
    """The first `most` writes of each key are accepted."""
    return rows.withColumn("slot", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).withColumn("accepted", F.col("slot") <= most)
