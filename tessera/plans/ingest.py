"""Ingest of a batch: hash, find what is stored or repeated, validate, summarise, settle the status, derive edges and jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.text import redact, summarize, trimmed
from tessera.operators.capsules import initial_status, low_value_reason
from tessera.operators.graph import edge_drafts


def problem(quality_gate: bool = True) -> Column:
    """Why a request is refused; null if it is not."""
    out = F.when(F.col("summary") == F.col("content"), "summary repeats content").when(F.col("scope").isin("project", "repo") & (F.coalesce(trimmed("project"), F.lit("")) == ""), "scope needs a project")
    return out.when(low_value_reason().isNotNull(), low_value_reason()) if quality_gate else out


def outcomes(requests: DataFrame, capsules: DataFrame, quality_gate: bool = True) -> DataFrame:
    """requests (request_id, tenant, idempotency_key, content_hash, ...) with outcome: stored, repeated, refused or new, and the id that stands for it.

    Keys and hashes are joined apart (two equi-joins, no OR), so each join shuffles by one key."""
    known_key = capsules.where("idempotency_key is not null").groupBy("tenant", "idempotency_key").agg(F.max_by("capsule_id", F.struct("updated_at", "capsule_id")).alias("by_key"))
    known_hash = capsules.groupBy("tenant", "content_hash").agg(F.max_by("capsule_id", F.struct("updated_at", "capsule_id")).alias("by_hash"))
    first_key = F.first_value("request_id").over(Window.partitionBy("tenant", F.coalesce("idempotency_key", "request_id")).orderBy("request_id"))
    first_hash = F.first_value("request_id").over(Window.partitionBy("tenant", "content_hash").orderBy("request_id"))
    rows = requests.join(known_key, ["tenant", "idempotency_key"], "left").join(known_hash, ["tenant", "content_hash"], "left")
    rows = rows.withColumn("first_id", F.least(first_key, first_hash)).withColumn("problem", problem(quality_gate))
    outcome = F.when(F.coalesce("by_key", "by_hash").isNotNull(), "stored").when(F.col("problem").isNotNull(), "refused").when(F.col("first_id") != F.col("request_id"), "repeated").otherwise("new")
    stands = F.coalesce("by_key", "by_hash", F.when(F.col("problem").isNull(), F.col("first_id")))
    return rows.withColumn("outcome", outcome).withColumn("stands_for", stands)


def new_capsules(decided: DataFrame, now: str) -> DataFrame:
    """Rows to append for the new ones: summary, first status, stamps."""
    mode = F.coalesce("write_mode", F.lit("auto")) if "write_mode" in decided.columns else F.lit("auto")
    summary = F.coalesce(F.when(trimmed("summary") != "", F.col("summary")), summarize(F.col("content")))
    return decided.where("outcome = 'new'").withColumn("summary", summary).withColumn("status", initial_status(F.col("capsule_type"), mode)).withColumn("created_at", F.lit(now)).withColumn("updated_at", F.lit(now))


def side_effects(new: DataFrame, provider: str, now: str) -> tuple[DataFrame, DataFrame]:
    """Edges and embedding jobs of new capsules."""
    edges = edge_drafts(new).withColumn("valid_from", F.lit(now)).withColumn("valid_to", F.lit(None).cast("string"))
    text = redact(F.concat_ws("\n", "summary", "content"))
    jobs = new.select(F.concat(F.lit("job_"), "capsule_id").alias("job_id"), "tenant", "capsule_id", F.sha2(text, 256).alias("content_hash"), F.lit(provider).alias("provider"), F.lit("pending").alias("status"), F.lit(now).alias("available_at"))
    return edges, jobs
