"""Sweeps the lifecycle of all capsules: a batch job, run once a day.

Reads the capsules and the feedback given on them, and writes the state of every capsule after the sweep: feedback moves confidence and decay, time decays what is not used, what has expired is archived, pending
capsules that have lain long and hardly decayed are promoted, and idle ones of low value are archived. `action` says what the sweep did.

Tables under `output`: state (partitioned by tenant) and report (partitioned by swept_at and tenant: how many capsules have which status, before and after). A run replaces the partitions of the tenants that it
sweeps, all or those named, and no others: run again, it leaves the same tables. Texts are read for the rule of low value alone and shuffled nowhere; feedback is summed before its shuffle; a tenant of any
size is written by as many tasks as it needs.

Defined results: capsules without feedback keep their confidence; feedback on no capsule counts nowhere; a null tenant is the tenant ''. An empty table of capsules leaves no partitions. Rows that repeat an id are swept each.

    python -m jobs.sweep_lifecycle --config jobs/sweep_lifecycle.json --tables /data/store --output /data/swept --now 00000001704900000000
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import command_line, log, replace_partitions
from tessera.fixtures import view
from tessera.functions.timefn import cutoff
from tessera.operators.capsules import idle_candidate, low_value_reason, promotable
from tessera.operators.queue import apply_feedback, decay
from tessera.schemas import STATUSES

DAY = 86_400
STATE = ("capsule_id", "capsule_type", "status_before", "status", "confidence", "decay_score", "last_used_at", "validated_at", "action", "tenant")
REPORT = ("status", "before", "after", "swept_at", "tenant")


def swept(capsules: DataFrame, feedback: DataFrame, now: str, promote_after_days: int, promote_types: list[str], promote_max_decay: float, idle_after_days: int, idle_max_confidence: float, idle_min_decay: float, low_value_chars: int) -> DataFrame:
    """The state of each capsule after feedback, decay, promotion and archiving, in this order."""
    keep = ("capsule_id", "capsule_type", "status", "confidence", "decay_score", "created_at", "updated_at", "last_used_at", "last_recalled_at", "expires_at")
    rows = capsules.select(*keep, F.coalesce("tenant", F.lit("")).alias("tenant"), F.col("status").alias("status_before"), low_value_reason(low_value_chars).isNotNull().alias("low_value"))  # the text goes no farther
    told = apply_feedback(rows, feedback).withColumn("by_feedback", ~F.col("status").eqNullSafe(F.col("status_before"))).withColumn("told", F.col("status"))
    aged = decay(told, now).withColumn("expired", ~F.col("status").eqNullSafe(F.col("told")))
    promote = promotable(cutoff(now, promote_after_days * DAY), promote_types, promote_max_decay)
    idle = idle_candidate(cutoff(now, idle_after_days * DAY), idle_max_confidence, idle_min_decay, low_value=F.col("low_value"))
    action = F.when(F.col("expired"), "expired").when(F.col("by_feedback"), "by_feedback").when(promote, "promoted").when(idle, "archived_idle")
    status = F.when(F.col("action") == "promoted", "active").when(F.col("action") == "archived_idle", "archived").otherwise(F.col("status"))
    return aged.withColumn("action", action).withColumn("status", status).select(*STATE)


def run(
    spark: SparkSession, tables: str, output: str, now: str, tenants: list[str] = (), promote_after_days: int = 7, promote_types: list[str] = ("experience", "episode"), promote_max_decay: float = 0.45,
    idle_after_days: int = 9, idle_max_confidence: float = 0.5, idle_min_decay: float = 0.25, low_value_chars: int = 400,
) -> dict[str, int]:
    """Sweeps the tenants named, or all, and returns how much it read and wrote."""
    capsules, feedback = view(spark, tables, "capsules"), view(spark, tables, "feedback")
    if tenants:
        capsules = capsules.where(F.coalesce("tenant", F.lit("")).isin(list(tenants)))
    state = swept(capsules, feedback, now, promote_after_days, list(promote_types), promote_max_decay, idle_after_days, idle_max_confidence, idle_min_decay, low_value_chars)
    replace_partitions(state.hint("rebalance", "tenant"), f"{output}/state", "tenant")
    stored = spark.read.schema(state.schema).parquet(f"{output}/state")
    if tenants:
        stored = stored.where(F.col("tenant").isin(list(tenants)))
    each = stored.groupBy("tenant").agg(*(F.count_if(F.col(c) == s).alias(f"{c}.{s}") for c in ("status_before", "status") for s in STATUSES), F.count("*").alias("rows"))
    report = each.select("tenant", "rows", F.explode(F.array(*(F.struct(F.lit(s).alias("status"), F.col(f"`status_before.{s}`").alias("before"), F.col(f"`status.{s}`").alias("after")) for s in STATUSES))).alias("r"))
    replace_partitions(report.select("r.*", F.lit(now).alias("swept_at"), "tenant").select(*REPORT), f"{output}/report", "swept_at", "tenant")
    counts = {"capsules_read": stored.count(), "feedback_read": feedback.count(), "changed": stored.where("action is not null").count()}
    log.info("sweep_lifecycle: read %(capsules_read)s capsules and %(feedback_read)s rows of feedback, changed the status of %(changed)s", counts)
    log.info("sweep_lifecycle: wrote %s rows to %s/state and their histogram to %s/report", counts["capsules_read"], output, output)
    return counts


def read_back(spark: SparkSession, output: str, now: str) -> DataFrame:
    """The state of each capsule, beside the histogram of its tenant and status."""
    state = spark.read.schema("capsule_id string, capsule_type string, status_before string, status string, confidence double, decay_score double, last_used_at string, validated_at string, action string, tenant string").parquet(f"{output}/state")
    report = spark.read.schema("status string, before bigint, after bigint, swept_at string, tenant string").parquet(f"{output}/report").where(F.col("swept_at") == now)
    return state.join(report.drop("swept_at"), ["tenant", "status"], "left")


if __name__ == "__main__":
    command_line(__doc__.split("\n")[0], Path(__file__).with_suffix(".json"), run)
