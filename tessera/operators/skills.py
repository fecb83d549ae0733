"""Governed skills: drafts and manifests, immutable versions behind heads, loadouts, session pins, feedback that asks for a revision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.timefn import add_ms
from tessera.operators.storage import append_new, replace_by_key, update_where

# Limits of bundles, loadouts, pins and feedback.
MOST_FILES, MOST_FILE_BYTES, MOST_BUNDLE_BYTES = 64, 1 << 20, 4 << 20
PIN_MS = 24 * 3_600_000
NEGATIVES = 3
MOST_BINDINGS = 64


def placeholders(steps: Column) -> Column:
    """Names in {{...}} of all steps, distinct."""
    return F.array_distinct(F.flatten(F.transform(steps, lambda s: F.regexp_extract_all(s, F.lit(r"\{\{([a-z0-9_]+)\}\}"), 1))))


def draft_valid(steps: Column, declared: Column) -> Column:
    """Exactly the placeholders used are declared."""
    used = placeholders(steps)
    return (F.size(F.array_except(used, declared)) == 0) & (F.size(F.array_except(declared, used)) == 0)


def manifest_problem(files: Column) -> Column:
    """files: array of (path, sha256, bytes). Null if sound."""
    paths = F.transform(files, lambda f: f["path"])
    folded = F.transform(paths, F.lower)
    total = F.aggregate(files, F.lit(0).cast("bigint"), lambda a, f: a + f["bytes"])
    return (
        F.when(F.size(F.filter(paths, lambda p: p == "SKILL.md")) != 1, "one SKILL.md").when(F.size(files) > MOST_FILES, "too many files").when(F.exists(files, lambda f: f["bytes"] > MOST_FILE_BYTES), "file too large")
        .when(total > MOST_BUNDLE_BYTES, "bundle too large").when(F.size(F.array_distinct(folded)) < F.size(folded), "paths collide").when(F.exists(paths, lambda p: p.startswith("/") | p.contains("..")), "path leaves the bundle")
        .when(F.exists(files, lambda f: ~f["sha256"].rlike("^[0-9a-f]{64}$")), "no digest")
    )


def manifest_digest(files: Column) -> Column:
    return F.sha2(F.to_json(F.array_sort(files)), 256)


def append_versions(versions: DataFrame, incoming: DataFrame) -> DataFrame:
    """Versions are immutable: what is there stays."""
    return append_new(versions, incoming, ["tenant", "skill_id", "version_id"], F.asc("manifest_sha256"))


def put_blobs(blobs: DataFrame, incoming: DataFrame) -> DataFrame:
    return append_new(blobs, incoming, ["sha256"], F.asc("sha256"))


def move_head(heads: DataFrame, tenant: str, skill_id: str, expected: str | None, version_id: str) -> DataFrame:
    """Compare and set."""
    hit = (F.col("tenant") == tenant) & (F.col("skill_id") == skill_id) & F.col("version_id").eqNullSafe(F.lit(expected))
    return update_where(heads, hit, version_id=F.lit(version_id))


def bind(bindings: DataFrame, incoming: DataFrame) -> DataFrame:
    """Bindings after an upsert, the first MOST_BINDINGS of each agent."""
    merged = replace_by_key(bindings, incoming, ["tenant", "agent_id", "skill_id"])
    pos = F.row_number().over(Window.partitionBy("tenant", "agent_id").orderBy(F.desc("priority"), "skill_id"))
    return merged.withColumn("pos", pos).where(F.col("pos") <= MOST_BINDINGS).drop("pos")


def resolve_loadout(bindings: DataFrame, heads: DataFrame, pins: DataFrame, revoked: DataFrame, anchors: DataFrame, session_id: str, now: str) -> DataFrame:
    """What an agent runs: enabled bindings with the session's unexpired pin, else the head; no revoked version; an active anchor."""
    open_pins = pins.where((F.col("session_id") == session_id) & (F.col("expires_at") > now)).select("tenant", "agent_id", "skill_id", F.col("version_id").alias("pinned"))
    rows = bindings.where("enabled").join(open_pins, ["tenant", "agent_id", "skill_id"], "left").join(heads.select("tenant", "skill_id", F.col("version_id").alias("head")), ["tenant", "skill_id"], "left")
    chosen = rows.withColumn("version_id", F.coalesce("pinned", "head")).where("version_id is not null")
    live = chosen.join(revoked.select("tenant", "version_id"), ["tenant", "version_id"], "left_anti").join(anchors.where("status = 'active'").select("tenant", "skill_id"), ["tenant", "skill_id"], "left_semi")
    return live.withColumn("pos", F.row_number().over(Window.partitionBy("tenant", "agent_id").orderBy(F.desc("priority"), "skill_id")))


def pin(pins: DataFrame, asked: DataFrame, now: str) -> DataFrame:
    """Pins after asked (tenant, session_id, agent_id, skill_id, version_id): an open pin stays, an expired one is made anew with the next revision."""
    key = ["tenant", "session_id", "agent_id", "skill_id"]
    old = pins.select(*key, F.col("version_id").alias("v"), F.col("expires_at").alias("e"), F.col("revision").alias("r"))
    joined = asked.dropDuplicates(key).join(old, key, "left")
    stays = F.coalesce(F.col("e") > now, F.lit(False))
    made = joined.select(*key, F.when(stays, F.col("v")).otherwise(F.col("version_id")).alias("version_id"), F.when(stays, F.col("e")).otherwise(add_ms(F.lit(now), PIN_MS)).alias("expires_at"), F.when(stays, F.col("r")).otherwise(F.coalesce(F.col("r"), F.lit(0)) + 1).cast("bigint").alias("revision"))
    return replace_by_key(pins.select(made.columns), made, key)


def revision_jobs(feedback: DataFrame) -> DataFrame:
    """Each full triple of negative feedback on a version asks for one revision: the last of each triple is its trigger."""
    negative = feedback.where("negative")
    n = F.row_number().over(Window.partitionBy("tenant", "skill_id", "version_id").orderBy("created_at", "feedback_id"))
    return negative.withColumn("n", n).where(F.col("n") % NEGATIVES == 0).select("tenant", "skill_id", "version_id", (F.col("n") / NEGATIVES).cast("bigint").alias("revision"), F.col("feedback_id").alias("trigger_id"))


def exact_duplicates(drafts: DataFrame, catalogue: DataFrame) -> DataFrame:
    """drafts with the first workflow of equal signature."""
    first = catalogue.groupBy("tenant", "signature").agg(F.min("capsule_id").alias("duplicate_of"))
    return drafts.join(first, ["tenant", "signature"], "left")


def is_placeholder(content: Column) -> Column:
    """A workflow that is still to be written: all three marks."""
    low = F.lower(content)
    return low.contains("placeholder") & low.contains("pending review") & low.contains("sources:")


def one_per_key(table: DataFrame, incoming: DataFrame, *keys: str) -> DataFrame:
    """Terminal receipts, revision candidates, feedback: the first of each key lands."""
    return append_new(table, incoming, list(keys), *(F.asc(k) for k in keys))
