"""Sessions of agents, reads of published rounds, settled proposals, rebuilt embeddings: small lifecycle steps as state in, state out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import SPACE, trimmed
from tessera.functions.timefn import minutes_between
from tessera.operators.storage import first_of_each, update_where

# Idle time of a session, rows of a published read.
IDLE_MINUTES, MOST_ROUNDS = 30, 1000


def latest_open(sessions: DataFrame) -> DataFrame:
    """The open session seen last of each (tenant, agent)."""
    return first_of_each(sessions.where("ended_at is null"), ["tenant", "caller_agent"], F.desc("last_seen_at"), F.asc("session_id"))


def decide(sessions: DataFrame, arrivals: DataFrame, idle: int = IDLE_MINUTES) -> DataFrame:
    """arrivals (tenant, caller_agent, now): the session that goes on, or null where a new one opens."""
    minutes = minutes_between(F.col("last_seen_at"), F.col("now"))
    joined = arrivals.join(latest_open(sessions), ["tenant", "caller_agent"], "left")
    return joined.withColumn("session_id", F.when((minutes >= 0) & (minutes < idle), F.col("session_id"))).select("tenant", "caller_agent", "now", "session_id")


def touch(sessions: DataFrame, seen: DataFrame) -> DataFrame:
    """seen (session_id, at): last_seen_at never goes back, so late events do no harm; the count grows by the events."""
    per = seen.groupBy("session_id").agg(F.max("at").alias("at_"), F.count("*").alias("n_"))
    out = sessions.join(per, "session_id", "left")
    return out.withColumn("last_seen_at", F.greatest("last_seen_at", "at_")).withColumn("memory_count", F.col("memory_count") + F.coalesce("n_", F.lit(0))).select(*sessions.columns)


def close(sessions: DataFrame, session_id: str, now: str) -> DataFrame:
    return update_where(sessions, (F.col("session_id") == session_id) & F.col("ended_at").isNull(), ended_at=F.lit(now))


def publish(rounds: DataFrame, build_id: str) -> DataFrame:
    """Rows of a new generation; readers see it when the head moves."""
    return rounds.withColumn("build_id", F.lit(build_id))


def latest_rounds(heads: DataFrame, builds: DataFrame, rounds: DataFrame) -> DataFrame:
    """Rounds of each session's head build, if that is completed; degraded where the count is not what the build said."""
    ready = heads.join(builds.where("status = 'completed'").select("build_id", "round_count"), "build_id")
    found = rounds.groupBy("build_id").agg(F.count("*").alias("found"))
    state = ready.join(found, "build_id", "left").withColumn("degraded", F.coalesce("found", F.lit(0)) != F.col("round_count"))
    return state.join(rounds, "build_id", "left")


def settle(candidates: DataFrame, placeholder_id: str, verdict: str) -> DataFrame:
    """Executed candidates whose results hold the placeholder get the verdict."""
    return update_where(candidates, (F.col("status") == "executed") & F.array_contains("result_ids", placeholder_id), status=F.lit(verdict))


def promote(capsules: DataFrame, chosen: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """Chosen pending rows become active; each leaves an auto_promoted event."""
    hit = chosen.select("capsule_id", F.lit(True).alias("hit_")).distinct()
    rows = capsules.join(hit, "capsule_id", "left")
    out = update_where(rows, F.col("hit_") & (F.col("status") == "pending_confirmation"), status=F.lit("active"), updated_at=F.lit(now)).select(*capsules.columns)
    events = rows.where(F.col("hit_") & (F.col("status") == "pending_confirmation")).select(F.concat(F.lit("fb_auto_"), "capsule_id").alias("feedback_id"), "capsule_id", F.lit("auto_promoted").alias("kind"), F.lit(now).alias("created_at"))
    return out, events


def rebuild_embeddings(capsules: DataFrame, vectors: DataFrame, ids: DataFrame, force: bool, provider: str, now: str) -> tuple[DataFrame, DataFrame]:
    """Vectors (without those of the ids, if forced) and the jobs to enqueue."""
    asked = capsules.join(ids.select("capsule_id").distinct(), "capsule_id", "left_semi")
    kept = vectors.join(ids.select("capsule_id").distinct(), "capsule_id", "left_anti") if force else vectors
    jobs = asked.select(F.concat(F.lit("job_"), "capsule_id").alias("job_id"), "tenant", "capsule_id", "content_hash", F.lit(provider).alias("provider"), F.lit("pending").alias("status"), F.lit(now).alias("available_at"))
    return kept, jobs


def scope_from_path(cwd: Column) -> Column:
    """project: and repo: filters of the last part of a path."""
    name = F.element_at(F.split(F.regexp_replace(cwd, "/+$", ""), "/"), -1)
    return F.when(name != "", F.array(F.concat(F.lit("project:"), name), F.concat(F.lit("repo:"), name)))


def agent_of(caller: Column) -> Column:
    low = F.lower(caller)
    return F.when(low.contains("claude"), "claude_code").when(low.contains("codex"), "codex").when((low == "pi") | low.startswith("pi-"), "pi").otherwise("unknown")


def emitted_ids(*sections: str) -> Column:
    """Ids of all sections, each once, in order."""
    return F.array_distinct(F.concat(*(F.col(s) for s in sections)))


def reply_list(reply: Column, most: int) -> Column:
    """Strings of the outermost [...] of a reply, of 12 to 400 characters, distinct, `most` at most; empty where there is none."""
    body = F.regexp_extract(reply, r"(\[[\s\S]*\])", 1)
    items = F.coalesce(F.from_json(body, "array<string>"), F.array().cast("array<string>"))
    return F.slice(F.array_distinct(F.filter(F.transform(items, lambda x: trimmed(x)), lambda x: F.char_length(x).between(12, 400))), 1, most)


def reply_object(reply: Column) -> Column:
    """title and steps of the outermost {...} of a reply; null without both."""
    parsed = F.from_json(F.regexp_extract(reply, r"(\{[\s\S]*\})", 1), "title string, steps array<string>")
    steps = F.filter(F.transform(parsed["steps"], lambda x: trimmed(F.regexp_replace(x, SPACE + "+", " "))), lambda x: x != "")
    return F.when((trimmed(parsed["title"]) != "") & (F.size(steps) > 0), F.struct(trimmed(parsed["title"]).alias("title"), steps.alias("steps")))


def evidence_block() -> Column:
    """A block as text: role, type, tool, then its content."""
    return F.format_string("[%s/%s%s]\n%s", "role", "block_type", F.coalesce(F.concat(F.lit(" "), "tool_name"), F.lit("")), "content")
