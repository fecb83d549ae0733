"""Embedding workers: one micro-batch of jobs, claimed, guarded, cut to chunks, embedded, checked again and committed; state in, state out.

All jobs of a batch go through the same joins, so a batch costs a fixed number of jobs of Spark whatever its size. What a job ends as is one column:
  no_provider, missing   the job asks for another provider, or its row is gone: for good
  stale                  the text has changed since the job was made, before or during the work
  ignored                somebody else settled the job meanwhile
  failed                 the provider gave no vector, or one of another length: tried again later
  completed              vectors replaced
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.embedding import Provider, deterministic, embed
from tessera.functions.subwords import subword_chunks
from tessera.functions.text import embed_input, redact
from tessera.functions.timefn import add_ms
from tessera.operators import queue as Q
from tessera.operators.neighbours import nearest_in_band
from tessera.operators.retrieval import SCALE
from tessera.operators.storage import cut, first_of_each, replace_by_key, update_where

FOR_GOOD = ("no_provider", "missing")


@dataclass
class Settings:
    provider: str
    dim: int = 64
    batch: int = 32
    most_attempts: int = 3
    call: Provider = deterministic
    #: How a text is cut to what the provider takes: windows of subwords, or of words where no vocabulary is at hand.
    windows: Callable[[Column], Column] = subword_chunks


@dataclass
class Tick:
    """The tables after a micro-batch, and what became of each claimed job (job_id, outcome, chunks)."""

    jobs: DataFrame
    vectors: DataFrame
    outcomes: DataFrame


def guard(claimed: DataFrame, rows: DataFrame, id_column: str, provider: str, check_hash: bool) -> DataFrame:
    """claimed jobs with the row they are about (`text`, `row_hash`) and `outcome`: why a job goes no further, null if it does."""
    found = rows.select("tenant", id_column, "text", F.col("content_hash").alias("row_hash"), F.lit(True).alias("there"))
    joined = claimed.join(found, ["tenant", id_column], "left")
    out = F.when(F.col("provider") != provider, "no_provider").when(F.col("there").isNull(), "missing")
    if check_hash:
        out = out.when(F.col("row_hash") != F.col("content_hash"), "stale")
    return joined.withColumn("outcome", out).drop("there")


def tick(jobs: DataFrame, rows: DataFrame, vectors: DataFrame, s: Settings, now: str, id_column: str, check_hash: bool, after: DataFrame | None = None, jobs_after: DataFrame | None = None) -> Tick:
    """rows: tenant, id, text, content_hash. after, jobs_after: both tables as they are once the provider has answered."""
    picked = cut(Q.claim(jobs, now, s.most_attempts, s.batch))  # s.batch rows; what follows reads the claim, not the queue
    taken = Q.claimed(jobs, picked, now)
    before = guard(picked, rows, id_column, s.provider, check_hash)
    pieces = before.where("outcome is null").select("job_id", F.posexplode(s.windows(F.col("text"))).alias("chunk", "piece"))
    made = cut(pieces.select("job_id", "chunk", embed(s.call)(F.col("piece")).alias("embedding")))
    sound = made.groupBy("job_id").agg(F.count("*").alias("chunks"), F.bool_and(F.coalesce(F.size("embedding") == s.dim, F.lit(False))).alias("sound"))
    again = guard(picked, rows if after is None else after, id_column, s.provider, check_hash).select("job_id", F.col("outcome").alias("later"))
    live = (taken if jobs_after is None else jobs_after).select("job_id", (F.col("status") == "processing").alias("live"))
    told = before.join(sound, "job_id", "left").join(again, "job_id").join(live, "job_id", "left")
    outcome = F.coalesce("outcome", F.when(~F.coalesce("sound", F.lit(False)), "failed"), "later", F.when(~F.coalesce("live", F.lit(False)), "ignored"), F.lit("completed"))
    outcomes = cut(told.select("job_id", "tenant", id_column, F.coalesce("row_hash", "content_hash").alias("content_hash"), outcome.alias("outcome"), F.coalesce("chunks", F.lit(0)).alias("chunks")))
    done = outcomes.where("outcome = 'completed'").select("job_id", "tenant", id_column, "content_hash")
    new = made.join(done, "job_id").select(id_column, "tenant", "chunk", "embedding", "content_hash")
    return Tick(settled(taken if jobs_after is None else jobs_after, outcomes, s.most_attempts, now), replace_by_key(vectors.select(*new.columns), new, [id_column]), outcomes)


# Fixed values of the neighbourhood that a committed vector gets.
NEAR_AT, LINK_AT, LOOKED_AT, MOST_LINKS = 0.92, 0.80, 12, 4


def neighbourhood(capsules: DataFrame, vectors: DataFrame, completed: DataFrame, now: str, near_at: float | None = NEAR_AT, link_at: float | None = LINK_AT) -> tuple[DataFrame, DataFrame]:
    """(capsules, edges) once the vectors of `completed` (capsule_id) are committed. Of an active capsule its 11 nearest live neighbours of the tenant are looked at, those embedded by the same model count.

    Neighbours at near_at or above are suspected copies: the capsule waits for review, and an edge points to the most complete of them (the longest content, then the earliest). Neighbours from link_at up to near_at, four at
    most, are linked. None switches a part off; without the first, links have no upper bound. vectors: capsule_id, chunk, embedding, model; the first chunk stands for a capsule."""
    live = capsules.where(~F.col("status").isin("archived", "rejected") & (F.col("capsule_type") != "diary")).select("capsule_id", "tenant", "status", F.octet_length("content").alias("bytes"), "created_at")
    rows = vectors.where("chunk = 0").select("capsule_id", "embedding", "model").join(live, "capsule_id")
    asks = rows.where("status = 'active'").join(completed.select("capsule_id"), "capsule_id", "left_semi").select("capsule_id")
    near = cut(nearest_in_band(rows, LOOKED_AT - 1, keys=("tenant",), queries=asks))
    side = lambda name: rows.select(F.col("capsule_id").alias(f"{name}_id"), F.col("model").alias(f"{name}_model"), F.col("bytes").alias(f"{name}_bytes"), F.col("created_at").alias(f"{name}_at"))
    known = near.join(side("from"), "from_id").join(side("to"), "to_id").where("from_model = to_model").select("from_id", "to_id", "sim", "to_bytes", "to_at")
    node = lambda c: F.concat(F.lit("capability_capsule:"), c)
    edge = lambda rows_, relation, extractor: rows_.select(
        node("from_id").alias("from_node"), node("to_id").alias("to_node"), F.lit(relation).alias("relation"), F.lit(now).alias("valid_from"), F.lit(None).cast("string").alias("valid_to"), (F.col("sim") / SCALE).alias("confidence"), F.lit(extractor).alias("extractor")
    )
    copies = known.where(F.lit(False) if near_at is None else F.col("sim") >= round(near_at * SCALE))
    flagged = first_of_each(copies, ["from_id"], F.desc("to_bytes"), F.asc("to_at"), F.asc("to_id"))
    band = F.lit(False) if link_at is None else (F.col("sim") >= round(link_at * SCALE)) & (F.lit(True) if near_at is None else F.col("sim") < round(near_at * SCALE))
    order = Window.partitionBy("from_id").orderBy(F.desc("sim"), "to_id")
    links = known.where(band).withColumn("rank_", F.row_number().over(order)).where(F.col("rank_") <= MOST_LINKS)
    marked = capsules.join(flagged.select(F.col("from_id").alias("capsule_id"), F.lit(True).alias("flagged_")), "capsule_id", "left")
    state = update_where(marked, F.col("flagged_"), status=F.lit("pending_confirmation")).select(*capsules.columns)
    return state, edge(flagged, "suspected_supersede", "o7_neardup_cluster").unionByName(edge(links, "related_to", "ingest_link"))


def settled(jobs: DataFrame, outcomes: DataFrame, most_attempts: int, now: str) -> DataFrame:
    """The queue after a batch: each job that is still ours takes the state of its outcome."""
    joined = jobs.join(outcomes.select("job_id", F.col("outcome").alias("o_")), "job_id", "left")
    attempt = F.col("attempts") + F.when(F.col("o_").isin("failed", *FOR_GOOD), 1).otherwise(0)
    retry = (F.col("o_") == "failed") & (attempt < most_attempts)
    status = F.when(F.col("o_").isin("completed", "stale"), F.col("o_")).when(retry, "failed").otherwise("dead_letter")
    ours = F.col("o_").isNotNull() & (F.col("o_") != "ignored") & (F.col("status") == "processing")
    return update_where(joined, ours, status=status, attempts=attempt, available_at=F.when(retry, add_ms(F.lit(now), Q.backoff_ms(attempt))).otherwise(F.col("available_at")), updated_at=F.lit(now)).select(*jobs.columns)


def capsule_rows(capsules: DataFrame) -> DataFrame:
    return capsules.select("tenant", "capsule_id", embed_input(F.col("summary"), F.col("content")).alias("text"), "content_hash")


def block_rows(blocks: DataFrame) -> DataFrame:
    return blocks.select("tenant", "block_id", redact(F.col("content")).alias("text"), F.sha2("content", 256).alias("content_hash"))


def embed_capsules(jobs: DataFrame, capsules: DataFrame, vectors: DataFrame, s: Settings, now: str, after: DataFrame | None = None, jobs_after: DataFrame | None = None) -> Tick:
    """A job is about one text of a capsule: if that changes, the job is stale."""
    return tick(jobs, capsule_rows(capsules), vectors, s, now, "capsule_id", True, None if after is None else capsule_rows(after), jobs_after)


def embed_blocks(jobs: DataFrame, blocks: DataFrame, vectors: DataFrame, s: Settings, now: str, jobs_after: DataFrame | None = None) -> Tick:
    """Blocks never change, so there is no text to compare; completions are flushed with the batch."""
    return tick(jobs, block_rows(blocks), vectors, s, now, "block_id", False, None, jobs_after)


def preview(jobs: DataFrame, now: str, most_attempts: int, limit: int) -> DataFrame:
    """What a claim would take, without taking it."""
    return Q.claim(jobs, now, most_attempts, max(1, min(200, limit))).select("job_id", "tenant", "status", "attempts", "available_at")


def schedulable() -> Column:
    """Rounds whose names are present, of bounded length and free of control characters."""
    sound = lambda c, most: (F.regexp_replace(c, r"\s", "") != "") & (F.octet_length(c) <= most) & ~F.col(c).rlike(r"\p{Cc}")
    fingerprint = (F.col("task_fingerprint") != "") & (F.octet_length("task_fingerprint") <= 256)
    return F.coalesce(sound("tenant", 256) & sound("caller_agent", 256) & sound("session_id", 1024) & fingerprint, F.lit(False))
