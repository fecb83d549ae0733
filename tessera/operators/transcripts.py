"""Transcript reads: roll-ups, pages, context windows, merged windows, scores, message groups, sessions by inactivity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.scoring import rrf

CHRONO = ("created_at", "line_number", "block_index")
# Fixed values of the transcript score.
ANCHOR_BONUS, COOCCUR_STEP, COOCCUR_MOST = 20, 3, 4


def at() -> Column:
    return F.struct(*(F.col(c) for c in CHRONO))


def session_rollup(blocks: DataFrame, tenant: str | None = None) -> DataFrame:
    rows = blocks.where(F.col("session_id").isNotNull())
    rows = rows.where(F.col("tenant") == tenant) if tenant else rows
    return rows.groupBy("tenant", "session_id").agg(F.count("*").alias("blocks"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"), F.max("caller_agent").alias("caller_agent"))


def page(blocks: DataFrame, tenant: str, cursor: tuple | None, limit: int, session_id: str | None = None, since: str | None = None, until: str | None = None, role: str | None = None, block_type: str | None = None) -> DataFrame:
    """Blocks after the cursor in time, up to limit; since is inclusive, until is not. Without a session: all sessions, ties by block id."""
    rows = blocks.where((F.col("tenant") == tenant) & (F.col("session_id") == session_id if session_id else F.col("session_id").isNotNull()))
    for condition in (since and F.col("created_at") >= since, until and F.col("created_at") < until, role and F.col("role") == role, block_type and F.col("block_type") == block_type):
        if condition is not None and not isinstance(condition, str):
            rows = rows.where(condition)
    order = [*CHRONO, "block_id"]
    if cursor:
        names = order[: len(cursor)]
        rows = rows.where(F.struct(*(F.col(c) for c in names)) > F.struct(*(F.lit(v).cast(blocks.schema[c].dataType).alias(c) for c, v in zip(names, cursor, strict=True))))
    top = rows.orderBy(*order).limit(limit + 1)
    numbered = top.withColumn("pos", F.row_number().over(Window.orderBy(*order)))  # limit + 1 rows
    return numbered.withColumn("has_more", F.max("pos").over(Window.partitionBy()) > limit).where(F.col("pos") <= limit)


def newest(blocks: DataFrame, tenant: str, limit: int, session_id: str | None = None) -> DataFrame:
    rows = blocks.where((F.col("tenant") == tenant) & F.col("embed_eligible"))
    rows = rows.where(F.col("session_id") == session_id) if session_id else rows
    return rows.orderBy(*(F.desc(c) for c in CHRONO), F.desc("block_id")).limit(max(1, min(1024, limit)))


def context_windows(blocks: DataFrame, hits: DataFrame, before: int, after: int, tools: bool = True) -> DataFrame:
    """block_id, before, after: ids around each hit in its session, in time. Only sessions that hold a hit are read into the window."""
    rows = blocks.join(hits.join(blocks.select("block_id", "tenant", "session_id"), "block_id").select("tenant", "session_id").distinct(), ["tenant", "session_id"], "left_semi")
    kept = rows if tools else rows.where(~F.col("block_type").isin("tool_use", "tool_result") | F.col("block_id").isNull())
    if not tools:  # a hit stays, tool block or not
        kept = kept.unionByName(rows.where(F.col("block_type").isin("tool_use", "tool_result")).join(hits.select("block_id"), "block_id", "left_semi").select(*rows.columns))
    w = Window.partitionBy("tenant", "session_id").orderBy(*CHRONO, "block_id")
    around = kept.select(
        "block_id", "session_id", "created_at",
        F.collect_list("block_id").over(w.rowsBetween(-before, -1)).alias("before"), F.collect_list("block_id").over(w.rowsBetween(1, after)).alias("after"),
        F.min("created_at").over(w.rowsBetween(-before, 0)).alias("first_at"), F.max("created_at").over(w.rowsBetween(0, after)).alias("last_at"),
    )
    return around.join(hits, "block_id")


def merge_windows(windows: DataFrame) -> DataFrame:
    """Overlapping windows of a session become one: session_id, island, first_at, last_at, hits, score. Windows without a session stay alone."""
    key = F.coalesce(F.concat(F.lit("s:"), F.col("session_id")), F.concat(F.lit("b:"), F.col("block_id")))
    w = Window.partitionBy("key").orderBy("created_at", "block_id")
    opened = windows.withColumn("key", key).withColumn("reach", F.max("last_at").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    islands = opened.withColumn("island", F.sum(F.when(F.col("reach").isNull() | (F.col("first_at") > F.col("reach")), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy("key", "island").agg(F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), F.count("*").alias("hits"), F.max("score").alias("score"))


def score_hits(candidates: DataFrame, lexical: DataFrame, semantic: DataFrame, anchor_session: str | None = None) -> DataFrame:
    """Each channel's share is rounded alone; blocks of one session lift each other; the anchor's session gets a bonus; newer is better."""
    per_session = candidates.where("session_id is not null").groupBy("session_id").agg(F.count("*").alias("together"))
    top = candidates.agg(F.max(F.col("created_at").cast("bigint"))).scalar()
    rows = (
        candidates.join(lexical.select("block_id", F.col("rank").alias("lr")), "block_id", "left").join(semantic.select("block_id", F.col("rank").alias("sr")), "block_id", "left").join(per_session, "session_id", "left")
    )
    fresh = F.lit(6) - F.least(F.lit(20), F.floor((top - F.col("created_at").cast("bigint")) / 10000)).cast("bigint")
    score = (
        F.coalesce(rrf(F.col("lr")), F.lit(0)) + F.coalesce(rrf(F.col("sr")), F.lit(0)) + COOCCUR_STEP * F.least(F.lit(COOCCUR_MOST), F.coalesce(F.col("together"), F.lit(1)) - 1)
        + F.when(F.col("session_id") == F.lit(anchor_session), ANCHOR_BONUS).otherwise(0) + fresh
    )
    return rows.withColumn("score", score.cast("bigint"))


def message_groups(blocks: DataFrame, keys: tuple[str, ...] = ("transcript_path",)) -> DataFrame:
    """group_no per transcript: a new group wherever message_uuid (or the line, where both lack one) changes."""
    w = Window.partitionBy(*keys).orderBy("line_number", "block_index", *(["block_id"] if "block_id" in blocks.columns else []))
    previous, line = F.lag("message_uuid").over(w), F.lag("line_number").over(w)
    same = F.when(F.col("message_uuid").isNull() & previous.isNull(), line == F.col("line_number")).otherwise(F.coalesce(F.col("message_uuid") == previous, F.lit(False)))
    marked = blocks.withColumn("new_", F.when(line.isNull() | ~F.coalesce(same, F.lit(False)), 1).otherwise(0))
    return marked.withColumn("group_no", F.sum("new_").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("new_")


def sessions_by_inactivity(events: DataFrame, keys: list[str], idle_minutes: int = 30) -> DataFrame:
    """session_no per key: an event belongs to the running session while less than idle_minutes have passed since the last one (whole minutes)."""
    w = Window.partitionBy(*keys).orderBy("at_ms", "event_id")
    gap = F.floor((F.col("at_ms") - F.lag("at_ms").over(w)) / 60000)
    marked = events.withColumn("new_", F.when(gap.isNull() | (gap >= idle_minutes), 1).otherwise(0))
    return marked.withColumn("session_no", F.sum("new_").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("new_")


def recent_highlights(blocks: DataFrame, tenant: str, sessions: int, per_session: int) -> DataFrame:
    """The newest eligible blocks of the newest sessions, out of the tenant's newest max(50, 20 x per_session) blocks."""
    pool = newest(blocks.where(F.col("session_id").isNotNull()), tenant, max(50, 20 * per_session))
    latest = pool.groupBy("session_id").agg(F.max("created_at").alias("last_at")).orderBy(F.desc("last_at"), "session_id").limit(sessions)
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy(*(F.desc(c) for c in CHRONO)))
    return pool.join(latest, "session_id").withColumn("pos", rank).where(F.col("pos") <= per_session)


def by_ids_in_order(blocks: DataFrame, tenant: str, ids: list[str]) -> DataFrame:
    wanted = blocks.sparkSession.createDataFrame([(i, x) for i, x in enumerate(ids)], "pos int, block_id string")
    return blocks.where(F.col("tenant") == tenant).join(wanted, "block_id").orderBy("pos")
