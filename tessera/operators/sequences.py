"""Rounds of tool use in transcripts, cohorts that repeat, and jobs planned from them.

Rounds come from windows over a transcript's message groups, so no transcript is gathered in one row. The greedy cohort scan depends on order; it
streams over sorted partitions and remembers as many rows as a cohort has, whatever the size of a key."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from tessera.functions.hashing import MOST_TASK_BYTES, TASK_VERSION, round_id, task_text, versioned
from tessera.functions.timefn import normalize_event_time
from tessera.functions.text import final_answer_phase, tool_family, tool_result_is_error, trimmed
from tessera.operators.transcripts import message_groups

PLACE = ("line_number", "block_index", "block_id")
STREAM = ["tenant", "caller_agent", "session_id", "transcript_path"]
# Fixed values of the planner.
COHORT, MIN_SESSIONS, REPEAT_MS = 3, 2, 30 * 86_400_000
VOLUME_TOOLS, MOST_EVIDENCE = 10, 8


def human() -> Column:
    return (F.col("role") == "user") & (F.col("block_type") == "text") & (trimmed("content") != "")


def call() -> Column:
    return F.col("block_type") == "tool_use"


def result() -> Column:
    return F.col("block_type") == "tool_result"


def in_order(*keys: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy("line_number", "block_index", "block_id")


def until_now(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def segments(blocks: DataFrame) -> DataFrame:
    """group_no and segment_no for each block of a session: a segment opens at the first human input and at human input that comes after activity of the agent. Blocks before the first human
    input lie in segment 0, which is none. One shuffle, by transcript; all windows share it."""
    w, of_group = in_order(*STREAM), Window.partitionBy(*STREAM, "group_no")
    rows = message_groups(blocks.where(F.col("session_id").isNotNull()), tuple(STREAM))
    rows = rows.withColumn("human_", F.max(human()).over(of_group)).withColumn("agent_", ~F.col("human_") & F.max(F.col("role") == "assistant").over(of_group))
    rows = rows.withColumn("acts_", F.count_if("agent_").over(until_now(w)))
    before = F.last(F.when(F.col("human_"), F.col("acts_")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))  # what the agent had done at the last human input
    opens = F.col("human_") & (before.isNull() | (F.col("acts_") > before))
    return rows.withColumn("open_", F.coalesce(opens, F.lit(False))).withColumn("segment_no", F.count_if("open_").over(until_now(w))).drop("human_", "agent_", "acts_", "open_")


def matched_results(rows: DataFrame, *keys: str) -> DataFrame:
    """rows with matched: whether a tool result answers a call. A result takes a call of its id that is open at its place, so calls and results of an id are brackets: their running balance falls
    to a new least exactly at the results that no open call precedes. Results without an id answer nothing."""
    w = in_order(*keys, "tool_use_id")
    named = F.col("tool_use_id").isNotNull()
    step = F.when(named & call(), 1).when(named & result(), -1).otherwise(0)
    rows = rows.withColumn("balance_", F.sum(step).over(until_now(w)))
    rows = rows.withColumn("least_", F.least(F.lit(0), F.min("balance_").over(until_now(w))))
    fell = F.col("least_") < F.coalesce(F.lag("least_").over(w), F.lit(0))
    return rows.withColumn("matched", result() & named & ~fell).drop("balance_", "least_")


def completed_rounds(blocks: DataFrame) -> DataFrame:
    """One row per complete segment: it has tool calls, its last message of the agent's final text comes after all messages with tool activity. Rounds are clean where every call has its result and every result its call.

    Segments and matches are windows that share one shuffle by transcript; what is collected of a segment is its calls and at most 64 KiB of what the human said in it, for the fingerprint of its task."""
    key = [*STREAM, "segment_no"]
    s = segments(blocks).where("segment_no > 0").withColumn("uses_", F.max(call()).over(Window.partitionBy(*STREAM, "group_no")))
    s = s.withColumn("last_", F.max("segment_no").over(Window.partitionBy(*STREAM)))
    said = F.when(human(), trimmed("content"))
    s = matched_results(s, *key).withColumn("said_bytes_", F.sum(F.octet_length(said) + 1).over(until_now(in_order(*key))) - 1)
    at = F.struct("group_no", *PLACE, "message_uuid", "created_at")
    # the last word of the agent: text, in a message without tool calls, that its metadata do not call a step
    final = (F.col("role") == "assistant") & (F.col("block_type") == "text") & (trimmed("content") != "") & ~F.col("uses_") & final_answer_phase(F.col("meta_json"))
    family = F.when(F.col("tool_name").isNotNull(), tool_family(F.col("tool_name")))
    calls = F.array_sort(F.collect_list(F.when(call(), F.struct(*PLACE, F.col("tool_use_id").alias("id"), family.alias("family")))))
    told = F.array_sort(F.collect_list(F.when(said.isNotNull() & (F.col("said_bytes_") <= MOST_TASK_BYTES), F.struct(*PLACE, said.alias("said")))))
    flag = tool_result_is_error(F.col("meta_json"))
    per = s.groupBy(*key).agg(
        F.count_if(call()).cast("bigint").alias("tools"), F.count_if("matched").alias("matched"), F.count_if(result() & ~F.col("matched")).alias("orphan"),
        F.count_if(F.col("matched") & F.coalesce(flag, F.lit(False))).alias("errors"), F.count_if(F.col("matched") & flag.isNull()).alias("unknown"),
        F.max(F.when(call() | result(), F.col("group_no"))).alias("last_tool_group"), F.max(F.when(final, at)).alias("final_at"), F.min(F.when(human(), F.struct(*PLACE, "message_uuid"))).alias("start_at"),
        calls.alias("calls"), told.alias("told"), F.max("said_bytes_").alias("said_bytes"), F.first("last_").alias("last_segment"),
    )
    whole = per.where((F.col("tools") > 0) & (F.coalesce("last_tool_group", F.lit(0)) <= F.col("final_at.group_no")))
    families = F.transform("calls", lambda c: c["family"])
    task = F.when(F.col("said_bytes") <= MOST_TASK_BYTES, F.array_join(F.transform("told", lambda t: t["said"]), "\n"))
    missing = F.col("tools") - F.col("matched")
    return whole.select(
        *key, "tools", "matched", missing.alias("missing"), "orphan", "errors", "unknown", ((missing == 0) & (F.col("orphan") == 0)).alias("clean"),
        F.transform(F.filter("calls", lambda c: c["id"].isNotNull()), lambda c: c["id"]).alias("call_ids"), F.array_distinct(F.filter(families, lambda f: f.isNotNull())).alias("families"),
        versioned(TASK_VERSION, F.array_join(F.transform(families, lambda f: F.coalesce(f, F.lit("other"))), "\0")).alias("pattern_fingerprint"), task.alias("task"),
        F.when(F.col("segment_no") < F.col("last_segment"), "next_human").otherwise("stream_end").alias("seal"), "start_at", "final_at", normalize_event_time(F.col("final_at.created_at")).alias("completed_at"),
    )


def named_rounds(rounds: DataFrame) -> DataFrame:
    """Completed rounds with round_id and task_fingerprint (null where the task says too little, or more than 64 KiB). The two functions in Python see one row a round, never a block."""
    start = lambda c: F.col(f"start_at.{c}")
    named = rounds.withColumn("round_id", round_id([F.col(c) for c in STREAM], start("message_uuid"), start("line_number"), start("block_index")))
    return named.withColumn("task_", task_text(F.col("task"))).withColumn("task_fingerprint", F.when(F.col("task_").isNotNull(), versioned(TASK_VERSION, F.col("task_")))).drop("task_")


def repeat_cohorts(rounds: DataFrame, size: int = COHORT, least_sessions: int = MIN_SESSIONS, within_ms: int = REPEAT_MS) -> DataFrame:
    """rounds (key, at_ms, round_id, session_id) -> (key, cohort_no, first_id, last_id): runs of `size` rounds of at least `least_sessions` sessions within
    the time; a hit moves on by its size, a miss by one."""
    if not (0 < least_sessions <= size):
        raise ValueError("a cohort cannot have more sessions than rounds")

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        key, held, n = None, [], 0
        for frame in frames:
            out = []
            for k, at, rid, sid in frame[["key", "at_ms", "round_id", "session_id"]].itertuples(index=False):
                if k != key:
                    key, held, n = k, [], 0
                held.append((at, rid, sid))
                if len(held) == size:
                    if len({s for _, _, s in held if s is not None and s == s}) >= least_sessions and held[-1][0] - held[0][0] <= within_ms:
                        n += 1
                        out.append((k, n, held[0][1], held[-1][1]))
                        held = []
                    else:
                        held = held[1:]
            yield pd.DataFrame(out, columns=["key", "cohort_no", "first_id", "last_id"])

    ordered = rounds.select(F.col("key").cast("string"), "at_ms", F.col("round_id").cast("string"), F.col("session_id").cast("string")).repartition("key").sortWithinPartitions("key", "at_ms", "round_id")
    return ordered.mapInPandas(run, "key string, cohort_no int, first_id string, last_id string")


def volume_jobs(rounds: DataFrame, least_tools: int = VOLUME_TOOLS, most: int = MOST_EVIDENCE) -> DataFrame:
    """key, tools, rounds, evidence: keys whose rounds used many tools, with their newest rounds. The list of a key is cut before it is collected."""
    newest = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("at_ms"), "round_id"))
    totals = rounds.groupBy("key").agg(F.sum("tools").alias("tools"), F.count("*").alias("rounds")).where(F.col("tools") >= least_tools)
    top = rounds.withColumn("pos", newest).where(F.col("pos") <= most).groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "round_id"))), lambda x: x["round_id"]).alias("evidence"))
    return totals.join(top, "key")


def evidence_credits(retrieved: DataFrame, blocks: DataFrame, least: int = 3) -> DataFrame:
    """retrieved (session_id, line_number, capsule_id, tokens) credited by the first later assistant block that shares `least` tokens: joined on tokens within the
    session, so only blocks that share something meet."""
    later = blocks.where("role = 'assistant'").select("session_id", F.col("line_number").alias("used_line"), F.explode("tokens").alias("t")).distinct()
    r = retrieved.select("session_id", "capsule_id", "line_number", F.explode("tokens").alias("t")).distinct()
    met = r.join(later, ["session_id", "t"]).where("used_line > line_number")
    shared = met.groupBy("session_id", "capsule_id", "line_number", "used_line").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return shared.groupBy("session_id", "capsule_id").agg(F.min("used_line").alias("used_line"))
