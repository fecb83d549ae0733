"""Feedback from transcripts: which capsules that a recall brought up were put to use, credited once as a transcript grows.

A capsule is retrieved where a search call's result lists it, or where a recall banner in a text that is not the agent's names it. It is used where the agent fetches it (which counts above all else), or where a later text of the agent shares tokens
with what was shown. Texts meet on their tokens within a transcript, so only those that share something are compared. A cursor for each transcript says how far an earlier pass has read: what its evidence had shown was credited then.

Defined results: blocks without a transcript or a line are read as nothing. A result without its search call before it retrieves nothing. Results that are no JSON, and ids that are empty, are skipped. A text without tokens is credited where it was shown. Repeated
blocks change nothing; a capsule that was retrieved several times keeps its earliest evidence. Extra columns do no harm."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import FINGERPRINT_TOKENS, fingerprint, injected_ids, is_get_tool, is_recall_tool
from tessera.operators.storage import replace_by_key

# What names a recall in a transcript, and how many tokens are a use.
BANNERS = ("mem auto-recall", "related incidents/fixes")
SECTIONS = ("directives", "relevant_facts", "reusable_patterns")
SEARCH_TOOL, GET_TOOL = "capability_capsule_search", "capability_capsule_get"
HIT_THRESHOLD = 3
CURSOR_SUFFIX = "#feedback"
ENTRIES = "array<struct<capability_capsule_id:string,text:string>>"


def retrieved(blocks: DataFrame, most: int = FINGERPRINT_TOKENS) -> DataFrame:
    """transcript_path, line_number, capsule_id, shown (a hash of its text), tokens: every capsule that was shown, and where."""
    place = F.struct("line_number", "block_index")
    calls = blocks.where((F.col("block_type") == "tool_use") & (is_recall_tool(F.col("tool_name")) | F.contains("tool_name", F.lit(SEARCH_TOOL)))).groupBy("transcript_path", "tool_use_id").agg(F.min(place).alias("called"))
    rows = blocks.select("transcript_path", "line_number", "block_index", "role", "block_type", "content", "tool_use_id")
    known = rows.withColumn("place_", place).join(calls, ["transcript_path", "tool_use_id"], "left")
    answers = (F.col("block_type") == "tool_result") & F.coalesce(F.col("called") < F.col("place_"), F.lit(False))
    lists = F.concat(*(F.coalesce(F.from_json(F.get_json_object("content", f"$.{s}"), ENTRIES), F.from_json(F.lit("[]"), ENTRIES)) for s in SECTIONS))
    listed = known.where(answers).select("transcript_path", "line_number", F.explode(lists).alias("e")).select("transcript_path", "line_number", F.col("e.capability_capsule_id").alias("capsule_id"), F.coalesce("e.text", F.lit("")).alias("said"))
    speaks = (F.col("block_type") == "tool_result") | ((F.col("block_type") == "text") & (F.col("role") != "assistant"))
    banner = F.contains("content", F.lit(BANNERS[0])) | F.contains("content", F.lit(BANNERS[1]))
    lines = known.where(speaks & ~answers & banner).select("transcript_path", "line_number", F.explode(F.split("content", "\n")).alias("said"))
    injected = lines.select("transcript_path", "line_number", F.explode(injected_ids(F.col("said"))).alias("capsule_id"), "said")
    both = listed.unionByName(injected).where("capsule_id <> '' and transcript_path is not null and line_number is not null")
    return both.select("transcript_path", "line_number", "capsule_id", F.xxhash64("said").alias("shown"), fingerprint(F.col("said"), most).alias("tokens"))


def fetched(blocks: DataFrame) -> DataFrame:
    """transcript_path, capsule_id, line: where the agent first asked for a capsule by its id."""
    gets = blocks.where((F.col("block_type") == "tool_use") & (is_get_tool(F.col("tool_name")) | F.contains("tool_name", F.lit(GET_TOOL))))
    return gets.select("transcript_path", "line_number", F.get_json_object("content", "$.capability_capsule_id").alias("capsule_id")).where("capsule_id is not null").groupBy("transcript_path", "capsule_id").agg(F.min("line_number").alias("line"))


def credits(blocks: DataFrame, every: bool = False, least: int = HIT_THRESHOLD, most: int = FINGERPRINT_TOKENS) -> DataFrame:
    """transcript_path, capsule_id, line: each capsule that earned credit, with the line of its first evidence. `every`: all that were retrieved, where they were."""
    key = ["transcript_path", "capsule_id"]
    shown = retrieved(blocks, most)
    asked = shown.select(*key).distinct().join(fetched(blocks), key)
    rest = shown.join(asked.select(*key), key, "left_anti")
    if every:
        return asked.unionByName(rest.groupBy(*key).agg(F.min("line_number").alias("line")))
    mute = rest.where(F.size("tokens") == 0).select(*key, F.col("line_number").alias("line"))
    told = rest.select(*key, "line_number", "shown", F.explode("tokens").alias("t")).distinct()
    agent = blocks.where((F.col("role") == "assistant") & F.col("block_type").isin("text", "thinking"))
    said = agent.select("transcript_path", F.col("line_number").alias("line"), "block_index", F.explode(fingerprint(F.col("content"), most)).alias("t")).distinct()
    met = told.join(said, ["transcript_path", "t"]).where("line > line_number")
    used = met.groupBy(*key, "line_number", "shown", "line", "block_index").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return asked.unionByName(mute.unionByName(used.select(*key, "line")).groupBy(*key).agg(F.min("line").alias("line")))


def since(found: DataFrame, cursors: DataFrame) -> DataFrame:
    """Credits whose evidence lies behind what an earlier pass has read; all of a transcript without a cursor. cursors: transcript_path (of feedback), last_line_number."""
    marks = cursors.select(F.col("transcript_path").alias("mark_"), "last_line_number")
    joined = found.join(marks, F.concat("transcript_path", F.lit(CURSOR_SUFFIX)) == F.col("mark_"), "left")
    return joined.where("last_line_number is null or line > last_line_number").select(*found.columns)


def advanced(cursors: DataFrame, lines: DataFrame) -> DataFrame:
    """The cursors after a pass that read these lines (path, line_number). They never go back."""
    read = lines.groupBy(F.concat("path", F.lit(CURSOR_SUFFIX)).alias("transcript_path")).agg(F.max("line_number").cast("bigint").alias("read_"))
    new = read.join(cursors.select("transcript_path", "last_line_number"), "transcript_path", "left").select("transcript_path", F.greatest("read_", "last_line_number").alias("last_line_number"))
    return replace_by_key(cursors.select("transcript_path", "last_line_number"), new, ["transcript_path"])


def credit_pass(blocks: DataFrame, lines: DataFrame, cursors: DataFrame, kind: str, now: str, **settings: int | bool) -> tuple[DataFrame, DataFrame]:
    """(feedback, cursors): one event for each capsule that is newly credited, and how far the transcripts are read then. An event's id is made of its evidence, so the pass that is lost and run again sends the same."""
    new = since(credits(blocks, **settings), cursors)
    name = F.concat(F.lit("fb_"), F.substring(F.sha2(F.concat_ws("\x1f", "transcript_path", "capsule_id", F.col("line").cast("string")), 256), 1, 24))
    return new.select(name.alias("feedback_id"), "capsule_id", F.lit(kind).alias("kind"), F.lit(now).alias("created_at"), "transcript_path", "line"), advanced(cursors, lines)
