"""JSON Lines transcripts of three dialects -> blocks.

Dialect A has one message a line (type, sessionId, message.content as text or parts). Dialects B and C announce the session on a line of its own, which
holds for the lines that follow. Lines that are no JSON are skipped. Line numbers are per file, from the order of the file's own splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The types that tell the dialects.
B_TYPES = ("session_meta", "response_item", "event_msg", "turn_context", "compacted", "ghost_snapshot")
PART = "array<struct<type string, text string, thinking string, id string, name string, input string, tool_use_id string, content string, is_error boolean>>"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line_number, line of all *.jsonl below path.

    Lines are numbered without sorting them: each split counts its own, and what comes before it in its file is a running sum over splits, so a file of any size
    is read by as many tasks as it has splits."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").text(path)
    placed = raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("order_"), F.col("value").alias("line"))
    splits = placed.groupBy("path", "start").agg(F.min("order_").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = splits.select("path", "start", (before - F.col("first") + 1).alias("offset"))
    return placed.join(offsets, ["path", "start"]).select("path", (F.col("order_") + F.col("offset")).cast("int").alias("line_number"), "line")


def at(path: str) -> Column:
    return F.get_json_object("line", path)


def dialect(lines: DataFrame) -> DataFrame:
    """path, dialect: what the first line that is JSON says (a where nothing does)."""
    kind = F.when(at("$.payload").isNotNull() & at("$.type").isin(*B_TYPES), "b").when((at("$.type") == "session") & at("$.version").isNotNull(), "c").otherwise("a")
    valid = lines.where(F.try_parse_json("line").isNotNull())
    return valid.groupBy("path").agg(F.min_by(kind, "line_number").alias("dialect"))


def meta_json(**fields: Column) -> Column:
    """A JSON object of the fields that say something; null without any."""
    packed = F.to_json(F.struct(*(F.when(c != "", c).alias(n) for n, c in fields.items())))
    return F.when(packed != "{}", packed)


def result_text(content: Column) -> Column:
    """Text as it is, nothing as '', the texts of parts one after the other, other JSON as JSON."""
    texts = F.from_json(content, "array<struct<text string>>")
    joined = F.array_join(F.transform(texts, lambda x: x["text"]), "")
    return F.when(content.isNull(), "").when(content.startswith("[") & texts.isNotNull(), joined).otherwise(content)


def parse_a(lines: DataFrame) -> DataFrame:
    rows = lines.where(at("$.type").isin("user", "assistant", "system"))
    content = at("$.message.content")
    parts = F.when(at("$.message.content[0]").isNotNull(), F.from_json(content, PART)).otherwise(F.array(F.from_json(F.to_json(F.struct(F.lit("text").alias("type"), content.alias("text"))), PART[6:-1])))
    blocks = rows.select(
        "path", "line_number", at("$.sessionId").alias("session_id"), at("$.uuid").alias("message_uuid"), at("$.type").alias("role"), at("$.timestamp").alias("timestamp"),
        meta_json(cwd=at("$.cwd"), git_branch=at("$.gitBranch"), parent_uuid=at("$.parentUuid"), stop_reason=at("$.message.stop_reason")).alias("meta_json"), F.posexplode(parts).alias("block_index", "p"),
    )
    kept = blocks.where(F.col("p.type").isin("text", "thinking", "tool_use", "tool_result"))
    body = F.when(F.col("p.type") == "text", F.col("p.text")).when(F.col("p.type") == "thinking", F.col("p.thinking")).when(F.col("p.type") == "tool_use", F.col("p.input")).otherwise(result_text(F.col("p.content")))
    return _blocks(kept, F.col("p.type"), body, F.col("p.name"), F.coalesce("p.tool_use_id", F.when(F.col("p.type") == "tool_use", F.col("p.id"))))


def carried(value: Column) -> Column:
    """The last value that a line before (or this one) gave."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy("path").orderBy("line_number").rowsBetween(Window.unboundedPreceding, 0))


def joined_parts(content: Column, separator: str = "") -> Column:
    return F.array_join(F.transform(F.from_json(content, "array<struct<text string>>"), lambda x: x["text"]), separator)


def parse_b(lines: DataFrame) -> DataFrame:
    rows = lines.withColumn("session_id", carried(F.when(at("$.type") == "session_meta", at("$.payload.id")))).where(at("$.type") == "response_item")
    kind = at("$.payload.type")
    block_type = F.when(kind == "message", "text").when(kind == "reasoning", "thinking").when(kind == "function_call", "tool_use").when(kind == "function_call_output", "tool_result")
    body = F.when(kind == "message", joined_parts(at("$.payload.content"))).when(kind == "reasoning", joined_parts(at("$.payload.summary"), "\n")).when(kind == "function_call", at("$.payload.arguments")).otherwise(F.coalesce(at("$.payload.output"), F.lit("")))
    role = F.when(kind == "message", F.coalesce(at("$.payload.role"), F.lit("assistant"))).when(kind == "function_call_output", "user").otherwise("assistant")
    out = rows.select("path", "line_number", "session_id", F.lit(None).cast("string").alias("message_uuid"), role.alias("role"), at("$.timestamp").alias("timestamp"), F.lit(None).cast("string").alias("meta_json"), F.lit(0).alias("block_index"), block_type.alias("t"), body.alias("b"), at("$.payload.name").alias("n"), at("$.payload.call_id").alias("i")).where("t is not null and b is not null and b <> ''")
    return _blocks(out, F.col("t"), F.col("b"), F.col("n"), F.col("i"))


def parse_c(lines: DataFrame) -> DataFrame:
    rows = lines.withColumn("session_id", carried(F.when(at("$.type") == "session", at("$.id")))).where(at("$.type") == "message")
    role = at("$.message.role")
    content = at("$.message.content")
    parts = F.when(at("$.message.content[0]").isNotNull(), F.from_json(content, "array<struct<type string, text string, thinking string, id string, name string, arguments string>>")).otherwise(
        F.array(F.struct(F.lit("text").alias("type"), content.alias("text"), *(F.lit(None).cast("string").alias(n) for n in ("thinking", "id", "name", "arguments"))))
    )
    blocks = rows.select("path", "line_number", "session_id", at("$.id").alias("message_uuid"), F.when(role == "toolResult", "user").otherwise(role).alias("role"), (role == "toolResult").alias("is_result"), at("$.message.toolCallId").alias("result_of"), at("$.timestamp").alias("timestamp"), F.lit(None).cast("string").alias("meta_json"), F.posexplode(parts).alias("block_index", "p"))
    block_type = F.when(F.col("is_result"), "tool_result").when(F.col("p.type") == "toolCall", "tool_use").otherwise(F.col("p.type"))
    body = F.when(F.col("p.type") == "toolCall", F.col("p.arguments")).when(F.col("p.type") == "thinking", F.col("p.thinking")).otherwise(F.coalesce("p.text", F.lit("")))
    kept = blocks.withColumn("t", block_type).where(F.col("t").isin("text", "thinking", "tool_use", "tool_result"))
    return _blocks(kept, F.col("t"), body, F.col("p.name"), F.coalesce("result_of", F.when(F.col("t") == "tool_use", F.col("p.id"))))


def _blocks(rows: DataFrame, block_type: Column, content: Column, tool_name: Column, tool_use_id: Column) -> DataFrame:
    return rows.select(
        F.col("path").alias("transcript_path"), F.col("line_number").cast("bigint").alias("line_number"), F.col("block_index").cast("bigint").alias("block_index"), "session_id", "message_uuid", "role", block_type.alias("block_type"), content.alias("content"),
        tool_name.alias("tool_name"), tool_use_id.alias("tool_use_id"), "meta_json", "timestamp", block_type.isin("text", "thinking").alias("embed_eligible"),
    )


def parse(lines: DataFrame) -> DataFrame:
    """Blocks of all files, each by its own dialect."""
    known = lines.join(dialect(lines), "path")
    of = lambda d: known.where(F.col("dialect") == d).drop("dialect")
    return parse_a(of("a")).unionByName(parse_b(of("b"))).unionByName(parse_c(of("c")))
