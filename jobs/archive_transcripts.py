"""Archives transcripts as they come in: an incremental job.

Files of turns (conv_id, turn, role, text) are taken in by a file stream with a checkpoint: a run reads the files that no run before it has read, and ends. Each micro-batch becomes
blocks with their secrets redacted, their content hash, their search tokens, and whether a prompt is worth a recall; blocks that are archived already (a file that came twice, or grew) are left out, the first one stays.
A batch replaces its own partitions (batch_id) of all tables, so a batch that failed half way and runs again leaves the same tables. Sessions are rolled up batch by batch, one small row for each session and batch;
the sessions table is made anew from these, for the parts that the run has touched.

Tables under `output`: blocks (partitioned by part and batch_id), session_parts (part, batch_id), sessions (part). A part holds the sessions of one hash value; no session is in two.

Defined results: rows without conv_id or turn are blocks by their role and text, and have no session. A null text is an empty one. Of rows with the same conv_id and turn in one batch, the least (role, text) stays. Without input nothing
changes. Long texts are read whole. Extra columns are not read.

    python -m jobs.archive_transcripts --config jobs/archive_transcripts.json --input /data/conversations --output /data/archive --checkpoint /data/archive-checkpoint
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import command_line, log, replace_partitions, table
from tessera.functions.text import fingerprint, prompt_to_recall, redact
from tessera.operators.storage import append_new

INPUT = "conv_id bigint, turn bigint, role string, text string"
BLOCKS = "block_id string, session_id string, line_number bigint, role string, content string, content_hash string, n_chars bigint, redacted boolean, tokens array<string>, recall boolean, part int, batch_id bigint"
SESSION_PARTS = "session_id string, blocks bigint, chars bigint, prompts bigint, redacted bigint, first_line bigint, last_line bigint, part int, batch_id bigint"
SESSIONS = "session_id string, blocks bigint, chars bigint, prompts bigint, redacted bigint, first_line bigint, last_line bigint, part int"
MERGED = {"blocks": F.sum, "chars": F.sum, "prompts": F.sum, "redacted": F.sum, "first_line": F.min, "last_line": F.max}


def blocks_of(turns: DataFrame, parts: int) -> DataFrame:
    said, named = F.coalesce("text", F.lit("")), F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    nameless = F.concat(F.lit("?"), F.sha2(F.to_json(F.struct("role", "text")), 256))
    rows = turns.select(
        F.when(named, F.concat("conv_id", F.lit(":"), "turn")).otherwise(nameless).alias("block_id"), F.when(named, F.concat(F.lit("conv_"), "conv_id")).alias("session_id"),
        F.col("turn").alias("line_number"), "role", said.alias("said"), redact(said).alias("content"),
    )
    recall = F.when(F.col("role") == "user", prompt_to_recall(F.col("content")).isNotNull()).otherwise(F.lit(False))
    return rows.select(
        "block_id", "session_id", "line_number", "role", "content", F.sha2("content", 256).alias("content_hash"), F.char_length("content").cast("bigint").alias("n_chars"), (F.col("said") != F.col("content")).alias("redacted"),
        fingerprint(F.col("content")).alias("tokens"), recall.alias("recall"), F.pmod(F.xxhash64(F.coalesce("session_id", "block_id")), F.lit(parts)).cast("int").alias("part"),
    )


def rolled_up(blocks: DataFrame) -> DataFrame:
    """One row a session and batch."""
    return blocks.where("session_id is not null").groupBy("session_id", "part", "batch_id").agg(
        F.count("*").alias("blocks"), F.sum("n_chars").alias("chars"), F.count_if("recall").alias("prompts"), F.count_if("redacted").alias("redacted"), F.min("line_number").alias("first_line"), F.max("line_number").alias("last_line"),
    )


def run(spark: SparkSession, input: str, output: str, checkpoint: str, parts: int = 64, files_per_batch: int = 1000) -> dict[str, int]:
    """Takes in what is new below `input` (a folder, or a pattern of folders and files), waits for the end, and returns how much it read and wrote."""
    at = {name: f"{output}/{name}" for name in ("blocks", "session_parts", "sessions")}
    table(spark, at["blocks"], BLOCKS, "part", "batch_id")
    table(spark, at["session_parts"], SESSION_PARTS, "part", "batch_id")
    table(spark, at["sessions"], SESSIONS, "part")
    counts = {"batches": 0, "rows_read": 0, "blocks_written": 0, "sessions_written": 0}

    def take(turns: DataFrame, batch_id: int) -> None:
        own = turns.sparkSession
        read = own.read.schema(BLOCKS).parquet(at["blocks"])
        earlier = read.where(F.col("batch_id") < batch_id)
        new = append_new(earlier, blocks_of(turns, parts), ["part", "block_id"], F.asc("role"), F.asc("content"), F.asc("content_hash"))
        replace_partitions(new.withColumn("batch_id", F.lit(batch_id).cast("bigint")).select(*read.columns), at["blocks"], "part", "batch_id")
        stored = own.read.schema(BLOCKS).parquet(at["blocks"]).where(F.col("batch_id") == batch_id)
        replace_partitions(rolled_up(stored).select(*own.read.schema(SESSION_PARTS).parquet(at["session_parts"]).columns), at["session_parts"], "part", "batch_id")
        n = turns.count(), stored.count()
        log.info("archive_transcripts: batch %s read %s rows and wrote %s blocks to %s", batch_id, *n, at["blocks"])
        counts.update(batches=counts["batches"] + 1, rows_read=counts["rows_read"] + n[0], blocks_written=counts["blocks_written"] + n[1])

    # no file is too old to be taken in, however late it comes
    turns = spark.readStream.schema(INPUT).option("maxFilesPerTrigger", files_per_batch).option("maxFileAge", "36500d").parquet(input)
    query = turns.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()

    partial, sessions = spark.read.schema(SESSION_PARTS).parquet(at["session_parts"]), spark.read.schema(SESSIONS).parquet(at["sessions"])
    # parts of which the sessions table lacks blocks: those of this run, and those of a run that ended before it came so far
    told, known = partial.groupBy("part").agg(F.sum("blocks").alias("n")), sessions.groupBy("part").agg(F.sum("blocks").alias("m"))
    behind = told.join(known, "part", "left").where("m is null or n <> m").select("part")
    rows = partial.join(F.broadcast(behind), "part", "left_semi").groupBy("session_id", "part").agg(*(f(c).alias(c) for c, f in MERGED.items()))  # `parts` rows are broadcast at most
    fresh = rows.select("session_id", *MERGED, "part").repartition("part")
    counts["sessions_written"] = fresh.count()
    if counts["sessions_written"]:
        replace_partitions(fresh, at["sessions"], "part")
    log.info("archive_transcripts: read %(rows_read)s rows of %(batches)s batches, wrote %(blocks_written)s blocks and %(sessions_written)s sessions", counts)
    return counts


def read_back(spark: SparkSession, output: str) -> DataFrame:
    """Each archived block with the roll-up of its session."""
    blocks, sessions = spark.read.schema(BLOCKS).parquet(f"{output}/blocks"), spark.read.schema(SESSIONS).parquet(f"{output}/sessions")
    whole = sessions.select("session_id", F.col("blocks").alias("session_blocks"), F.col("chars").alias("session_chars"), F.col("prompts").alias("session_prompts"), F.col("redacted").alias("session_redacted"), "first_line", "last_line")
    return blocks.select("block_id", "session_id", "line_number", "role", "content", "content_hash", "n_chars", "redacted", "tokens", "recall").join(whole, "session_id", "left")


if __name__ == "__main__":
    command_line(__doc__.split("\n")[0], Path(__file__).with_suffix(".json"), run)
