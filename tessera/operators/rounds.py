"""Rebuilds of the round index: what a session's transcript says now against what was built from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.sequences import STREAM, call, completed_rounds, segments

# The most that a session may hold to be rebuilt.
MOST_BLOCKS, MOST_BYTES = 20_000, 64 << 20
VERSION = 3
SESSION = ["tenant", "session_id"]


def framed(*fields: Column) -> Column:
    """Fields one after the other, each behind its length, so that no two lists of fields read alike."""
    return F.concat(*(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c) for c in (F.coalesce(f.cast("string"), F.lit("")) for f in fields)))


def block_digest() -> Column:
    names = ("transcript_path", "line_number", "block_index", "message_uuid", "role", "block_type", "tool_name", "tool_use_id", "content")
    return F.md5(framed(*(F.col(n) for n in names)))


def source_fingerprints(blocks: DataFrame) -> DataFrame:
    """One row a session: its blocks counted and fingerprinted. A block's digest holds its place, so the digests are combined without an order: added up, in four parts of 32 bits, block by block
    in a partial aggregate. No session is gathered, and a block that is stored twice counts twice."""
    rows = blocks.where(F.col("session_id").isNotNull()).withColumn("d_", block_digest())
    part = lambda i: F.sum(F.conv(F.substring("d_", 8 * i + 1, 8), 16, 10).cast("bigint"))
    per = rows.groupBy(*SESSION).agg(F.count("*").alias("blocks"), F.sum(F.octet_length("content")).alias("bytes"), *(part(i).alias(f"p{i}") for i in range(4)))
    return per.select(*SESSION, "blocks", "bytes", F.concat(*(F.lpad(F.lower(F.hex(F.pmod(f"p{i}", F.lit(1 << 32)))), 8, "0") for i in range(4))).alias("fingerprint"))


def rebuild(blocks: DataFrame, builds: DataFrame, now: str, dry_run: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(report, rounds, builds): of each session its counts and whether it is published, unchanged, too large, or (dry_run) would be looked at alone; the rounds of
    those to publish; and the builds after it. builds: tenant, session_id, version, fingerprint, round_count, built_at."""
    prints = source_fingerprints(blocks)
    fits = (F.col("blocks") <= MOST_BLOCKS) & (F.col("bytes") <= MOST_BYTES)
    small = blocks.join(prints.where(fits).select(*SESSION), SESSION, "left_semi")
    rounds = completed_rounds(small)
    counts = rounds.groupBy(*SESSION).agg(F.count("*").alias("rounds"), F.count_if("clean").alias("clean"))
    each = segments(small).where("segment_no > 0").groupBy(*STREAM, "segment_no").agg(F.max(call()).alias("tools"))
    cuts = each.groupBy(*SESSION).agg(F.count_if("tools").alias("with_tools"), F.count_if(~F.col("tools")).alias("without_tools"))
    last = builds.groupBy(*SESSION).agg(F.max_by(F.struct("version", "fingerprint", "round_count"), F.col("built_at")).alias("b"))
    n = F.coalesce("rounds", F.lit(0))
    same = (F.col("b.version") == VERSION) & (F.col("b.fingerprint") == F.col("fingerprint")) & (F.col("b.round_count") == n)
    status = F.when(~fits, "too_large").when(F.lit(dry_run), "dry_run").when(F.coalesce(same, F.lit(False)), "unchanged").otherwise("published")
    joined = prints.join(counts, SESSION, "left").join(cuts, SESSION, "left").join(last, SESSION, "left")
    report = joined.select(
        *SESSION, status.alias("status"), "blocks", n.alias("rounds"), F.coalesce("clean", F.lit(0)).alias("clean"), (n - F.coalesce("clean", F.lit(0))).alias("gapped"), (F.coalesce("with_tools", F.lit(0)) - n).alias("incomplete"), F.coalesce("without_tools", F.lit(0)).alias("without_tools"), "fingerprint"
    )
    todo = report.where("status = 'published'")
    built = todo.select(*SESSION, F.lit(VERSION).cast("bigint").alias("version"), "fingerprint", F.col("rounds").alias("round_count"), F.lit(now).alias("built_at"))
    return report, rounds.join(todo.select(*SESSION), SESSION, "left_semi"), builds.unionByName(built)
