"""Writers: appends to a store's tables, bulk imports of transcript archives, and the plan of batches for a sink that limits them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import source_agent
from tessera.sources import jsonl
from tessera.operators.storage import append_new, ensure_importable

# What one request to a sink may hold.
BATCH_ROWS, BATCH_BYTES = 100, 1_500_000
KEYS = {
    "capsules": ["tenant", "capsule_id"], "episodes": ["tenant", "episode_id"], "jobs": ["job_id"], "sessions": ["tenant", "session_id"], "edges": ["from_node", "to_node", "relation", "valid_from"],
    "blocks": ["transcript_path", "line_number", "block_index"], "revocations": ["tenant", "version_id"],
}


@dataclass
class Tables:
    """Tables of a store below one folder, in Parquet."""

    spark: SparkSession
    root: str

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path(name))
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def append(self, name: str, rows: DataFrame) -> None:
        """One commit, however many rows."""
        rows.write.mode("append").parquet(self.path(name))

    def append_missing(self, name: str, rows: DataFrame) -> None:
        """Rows whose key the table lacks, one a key: a retry after a lost answer adds nothing."""
        keys = KEYS[name]
        if self.exists(name):
            have = self.read(name)
            self.append(name, append_new(have, rows.select(*have.columns), keys, *(F.asc(k) for k in keys)))
        else:
            self.append(name, rows.dropDuplicates(keys))


def episodes(rows: DataFrame) -> DataFrame:
    """Episodes as they are stored: their steps and evidence never null."""
    none = F.expr("CAST(array() AS array<string>)")
    return rows.withColumn("steps", F.coalesce("steps", none)).withColumn("evidence", F.coalesce("evidence", none))


def embedding_jobs(rows: DataFrame, id_column: str, provider: str, now: str) -> DataFrame:
    """Pending jobs for rows (tenant, id, content_hash)."""
    return rows.select(
        F.concat(F.lit("job_"), id_column, F.lit("_"), F.substring("content_hash", 1, 8)).alias("job_id"), "tenant", id_column, "content_hash", F.lit(provider).alias("provider"), F.lit("pending").alias("status"),
        F.lit(0).cast("bigint").alias("attempts"), F.lit(now).alias("available_at"), F.lit(now).alias("created_at"), F.lit(now).alias("updated_at"),
    )


def sessions(rows: DataFrame, now: str) -> DataFrame:
    """Open sessions for rows (session_id, tenant, caller_agent)."""
    return rows.select("session_id", "tenant", "caller_agent", F.lit(now).alias("started_at"), F.lit(now).alias("last_seen_at"), F.lit(None).cast("string").alias("ended_at"), F.lit(0).cast("bigint").alias("memory_count"))


def import_archive(lines: DataFrame, tenant: str, agent: str) -> DataFrame:
    """Blocks of transcript lines (path, line_number, line) as they are archived: nothing is extracted from them."""
    told = jsonl.dialect(lines).withColumnRenamed("path", "transcript_path")
    blocks = jsonl.parse(lines).join(told, "transcript_path", "left")
    return blocks.withColumn("tenant", F.lit(tenant)).withColumn("caller_agent", source_agent(F.col("dialect"), F.lit(agent))).drop("dialect")


def import_report(blocks: DataFrame, stored: DataFrame) -> DataFrame:
    """A dry run: of each file its blocks, and how many are stored already."""
    keys = KEYS["blocks"]
    have = stored.select(*keys).distinct().withColumn("there", F.lit(1))
    return blocks.join(have, keys, "left").groupBy("transcript_path").agg(F.count("*").alias("blocks"), F.count("there").alias("stored"), F.sum(F.octet_length("content")).alias("bytes"))


def plan_batches(rows: DataFrame, key: str, order: tuple[str, ...], size: str, most_rows: int = BATCH_ROWS, most_bytes: int = BATCH_BYTES) -> DataFrame:
    """rows with batch_no: runs in order, within a key, of at most most_rows rows and most_bytes; a row over the limit is a batch alone. The greedy cut depends on all before it, so it
    streams over sorted partitions with three numbers of memory."""
    ensure_importable(rows.sparkSession)
    ready = rows.select(F.col(key).alias("key"), *(F.col(c).alias(f"o{i}") for i, c in enumerate(order)), F.coalesce(size, F.lit(0)).cast("bigint").alias("size"))
    names = [f"o{i}" for i in range(len(order))]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, batch, n, held = None, 0, 0, 0
        for f in frames:
            out = []
            for k, size_ in zip(f["key"], f["size"], strict=True):
                if k != at:
                    at, batch, n, held = k, 0, 0, 0
                elif n and (n >= most_rows or held + size_ > most_bytes):
                    batch, n, held = batch + 1, 0, 0
                n, held = n + 1, held + size_
                out.append(batch)
            f["batch_no"] = out
            yield f

    schema = ", ".join(f"{c} {ready.schema[c].dataType.simpleString()}" for c in ready.columns) + ", batch_no bigint"
    return ready.repartition("key").sortWithinPartitions("key", *names).mapInPandas(run, schema)
