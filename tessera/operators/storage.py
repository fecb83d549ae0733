"""Writes: appends without repeats, upserts and conditional updates as state in, state out; and the shared folder for intermediate results."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_own: dict[str, str] = {}
_cuts: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a folder of our own only where that is unset, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return named.rstrip("/") if named else _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="tessera-"))


def ensure_importable(spark: SparkSession) -> None:
    """Lets Python workers import this package when the driver found it by sys.path alone."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read back."""
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _cuts.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_cuts(spark: SparkSession) -> int:
    """Deletes what cut() has left for this process; to be called when nothing that reads it is needed any more."""
    n = 0
    while _cuts:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_cuts.pop())
        n += bool(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True))
    return n


def first_of_each(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    return rows.withColumn("rn_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("rn_ = 1").drop("rn_")


def append_new(table: DataFrame, incoming: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """What of incoming lands: one row a key (first by order), keys that the table lacks."""
    return first_of_each(incoming, keys, *order).join(table.select(*keys), keys, "left_anti")


def replace_by_key(table: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of the incoming keys give way to the incoming rows."""
    return table.join(incoming.select(*keys).distinct(), keys, "left_anti").unionByName(incoming)


def delete_by_key(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(gone.select(*keys).distinct(), keys, "left_anti")


def update_where(table: DataFrame, condition: Column, **values: Column) -> DataFrame:
    """The table after an update; columns keep their types."""
    hit = F.coalesce(condition, F.lit(False))
    return table.select(*(F.when(hit, values[c].cast(table.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in table.columns))


def hard_delete(tables: dict[str, DataFrame], tenant: str, capsule_id: str, now: str) -> dict[str, DataFrame]:
    """Children first: feedback, jobs and vectors of the capsule go, its active edges close, then its row goes."""
    out = dict(tables)
    for name in ("feedback", "jobs", "vectors"):
        if name in out:
            out[name] = out[name].where(F.col("capsule_id") != capsule_id)
    if "edges" in out:
        node = f"capability_capsule:{capsule_id}"
        out["edges"] = update_where(out["edges"], ((F.col("from_node") == node) | (F.col("to_node") == node)) & F.col("valid_to").isNull(), valid_to=F.lit(now))
    out["capsules"] = out["capsules"].where(~((F.col("tenant") == tenant) & (F.col("capsule_id") == capsule_id)))
    return out


def capped(rows: DataFrame, most_rows: int, most_bytes: int, *order: Column) -> DataFrame:
    """The first rows; the query fails where their text exceeds the limit. Content of blocks that are not text is blanked."""
    top = rows.orderBy(*order).limit(most_rows)
    size = F.sum(F.octet_length("content")).over(Window.partitionBy())
    kept = top.withColumn("bytes_", size).where(F.when(F.col("bytes_") > most_bytes, F.raise_error(F.lit("too many bytes")).cast("boolean")).otherwise(True)).drop("bytes_")
    return kept.withColumn("content", F.when(F.col("block_type") == "text", F.col("content")).otherwise(""))
