"""The store's workers as Structured Streaming: sessions by inactivity, touches without repeats, an evidence gate with state, and
embedding jobs batch by batch.

Each function takes a streaming DataFrame and returns one (or a writer's query), so a batch over the same rows is its test."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tessera.operators import workers
from tessera.operators.storage import shared_dir


def sessions(events: DataFrame, idle: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """user_id, start, stop, n: a session closes when `idle` passes without an event."""
    return (
        events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", idle).alias("w")).agg(F.count("*").alias("n"), F.max("ts").alias("last_at")).select("user_id", F.col("w.start").alias("start"), "last_at", "n")
    )


def distinct_touches(used: DataFrame, late: str = "1 hour") -> DataFrame:
    """One row for each (tenant, capsule) within the watermark."""
    return used.withWatermark("ts", late).dropDuplicatesWithinWatermark(["tenant", "capsule_id"])


def evidence_gate(signals: DataFrame, beta: float = 0.8, execute_at: int = 3, hysteresis: float = 0.25) -> DataFrame:
    """signals (candidate_id, sweep, signal): evidence and decision after each batch of sweeps, with state from batch to batch."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def fold(key: tuple, frames: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        e, c, last = state.get if state.exists else (0.0, 0, -1)
        rows = sorted((int(s), bool(x)) for f in frames for s, x in zip(f["sweep"], f["signal"], strict=True))
        for sweep, signal in rows:
            if sweep <= last:
                continue  # a replayed sweep changes nothing
            e, c, last = beta * e + (1.0 if signal else 0.0), (c + 1 if signal else 0), sweep
        state.update((e, c, last))
        yield pd.DataFrame([(key[0], round(e * 1_000_000), c, last, "execute" if c >= execute_at else "cancel" if e < hysteresis else "hold")], columns=["candidate_id", "evidence", "cycles", "sweep", "decision"])

    return signals.groupBy("candidate_id").applyInPandasWithState(
        fold, "candidate_id bigint, evidence bigint, cycles bigint, sweep bigint, decision string", "e double, c bigint, last bigint", "update", GroupStateTimeout.NoTimeout
    )


def run_once(stream: DataFrame, mode: str, each: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Drains what is there and returns what was written, with batch numbers. Output and checkpoint lie in the shared folder."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        if each:
            each(batch, number)
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{base}/out/b={number}")  # a replayed batch replaces itself

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    schema = StructType([*stream.schema.fields, StructField("batch", IntegerType())])
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{base}/out")


def embedded(jobs: DataFrame, tick: Callable[[DataFrame], workers.Tick]) -> tuple[DataFrame, DataFrame]:
    """(outcomes, vectors) of a stream of jobs that has been drained. Each micro-batch is one tick; what it writes lies in a folder of its number, so a batch that is replayed
    after a failure replaces itself, and a job is embedded once."""
    spark = jobs.sparkSession
    base = f"{shared_dir(spark)}/embedded-{uuid.uuid4().hex}"

    schemas = {}

    def put(batch: DataFrame, number: int) -> None:
        done = tick(batch)
        for name in ("vectors", "outcomes"):
            rows = getattr(done, name)
            schemas[name] = rows.schema
            rows.write.mode("overwrite").parquet(f"{base}/{name}/b={number}")

    jobs.writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    if not schemas:  # a stream without files has no batch: its result is that of no jobs
        put(spark.createDataFrame([], jobs.schema), 0)
    return tuple(spark.read.schema(schemas[name]).option("recursiveFileLookup", True).parquet(f"{base}/{name}") for name in ("outcomes", "vectors"))
