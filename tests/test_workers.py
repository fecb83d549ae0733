"""Micro-batches of embedding jobs, batches of a sink, cells of the similarity join."""

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import retrieval, workers
from tessera.sources import writers

NOW = f"{1_000_000:020}"
JOB = "job_id string, tenant string, capsule_id string, content_hash string, provider string, status string, attempts bigint, available_at string, created_at string, updated_at string"
CAPSULE = "tenant string, capsule_id string, summary string, content string, content_hash string"
VECTOR = "capsule_id string, tenant string, chunk int, embedding array<float>, content_hash string"


def job(i, capsule, digest="h", provider="p", attempts=0):
    return (f"j{i}", "t", capsule, digest, provider, "pending", attempts, "0" * 20, f"{i:020}", "0" * 20)


def states(tick):
    return {r["job_id"]: (r["status"], r["attempts"]) for r in tick.jobs.collect()}


def test_every_outcome_of_a_tick(spark):
    jobs = spark.createDataFrame([job(1, "a"), job(2, "a", provider="q"), job(3, "gone"), job(4, "b", "old"), job(5, "later"), job(6, "taken"), job(7, "long")], JOB)
    texts = [("t", "a", "s", "text a", "h"), ("t", "b", "s", "text b", "h"), ("t", "later", "s", "x", "h"), ("t", "taken", "s", "y", "h"), ("t", "long", "s", "w " * 2_100, "h")]
    rows = spark.createDataFrame(texts, CAPSULE)
    after = spark.createDataFrame([(*r[:4], "new" if r[1] == "later" else r[4]) for r in texts], CAPSULE)
    old = spark.createDataFrame([("a", "t", 0, [1.0], "x"), ("a", "t", 1, [1.0], "x"), ("z", "t", 0, [1.0], "x")], VECTOR)
    settings = workers.Settings("p", dim=64)
    first = workers.embed_capsules(jobs, rows, old, settings, NOW, after)
    assert {r["job_id"]: r["outcome"] for r in first.outcomes.collect()} == {"j1": "completed", "j2": "no_provider", "j3": "missing", "j4": "stale", "j5": "stale", "j6": "completed", "j7": "completed"}
    assert states(first) == {"j1": ("completed", 0), "j2": ("dead_letter", 1), "j3": ("dead_letter", 1), "j4": ("stale", 0), "j5": ("stale", 0), "j6": ("completed", 0), "j7": ("completed", 0)}
    chunks = {r["capsule_id"]: r["n"] for r in first.vectors.groupBy("capsule_id").agg(F.count("*").alias("n")).collect()}
    assert chunks == {"a": 1, "z": 1, "taken": 1, "long": 2}
    elsewhere = jobs.withColumn("status", F.when(F.col("job_id") == "j6", "completed").otherwise("processing"))
    second = workers.embed_capsules(jobs, rows, old, settings, NOW, after, elsewhere)
    assert {r["job_id"] for r in second.outcomes.where("outcome = 'ignored'").collect()} == {"j6"} and "taken" not in {r["capsule_id"] for r in second.vectors.collect()}


def test_a_vector_of_another_length_is_tried_again(spark):
    jobs = spark.createDataFrame([job(1, "a"), job(2, "b", attempts=2)], JOB)
    rows = spark.createDataFrame([("t", "a", "s", "x", "h"), ("t", "b", "s", "y", "h")], CAPSULE)
    tick = workers.embed_capsules(jobs, rows, spark.createDataFrame([], VECTOR), workers.Settings("p", dim=63), NOW)
    assert states(tick) == {"j1": ("failed", 1), "j2": ("dead_letter", 3)} and tick.vectors.count() == 0
    retry = {r["job_id"]: int(r["available_at"]) for r in tick.jobs.collect()}
    assert retry["j1"] == int(NOW) + 60_000


def test_an_empty_queue(spark):
    tick = workers.embed_capsules(spark.createDataFrame([], JOB), spark.createDataFrame([], CAPSULE), spark.createDataFrame([], VECTOR), workers.Settings("p"), NOW)
    assert tick.outcomes.count() == tick.jobs.count() == tick.vectors.count() == 0


def test_batches_against_a_plain_scan(spark):
    g = np.random.default_rng(7)
    sizes = [int(x) for x in g.integers(0, 60, 200)] + [500, 0, 500]
    rows = spark.createDataFrame([("k", i, s) for i, s in enumerate(sizes)], "key string, at int, size int")
    found = [r["batch_no"] for r in writers.plan_batches(rows, "key", ("at",), "size", 5, 100).orderBy("o0").collect()]
    wanted, batch, n, held = [], 0, 0, 0
    for s in sizes:
        if n and (n >= 5 or held + s > 100):
            batch, n, held = batch + 1, 0, 0
        n, held = n + 1, held + s
        wanted.append(batch)
    assert found == wanted


def test_similarity_pairs_across_cells(spark):
    """Clusters, copies, a zero vector, vectors of another length; few rows a cell, so that pairs meet across cells."""
    g = np.random.default_rng(11)
    centres = g.normal(size=(12, 16))
    v = np.vstack([centres[i % 12] + g.normal(size=16) * 0.25 for i in range(240)])
    rows = [(f"v{i:03}", [float(x) for x in r]) for i, r in enumerate(v)] + [(f"c{i}", [float(x) for x in v[5]]) for i in range(8)] + [("zero", [0.0] * 16), ("s1", [1.0, 2.0]), ("s2", [2.0, 4.0])]
    df = spark.createDataFrame(rows + [("null", None)], "capsule_id string, embedding array<double>")
    for threshold in (0.95, 0.8):
        wanted = set()
        for i, (a, x) in enumerate(rows):
            for b, y in rows[i + 1 :]:
                if len(x) == len(y) and any(x) and any(y) and np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                    wanted.add((min(a, b), max(a, b)))
        found = [(r["a"], r["b"]) for r in retrieval.similarity_pairs(df, threshold, block=10).collect()]
        assert len(found) == len(set(found)) and set(found) == wanted
    assert retrieval.similarity_pairs(df.limit(0), 0.9).count() == 0


def test_streamed_embeddings_of_a_folder_of_files(spark, sf_dir, tmp_path):
    """Larger tables are folders whose files have names of their own: before, the stream found none of them and its output could not be read."""
    from tessera.queries import load

    spark.read.parquet(f"{sf_dir}/conversations.parquet").limit(60).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    found = load()[0]["streamed_embeddings"](spark, str(tmp_path)).collect()
    assert len(found) == 60 == len({r["job_id"] for r in found}) and {r["outcome"] for r in found} == {"no_provider", "missing", "completed"}
    spark.read.parquet(f"{sf_dir}/conversations.parquet").limit(0).write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert load()[0]["streamed_embeddings"](spark, f"{tmp_path}/none").count() == 0
