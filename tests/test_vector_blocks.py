"""Blocks of vectors: how often a row travels, what leaves the tasks, and crowds of ties."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import neighbours as N
from tessera.operators import retrieval
from tessera.operators import vector_blocks as B

SCHEMA = "capsule_id string, embedding array<float>"


def scattered(spark, n, dim=16):
    g = np.random.default_rng(n)
    return spark.createDataFrame([(f"v{i:05}", [float(x) for x in g.normal(size=dim)]) for i in range(n)], SCHEMA)


def test_a_row_travels_a_bounded_number_of_times(spark):
    """Vectors with no cells to speak of: before, nearly every row visited nearly every cell, and cells grew in number with the rows."""
    for n in (300, 1200):
        rows, names, _ = B.packed(scattered(spark, n), (), "capsule_id")
        placed = B.in_blocks(rows, names, 16, 6)
        assert B.in_pairs(placed).count() == 6 * n and B.in_pairs(placed, between_only=True).count() == 5 * n
        assert placed.groupBy("own").count().count() == 6


def test_rows_alone_of_their_key_reach_no_task(spark):
    """Before, each key of one row was a group of its own, with a call of Python."""
    v = scattered(spark, 60).withColumn("k", F.when(F.col("capsule_id") < "v00004", "together").otherwise(F.col("capsule_id")))
    rows, names, _ = B.packed(v, ("k",), "capsule_id")
    assert sorted(r["id"] for r in B.in_blocks(rows, names, 16, 6).collect()) == ["v00000", "v00001", "v00002", "v00003"]
    assert retrieval.similarity_pairs(v, -1.0, keys=("k",)).count() == 6
    assert {r["from_id"] for r in N.nearest_in_band(v, 2, keys=("k",)).collect()} == {"v00000", "v00001", "v00002", "v00003"}


def test_pairs_leave_unshuffled(spark):
    """Before, all pairs were shuffled once more for what is distinct already."""
    plan = retrieval.similarity_pairs(scattered(spark, 50), 0.3)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.strip().splitlines()[0].strip().startswith("FlatMapGroupsInArrow")


def test_an_id_of_several_vectors_comes_once_a_similarity(spark):
    rows = [("a", [1.0, 0.0]), ("a", [1.0, 0.0]), ("a", [0.8, 0.6]), ("b", [1.0, 0.0]), ("b", [1.0, 0.0])]
    found = [tuple(r) for r in retrieval.similarity_pairs(spark.createDataFrame(rows, SCHEMA), 0.5).collect()]
    assert sorted(found) == [("a", "b", 800_000), ("a", "b", 1_000_000)]


def test_crowds_of_ties_go_by_id(spark, monkeypatch):
    monkeypatch.setattr(B, "ROWS", 700)
    g = np.random.default_rng(1)
    base = g.normal(size=4)
    rows = [(f"v{i:04}", [float(x) for x in base]) for i in range(1100)] + [("w", [float(x) for x in -base])]
    kind = "<f4"
    table = __import__("pyarrow").table({"dim": [4] * len(rows), "id": [i for i, _ in rows], "v": [np.array(v, np.float32).tobytes() for _, v in rows]})
    at = B.Pair(table, kind)
    best = {}
    for x, y, s in at.best(at.left, at.right, -1_000_000, 2_000_000, 3):
        for a, b, c in zip(x.tolist(), y.tolist(), s.tolist(), strict=True):
            best.setdefault(a, []).append((b, c))
    assert best[0] == [(1, 1_000_000), (2, 1_000_000), (3, 1_000_000)] and best[700] == [(0, 1_000_000), (1, 1_000_000), (2, 1_000_000)]
    assert best[1100] == [(0, -1_000_000), (1, -1_000_000), (2, -1_000_000)] and all(len(v) == 3 for v in best.values()) and len(best) == 1101


def test_a_band_is_cut_where_double_precision_says(spark):
    """Similarities at both ends of the band, by hand: single precision alone would take or drop some of them."""
    at = lambda c: [float(c), float(np.sqrt(1 - c * c))]
    cosines = [0.5 + i * 1e-6 for i in range(-6, 7)] + [0.7 + i * 1e-6 for i in range(-6, 7)]
    rows = spark.createDataFrame([("q", [1.0, 0.0])] + [(f"x{i:02}", at(c)) for i, c in enumerate(cosines)], "capsule_id string, embedding array<double>")
    wanted = {(f"x{i:02}", round(c * 1_000_000)) for i, c in enumerate(cosines) if 500_000 <= round(c * 1_000_000) < 700_000}
    ask = spark.createDataFrame([("q",)], "capsule_id string")
    assert {(r["to_id"], r["sim"]) for r in N.nearest_in_band(rows, 40, 0.5, 0.7, queries=ask).collect()} == wanted
    best = N.nearest_in_band(rows, 2, 0.5, 0.7, queries=ask).orderBy("pos").collect()
    assert [r["sim"] for r in best] == [699_999, 699_998]
    pairs = retrieval.similarity_pairs(rows, 0.5, 0.7).where(F.col("a") == "q")
    assert {(r["b"], r["sim"]) for r in pairs.collect()} == wanted


def test_pairs_of_blocks_go_to_many_tasks(spark):
    """Before, partitions were joined by their bytes, and one task did all products of a small table, four those of 100,000 vectors."""
    found = retrieval.similarity_pairs(scattered(spark, 300), -1.0, block=16, cells=6)  # 21 pairs of blocks
    assert found.select(F.spark_partition_id().alias("p")).distinct().count() > 12
    near = N.nearest_in_band(scattered(spark, 300), 2, block=16, cells=6)
    assert near.select(F.spark_partition_id().alias("p")).distinct().count() > 100  # and what they find


def test_rows_of_one_key_meet_its_size_in_many_tasks(spark):
    """Before, they were shuffled by their key alone to learn how many blocks it has."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.enabled")}
    for k, v in zip(held, ("-1", "false"), strict=True):
        spark.conf.set(k, v)
    try:
        rows, names, _ = B.packed(scattered(spark, 1200), (), "capsule_id")
        placed = B.in_blocks(rows, names, 16, 16)
        per = [r["count"] for r in placed.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert sum(per) == 1200 and len(per) > 1 and max(per) < 1200
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("low,high", [(-1_000_000, 2_000_000), (300_000, 700_000), (900_000, 2_000_000)])
def test_both_ways_at_once_find_what_each_way_finds(monkeypatch, low, high):
    """Scattered vectors, clusters and copies, in tiles far smaller than the blocks."""
    monkeypatch.setattr(B, "ROWS", 13)
    monkeypatch.setattr(B, "COLUMNS", 50)
    g = np.random.default_rng(7)
    m = g.normal(size=(400, 8)).astype(np.float32)
    m[200:300] = m[g.integers(0, 5, 100)] + g.normal(size=(100, 8)).astype(np.float32) * 0.2
    m[300:] = m[0]
    m = m[g.permutation(400)]
    asks = g.random(400) < 0.7
    for one in (False, True):
        own = np.zeros(400, np.int32) if one else (np.arange(400) % 3 == 0).astype(np.int32)
        at = B.Pair(pa.table({"dim": [8] * 400, "id": [f"v{i:03}" for i in range(400)], "v": [r.tobytes() for r in m], "own": own, "i": np.zeros(400, np.int32), "j": np.full(400, 0 if one else 1, np.int32)}), "<f4")
        ways = [(at.left, at.right)] if one else [(at.left, at.right), (at.right, at.left)]
        for k in (1, 4, 60):
            listed = lambda found: sorted(t for x, y, s in found for t in zip(x.tolist(), y.tolist(), s.tolist(), strict=True))
            wanted = listed(f for mine, theirs in ways for f in at.best(mine[asks[mine]], theirs, low, high, k))
            assert listed(at.nearest(asks, low, high, k)) == wanted and wanted
