"""Nearest in a band and clusters, against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import neighbours as N
from tessera.operators import workers
from tessera.operators.retrieval import components

SCHEMA = "capsule_id string, k string, embedding array<float>"


def made(seed, n=240, dim=8):
    g = np.random.default_rng(seed)
    centres = g.normal(size=(7, dim))
    out = []
    for i in range(n):
        v = centres[i % 7] + g.normal(size=dim) * (0.15 if i % 3 else 0.8)
        out.append((f"c{i:03}", "xy"[i % 11 == 0], [float(x) for x in np.round(v, 3)]))
    out += [(f"d{i:02}", "x", out[5][2]) for i in range(30)]  # copies
    out += [("e0", "x", [0.0] * dim), ("e1", "x", None), ("e2", "x", []), ("e3", "x", [1.0, 2.0]), ("e4", "x", [1.0, 2.1]), ("e5", None, out[5][2]), (None, "x", out[5][2]), ("e6", "x", [1.0] * (dim - 1) + [None])]
    out += [("c000", "x", out[1][2])]  # an id of two vectors
    return out


def sims(rows):
    usable = [(i, k or "", np.float64(np.array(v, np.float32))) for i, k, v in rows if i is not None and v and None not in v and any(v)]
    for i, (a, ka, va) in enumerate(usable):
        for b, kb, vb in usable[i + 1 :]:
            if ka == kb and len(va) == len(vb):
                yield a, b, round(float(va @ vb / np.linalg.norm(va) / np.linalg.norm(vb)) * 1_000_000)


@pytest.mark.parametrize("low,high,k", [(-1.0, None, 5), (0.6, 0.95, 4), (0.9, None, 40)])
def test_nearest_in_band(spark, low, high, k):
    rows = made(1)
    best = {}
    for a, b, s in sims(rows):
        if a != b and low * 1e6 <= s < (high or 2) * 1e6:
            for x, y in ((a, b), (b, a)):
                best.setdefault(x, {})[y] = max(s, best.get(x, {}).get(y, -(10**9)))
    wanted = {(x, y, s) for x, near in best.items() for y, s in sorted(near.items(), key=lambda p: (-p[1], p[0]))[:k]}
    df = spark.createDataFrame(rows, SCHEMA).withColumn("sim", F.lit("clash"))
    for block, cells in ((1024, 1), (16, 12)):
        found = N.nearest_in_band(df, k, low, high, ("k",), block=block, cells=cells).collect()
        near = {(r["from_id"], r["to_id"], r["sim"]) for r in found}
        assert {(x, y) for x, y, _ in near ^ wanted} == set() or all(abs(dict(((x, y), s) for x, y, s in wanted).get((x, y), s) - s) <= 1 for x, y, s in near), (block, list(near ^ wanted)[:5])
        assert len(found) == len(wanted) and max(r["pos"] for r in found) <= k
    some = N.nearest_in_band(df, k, low, high, ("k",), queries=spark.createDataFrame([("c005",), ("nobody",), (None,)], "capsule_id string"), block=16, cells=12)
    assert {(r["from_id"], r["to_id"]) for r in some.collect()} == {(x, y) for x, y, _ in wanted if x == "c005"}


@pytest.mark.parametrize("threshold", [0.5, 0.9, 0.99])
def test_forest_has_the_components_of_all_pairs(spark, threshold):
    rows = made(2)
    parent = {r[0]: r[0] for r in rows if r[0]}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b, s in sims(rows):
        if s >= threshold * 1e6:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    df = spark.createDataFrame(rows, SCHEMA)
    for block, cells in ((1024, 1), (16, 12)):
        links = N.similarity_forest(df, threshold, ("k",), block=block, cells=cells)
        roots = {r["node"]: r["root"] for r in components(links).collect()}
        assert {x: roots.get(x, x) for x in parent} == {x: find(x) for x in parent}, block


def test_copies_and_crowds_give_few_rows(spark):
    g = np.random.default_rng(3)
    base = g.normal(size=16)
    copies = spark.range(20_000).select(F.col("id").cast("string").alias("capsule_id"), F.array(*map(F.lit, base.tolist())).alias("embedding"))
    assert N.similarity_forest(copies, 0.9).count() == 19_999
    near = spark.createDataFrame([(str(i), (base + g.normal(size=16) * 0.01).tolist()) for i in range(2000)], "capsule_id string, embedding array<double>")
    links = N.similarity_forest(near, 0.9, block=128, cells=8)
    n = links.count()
    assert 1999 <= n <= 2000 + 600, n  # a spanning tree, and a link for each pair of blocks at most
    assert components(links).select("root").distinct().count() == 1


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert N.nearest_in_band(none, 3, keys=("k",)).count() == 0 and N.similarity_forest(none, 0.9, ("k",)).count() == 0


def test_neighbourhood_of_committed_vectors(spark):
    v = lambda x, y: [float(x), float(y)]
    caps = [("new", "t", "active", "short", "5"), ("long", "t", "active", "much longer text", "3"), ("older", "t", "active", "much longer text", "2"), ("gone", "t", "archived", "the very longest text of all", "1"), ("other", "u", "active", "the longest text elsewhere", "1"), ("band", "t", "provisional", "x", "1"), ("stale", "t", "active", "another model's very long text", "1")]
    capsules = spark.createDataFrame(caps, "capsule_id string, tenant string, status string, content string, created_at string").withColumn("capsule_type", F.lit("experience"))
    vectors = spark.createDataFrame([("new", 0, v(1, 0), "m"), ("new", 1, v(0, 1), "m"), ("long", 0, v(1, 0.1), "m"), ("older", 0, v(1, 0.1), "m"), ("gone", 0, v(1, 0), "m"), ("other", 0, v(1, 0), "m"), ("band", 0, v(1, 0.6), "m"), ("stale", 0, v(1, 0), "old")], "capsule_id string, chunk int, embedding array<double>, model string")
    done = spark.createDataFrame([("new",), ("band",)], "capsule_id string")
    state, edges = workers.neighbourhood(capsules, vectors, done, "9")
    assert {r["capsule_id"]: r["status"] for r in state.collect()} == {c[0]: c[2] for c in caps} | {"new": "pending_confirmation"}
    assert {(r["from_node"][19:], r["to_node"][19:], r["relation"], r["extractor"]) for r in edges.collect()} == {("new", "older", "suspected_supersede", "o7_neardup_cluster"), ("new", "band", "related_to", "ingest_link")}
    state, edges = workers.neighbourhood(capsules, vectors, done, "9", near_at=None)  # nothing owns the top of the band: links reach up to it
    assert {r["capsule_id"]: r["status"] for r in state.collect()}["new"] == "active"
    assert {(r["to_node"][19:], r["relation"]) for r in edges.collect()} == {("long", "related_to"), ("older", "related_to"), ("band", "related_to")}


def test_suggestions_of_names_that_many_share(spark):
    """A node meets the first few entities of a name alone: before, all of them."""
    from tessera.operators import mining

    entities = spark.range(400).select(F.lit("t").alias("tenant"), F.format_string("e%03d", "id").alias("entity_id"), F.when(F.col("id") % 2 == 0, "Alpha").otherwise("alpha").alias("canonical_name"))
    nodes = spark.createDataFrame([("t", "entity:alphas"), ("t", "entity:alpho"), ("u", "entity:alpho")], "tenant string, node string")
    found = mining.neighbour_suggestions(nodes, entities)
    want = [(i + 1, f"entity:e{2 * i:03}", "Alpha", 1) for i in range(5)]
    for node in ("entity:alphas", "entity:alpho"):
        assert sorted((r["pos"], r["suggested"], r["canonical_name"], r["distance"]) for r in found.where(F.col("node") == node).collect()) == want
    assert found.count() == 10
    assert "Window" in found._jdf.queryExecution().optimizedPlan().toString().split("Join", 1)[1]  # cut before the join
