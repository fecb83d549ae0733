"""The graph as a channel of search: walks, ceilings by class, decayed strengths, and capsules that only the graph reaches."""

import os

import duckdb
import numpy as np
from pyspark.sql import functions as F

from tessera.operators import graph as G
from tessera.queries import search as Q

EDGE = "from_node string, to_node string, relation string, valid_from string, valid_to string, confidence double, extractor string, strength double, stability double, last_activated string"
C = "capability_capsule:"


def made(rows):
    return [(a, b, "r", "0", to, conf, ex, 1.0, 1.0, None) for a, b, ex, conf, to in rows]


def edges_of_a_small_world(seed=1, n=60):
    g = np.random.default_rng(seed)
    names = [C + str(i) for i in range(n)] + ["repo:a", "repo:b", "topic:t"]
    rows = []
    for _ in range(150):
        a, b = g.choice(len(names), 2)
        minted = g.random() < 0.4
        rows.append((names[a], names[b], ("ingest_link", "o7_neardup_cluster")[g.integers(2)] if minted else "ingest", float(np.round(g.random(), 2)) if minted else None, "9" if g.random() < 0.1 else None))
    return made(rows + [(names[3], names[3], "ingest", None, None), (names[4], names[5], "ingest_link", 0.0, None)])


def walked(rows, anchors, rounds=20):
    """Power iteration with plain lists, and boosts by the strongest class at a node."""
    live = [(a, b, 4 * min(1.0, max(0.0, 1.0 if c is None else c)) if ex in G.SIMILARITY_EXTRACTORS else 12.0) for a, b, _, _, to, c, ex, *_ in rows if to is None]
    first = [e for e in live if e[0] in anchors or e[1] in anchors]
    near = set(anchors) | set(sorted({x for e in first for x in e[:2]} - set(anchors))[: G.FRONTIER - len(anchors)])
    sub = [e for e in live if e[0] in near or e[1] in near]
    nodes = {x for e in sub for x in e[:2]}
    seeds = [a for a in anchors if a in nodes]
    out, ceiling = {x: 0.0 for x in nodes}, {x: 0.0 for x in nodes}
    real = [(a, b, w) for a, b, w in sub if w > 0 and a != b]
    for a, b, w in real:
        for x in (a, b):
            out[x] += w
            ceiling[x] = max(ceiling[x], w)
    p = {x: (1 / len(seeds) if x in seeds else 0.0) for x in nodes}
    for _ in range(rounds):
        new = {x: (0.5 / len(seeds) if x in seeds else 0.0) for x in nodes}
        for a, b, w in real:
            new[b] += 0.5 * p[a] * w / out[a]
            new[a] += 0.5 * p[b] * w / out[b]
        p = new
    top = max(p[s] for s in seeds)
    boosts = {x: int(np.floor(ceiling[x] * min(1.0, p[x] / top) + 0.5)) for x in nodes if x.startswith(C) and x not in anchors}
    return p, {x: b for x, b in boosts.items() if b > 0}


def test_walks_against_plain_lists(spark, monkeypatch):
    rows = edges_of_a_small_world()
    edges = spark.createDataFrame(rows, EDGE).withColumn("node", F.lit("clash"))
    anchors = [C + "0", C + "1", "repo:a", "repo:nowhere"]
    p, boosts = walked(list({r[:4]: r for r in rows}.values()), anchors)
    near = G.frontier(edges, anchors)
    for walk in (G.small_pagerank, G.personalised_pagerank):
        found = {r["node"]: r["p"] for r in walk(near, anchors).collect()}
        assert all(abs(found.get(x, 0.0) - v) < 2e-6 for x, v in p.items()), walk
    for most in (G.SMALL, 0):  # in one task, and as joins
        monkeypatch.setattr(G, "SMALL", most)
        assert {r["node"]: r["boost"] for r in G.walked_boosts(edges, anchors).collect()} == boosts and boosts
    assert G.walked_boosts(edges, ["repo:nowhere"]).count() == 0 and G.walked_boosts(edges.limit(0), anchors).count() == 0


def test_a_node_reached_by_likeness_alone_gets_little(spark):
    edges = spark.createDataFrame(made([("repo:a", C + "fact", "ingest", None, None), ("repo:a", C + "like", "ingest_link", 0.9, None)]), EDGE)
    found = {r["node"]: r["boost"] for r in G.walked_boosts(edges, ["repo:a"]).collect()}
    assert found[C + "fact"] >= 4 and found.get(C + "like", 0) <= 2


def test_strengths_decay(spark):
    day = 86_400_000
    now = str(10 * day).rjust(20, "0")
    at = lambda d: str(d * day).rjust(20, "0")
    rows = [("repo:a", C + x, "r", "0", None, None, "ingest", s, st, last) for x, s, st, last in (("new", 2.0, 1.0, None), ("today", 2.0, 1.0, at(10)), ("old", 2.0, 2.0, at(8)), ("gone", 2.0, 0.0, at(0)), ("plain", None, None, None), ("later", 2.0, 1.0, at(12)))]
    rows += [("repo:a", "topic:t", "r", "0", None, None, "ingest", 1.0, 1.0, None), ("repo:a", C + "closed", "r", "0", "1", None, "ingest", 1.0, 1.0, None)]
    boosts, used = G.dynamic_boosts(spark.createDataFrame(rows, EDGE), ["repo:a"], now)
    thin = 1 / (1 + 0.001 * 5**2)  # six capsules
    worth = {"new": 2.0, "today": 2.0, "old": 2 * np.exp(-1), "gone": 0.05, "plain": 1.0, "later": 2.0}
    assert {r["node"]: r["boost"] for r in boosts.collect()} == {C + k: int(np.floor(12 * thin * v + 0.5)) for k, v in worth.items()}
    assert used.count() == 7


def test_the_graph_brings_in_capsules(sf_dir):
    """The SQL that graph_search_of_a_small_pool is held against has boosted rows, and rows that only the graph brought in."""
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        path = f"{sf_dir}/{name}"
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    boosted, hydrated = con.execute(Q.graph_search_sql(20, Q.boosts_sql(), "SELECT count(*) FILTER (WHERE boost > 0), count(*) FILTER (WHERE hydrated) FROM s2")).fetchone()
    assert boosted > 3 and hydrated > 0, (boosted, hydrated)


def test_times_that_cannot_be_read_stop_nothing(spark):
    """A padded stamp of a time before the epoch ("0000000-123") is no number: before, the search failed; the edge's strength stays as it is."""
    now = str(10 * 86_400_000).rjust(20, "0")
    stamps = ("-3600000".rjust(20, "0"), "-5", "", "soon", "9" * 30, None)
    rows = [("repo:a", C + str(i), "r", "0", None, None, "ingest", 2.0, 1.0, last) for i, last in enumerate(stamps)]
    edges = spark.createDataFrame(rows, EDGE).withColumn("access_count", F.lit(0))
    boosts, _ = G.dynamic_boosts(edges, ["repo:a"], now)
    assert {r["node"]: r["boost"] for r in boosts.collect()} == {C + str(i): int(np.floor(12 / (1 + 0.001 * 5**2) * 2 + 0.5)) for i in range(len(stamps))}
    assert {r["stability"] for r in G.potentiate(edges, F.lit(True), now).collect()} == {1.0}
