"""The bitemporal graph: validity is half open, [valid_from, valid_to); traversal has no direction."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scoring import decayed_strength, spread_decay
from tessera.functions.text import trimmed
from tessera.operators.storage import cut, update_where

# Fixed values of graph boosts and edge dynamics.
GRAPH_BOOST, SIMILARITY_BOOST = 12, 4
DAMPING, ROUNDS, TOLERANCE = 0.5, 20, 1e-6
FRONTIER = 2048
CAPSULE_NODE = "capability_capsule:"
#: Edges that one task walks.
SMALL = 200_000
#: Rounds of the walk in one plan.
CUT = 10
SIMILARITY_EXTRACTORS = ("ingest_link", "o7_neardup_cluster")


def active() -> Column:
    return F.col("valid_to").isNull()


def as_of(ts: str | None) -> Column:
    return (F.col("valid_from") <= ts) & (F.col("valid_to").isNull() | (F.col("valid_to") > ts)) if ts else F.lit(True)


def touches(*nodes: str) -> Column:
    return F.col("from_node").isin(*nodes) | F.col("to_node").isin(*nodes)


def predicate(edges: DataFrame, relation: str, ts: str | None = None) -> DataFrame:
    return edges.where((F.col("relation") == relation) & as_of(ts)).orderBy("valid_from", "from_node", "to_node")


def neighbors(edges: DataFrame, node: str) -> DataFrame:
    return edges.where(touches(node) & active()).orderBy("relation", "from_node", "to_node")


def timeline(edges: DataFrame, node: str) -> DataFrame:
    return edges.where(touches(node)).orderBy("valid_from")


def tunnels(edges: DataFrame, limit: int) -> DataFrame:
    return edges.where(F.col("relation").startswith("user_tunnel:") & active()).orderBy("relation", "from_node", "to_node").limit(max(1, min(200, limit)))


def find_tunnels(edges: DataFrame, a: str, b: str, limit: int) -> DataFrame:
    """Active edges between nodes of two prefixes, either way."""
    f, t = F.col("from_node"), F.col("to_node")
    hit = edges.where(active() & ((f.startswith(a) & t.startswith(b)) | (f.startswith(b) & t.startswith(a))))
    return hit.dropDuplicates(["from_node", "to_node", "relation", "valid_from"]).orderBy("from_node", "to_node", "relation", "valid_from").limit(limit)


def within_hops(edges: DataFrame, node: str, hops: int, ts: str | None = None) -> DataFrame:
    """Edges that touch a node less than `hops` steps away: a join a hop, three at most. Edges come once."""
    usable = edges.where(as_of(ts) if ts else active())
    found = usable.where(touches(node))
    for _ in range(min(hops, 3) - 1):
        seen = found.select(F.explode(F.array("from_node", "to_node")).alias("node")).distinct()
        by_from = usable.join(seen, usable["from_node"] == seen["node"], "left_semi")
        by_to = usable.join(seen, usable["to_node"] == seen["node"], "left_semi")
        found = by_from.unionByName(by_to).dropDuplicates(["from_node", "to_node", "relation", "valid_from"])
    return found


def follow_tunnels(edges: DataFrame, node: str, hops: int) -> DataFrame:
    return within_hops(edges.where(F.col("relation").startswith("user_tunnel:")), node, hops)


def incident(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Active edges that touch any of many nodes, once each."""
    live = edges.where(active())
    n = nodes.select("node").distinct()
    return live.join(n, live["from_node"] == n["node"], "left_semi").unionByName(live.join(n, live["to_node"] == n["node"], "left_semi")).dropDuplicates(["from_node", "to_node", "relation", "valid_from"])


def related(edges: DataFrame, nodes: DataFrame, prefix: str) -> DataFrame:
    """Nodes of a prefix at the other end of active edges."""
    live = edges.where(active())
    n = nodes.select("node").distinct()
    out = live.join(n, live["from_node"] == n["node"]).select(F.col("to_node").alias("other"))
    back = live.join(n, live["to_node"] == n["node"]).select(F.col("from_node").alias("other"))
    return out.unionAll(back).where(F.col("other").startswith(prefix)).distinct()


def stats(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, active and closed ones."""
    ends = edges.select(F.explode(F.array("from_node", "to_node")).alias("node")).agg(F.count_distinct("node").alias("nodes"))
    return edges.agg(F.count("*").alias("edges"), F.count_if(active()).alias("active"), F.count_if(~active()).alias("closed")).withColumn("nodes", ends.select("nodes").scalar())


def top_relations(edges: DataFrame, limit: int = 16) -> DataFrame:
    return edges.groupBy("relation").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "relation").limit(limit)


def without_deleted_ends(incoming: DataFrame, deleted: DataFrame) -> DataFrame:
    """Edges none of whose ends is a capsule that was deleted for good (deleted: capsule_id)."""
    gone = deleted.select(F.concat(F.lit(CAPSULE_NODE), "capsule_id").alias("node_")).distinct()
    for end in ("from_node", "to_node"):
        incoming = incoming.join(gone, F.col(end) == F.col("node_"), "left_anti")
    return incoming


def add_edges(edges: DataFrame, incoming: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """Edges that land: intervals that run forward, triples without an active edge, ends that were not deleted."""
    if deleted is not None:
        incoming = without_deleted_ends(incoming, deleted)
    valid = incoming.where(F.col("valid_to").isNull() | (F.col("valid_to") >= F.col("valid_from")))
    key = ["from_node", "to_node", "relation"]
    return valid.dropDuplicates(key).join(edges.where(active()).select(*key), key, "left_anti")


def invalidate(edges: DataFrame, from_node: str, relation: str, to_node: str, ended: str) -> DataFrame:
    hit = (F.col("from_node") == from_node) & (F.col("to_node") == to_node) & (F.col("relation") == relation) & active()
    return update_where(edges, hit, valid_to=F.lit(ended))


def close_conflicts(edges: DataFrame, incoming: DataFrame, functional: list[str], now: str) -> DataFrame:
    """Relations with one object: an active edge gives way where a new one names another object."""
    new = incoming.where(F.col("relation").isin(*functional)).select("from_node", "relation", F.col("to_node").alias("new_to")).dropDuplicates(["from_node", "relation"])
    joined = edges.join(new, ["from_node", "relation"], "left")
    return joined.withColumn("valid_to", F.when(active() & (F.col("new_to") != F.col("to_node")), F.lit(now)).otherwise(F.col("valid_to"))).select(*edges.columns)


def clock(column: str) -> Column:
    """Milliseconds of a stamp; null for what is no whole number (a stamp before the epoch is none once padded)."""
    return F.when(F.col(column).rlike(r"^\s*\+?[0-9]+\s*$"), F.col(column).try_cast("bigint"))


def potentiate(edges: DataFrame, hit: Column, now: str) -> DataFrame:
    """Stronger (5 at most), and steadier if an hour has passed; counted."""
    hour_passed = F.coalesce(F.lit(int(now)) - clock("last_activated") >= 3_600_000, F.lit(False))
    return update_where(
        edges, hit, strength=F.least(F.lit(5.0), F.col("strength") + 0.05), stability=F.when(hour_passed, F.col("stability") + 0.1).otherwise(F.col("stability")), access_count=F.col("access_count") + 1, last_activated=F.lit(now)
    )


def base_boost() -> Column:
    return F.when(F.col("extractor").isin(*SIMILARITY_EXTRACTORS), SIMILARITY_BOOST * F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("confidence", F.lit(1.0))))).otherwise(float(GRAPH_BOOST))


def ends_of(edges: DataFrame, *columns: Column) -> DataFrame:
    """Each edge from both of its ends: anchor, node, and what else is asked of it."""
    way = lambda a, b: edges.select(F.col(a).alias("anchor"), F.col(b).alias("node"), *columns)
    return way("from_node", "to_node").unionAll(way("to_node", "from_node"))


def one_hop_boosts(edges: DataFrame, anchors: list[str]) -> DataFrame:
    """node, boost: the best of a node's active edges to an anchor, thinned by the anchor's degree."""
    ends = ends_of(edges.where(active()), base_boost().alias("base")).where(F.col("anchor").isin(*anchors))
    degree = ends.groupBy("anchor").agg(F.count("*").alias("degree"))
    scored = ends.join(degree, "anchor").where(~F.col("node").isin(*anchors))
    return scored.groupBy("node").agg(F.max(F.round(F.col("base") * spread_decay(F.col("degree"))).cast("bigint")).alias("boost"))


def strength_at(now: str) -> Column:
    """What is left of an edge's strength: it decays from its last activation, by its stability in days; what was never activated, or at a time that cannot be read, stays as it is."""
    strength, stability = F.coalesce("strength", F.lit(1.0)), F.coalesce("stability", F.lit(1.0))
    days = (F.lit(int(now)) - clock("last_activated")) / 86_400_000.0
    return F.when(F.coalesce(days > 0, F.lit(False)), decayed_strength(strength, F.when(stability > 0, stability).otherwise(1.0), days)).otherwise(strength)


def dynamic_boosts(edges: DataFrame, anchors: list[str], now: str) -> tuple[DataFrame, DataFrame]:
    """(node, boost of capsules one step from an anchor; the edges walked, to be potentiated). A boost is the edge's class, thinned by how many capsules its anchor has, times what is left of its strength."""
    walked = edges.where(active() & touches(*anchors))
    ends = ends_of(walked, (base_boost() * strength_at(now)).alias("worth")).where(F.col("anchor").isin(*anchors))
    capsule = F.col("node").startswith(CAPSULE_NODE)
    degree = ends.groupBy("anchor").agg(F.count_if(capsule).alias("degree"))
    thinned = spread_decay(F.greatest(F.lit(1), F.col("degree")))
    scored = ends.where(capsule & ~F.col("node").isin(*anchors)).join(F.broadcast(degree), "anchor")  # one row an anchor
    return scored.groupBy("node").agg(F.max(F.round(F.col("worth") * thinned).cast("bigint")).alias("boost")), walked.select("from_node", "to_node", "relation")


def frontier(edges: DataFrame, anchors: list[str]) -> DataFrame:
    """Active edges within two steps of the anchors; the second step leaves from the first nodes by name that are no anchors, FRONTIER nodes with these."""
    seeds = edges.sparkSession.createDataFrame([(a,) for a in anchors], "node string")
    first = incident(edges, seeds)
    nodes = first.select(F.explode(F.array("from_node", "to_node")).alias("node")).where(~F.col("node").isin(*anchors)).distinct().orderBy("node").limit(max(0, FRONTIER - len(set(anchors))))
    return first.unionByName(incident(edges, nodes)).dropDuplicates(["from_node", "to_node", "relation", "valid_from"])


def personalised_pagerank(edges: DataFrame, anchors: list[str], rounds: int = ROUNDS, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """node, p: mass that starts at the anchors that edges touch and walks edges by weight, without direction and not from a node to itself. A join and an aggregation a round, written every CUT
    rounds; ends there once the last round moved less than the tolerance."""
    spark = edges.sparkSession
    touched = edges.select(F.explode(F.array("from_node", "to_node")).alias("node")).where(F.col("node").isin(*anchors)).distinct()
    present = sorted(r["node"] for r in touched.collect())  # anchors at most
    seeds = spark.createDataFrame([(a, 1.0 / len(present)) for a in present], "node string, seed double")
    arcs = ends_of(edges, base_boost().alias("w")).where("w > 0 and anchor <> node").withColumnsRenamed({"anchor": "u", "node": "v"})
    total = arcs.groupBy("u").agg(F.sum("w").alias("t"))
    steps = cut(arcs.join(total, "u").groupBy("u", "v").agg(F.sum(F.col("w") / F.col("t")).alias("share")))
    start = seeds.select("node", ((1 - damping) * F.col("seed")).alias("x"))
    p = seeds.select("node", F.col("seed").alias("p"))
    for i in range(rounds):
        before = p
        walked = p.join(steps, p["node"] == steps["u"]).select(F.col("v").alias("node"), (damping * F.col("p") * F.col("share")).alias("x"))
        p = walked.unionAll(start).groupBy("node").agg(F.sum("x").alias("p"))
        if i % CUT == CUT - 1 and i < rounds - 1:
            both = cut(p.join(before.withColumnRenamed("p", "q"), "node", "full_outer").select("node", F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("q", F.lit(0.0)).alias("q")))
            p = both.select("node", "p")
            if both.agg(F.sum(F.abs(F.col("p") - F.col("q")))).first()[0] < tolerance:
                break
    return p


def small_pagerank(edges: DataFrame, anchors: list[str], rounds: int = ROUNDS, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """The same walk over a graph of at most SMALL edges, which the caller has counted, in one task: one job in place of a join a round."""
    kind = "node string, p double"

    def run(g: pd.DataFrame) -> pd.DataFrame:
        nodes, at = np.unique(np.concatenate([g["from_node"].to_numpy(str), g["to_node"].to_numpy(str)]), return_inverse=True)
        u, v = at[: len(g)], at[len(g) :]
        seeds = np.flatnonzero(np.isin(nodes, anchors))
        if not len(seeds):
            return pd.DataFrame({"node": pd.Series(dtype=str), "p": pd.Series(dtype=float)})
        w = g["w"].to_numpy(float)
        real = (w > 0) & (u != v)
        u, v, w = np.concatenate([u[real], v[real]]), np.concatenate([v[real], u[real]]), np.concatenate([w[real], w[real]])
        share = w / np.bincount(u, w, minlength=len(nodes))[u]
        reset = np.zeros(len(nodes))
        reset[seeds] = 1.0 / len(seeds)
        p = reset
        for _ in range(rounds):
            new = (1 - damping) * reset + damping * np.bincount(v, p[u] * share, minlength=len(nodes))
            moved, p = np.abs(new - p).sum(), new
            if moved < tolerance:
                break
        return pd.DataFrame({"node": nodes, "p": p})

    return edges.select("from_node", "to_node", base_boost().alias("w"), F.lit(1).alias("one")).groupBy("one").applyInPandas(run, kind)


def pagerank_boosts(p: DataFrame, edges: DataFrame, anchors: list[str], prefix: str = CAPSULE_NODE) -> DataFrame:
    """node, boost: of the strongest class of edge that reaches a node, the share that its mass is of the largest anchor's; nothing that rounds to 0."""
    top = p.where(F.col("node").isin(*anchors)).agg(F.max("p")).scalar()
    ceiling = ends_of(edges, base_boost().alias("base")).where("anchor <> node").groupBy("node").agg(F.max("base").alias("ceiling"))
    reached = p.where(~F.col("node").isin(*anchors) & F.col("node").startswith(prefix)).join(ceiling, "node")
    return reached.select("node", F.round(F.col("ceiling") * F.least(F.lit(1.0), F.col("p") / top)).cast("bigint").alias("boost")).where("boost > 0")


def walked_boosts(edges: DataFrame, anchors: list[str]) -> DataFrame:
    """node, boost of the capsules that a walk from the anchors reaches within two steps' edges. The frontier is written and counted; up to SMALL edges of it are walked in one task, more of them as joins."""
    near = cut(frontier(edges, anchors).select("from_node", "to_node", "extractor", F.col("confidence").cast("double").alias("confidence")))
    walk = small_pagerank if near.count() <= SMALL else personalised_pagerank
    return pagerank_boosts(walk(near, anchors), near, anchors)


def edge_drafts(capsules: DataFrame) -> DataFrame:
    """One capsule to its edges: (from_node, relation, to_node), nulls dropped."""
    me = F.concat(F.lit("capability_capsule:"), "capsule_id")
    to = lambda prefix, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(prefix), c))
    one = lambda relation, node: F.array(F.struct(F.lit(relation).alias("relation"), node.alias("to_node")))
    many = lambda relation, prefix, items: F.transform(items, lambda x: F.struct(F.lit(relation).alias("relation"), F.concat(F.lit(prefix), x).alias("to_node")))
    parts = [
        one("applies_to", to("project:", "project")), one("observed_in", to("repo:", "repo")), one("relevant_to", to("module:", "module")), one("supersedes", to("capability_capsule:", "supersedes_id")), one("extracted_from", to("session:", "session_id")),
        many("discusses", "topic:", F.transform("topics", lambda x: F.lower(trimmed(x)))), many("tagged", "tag:", F.filter(F.transform("tags", lambda x: F.lower(trimmed(x))), lambda x: ~x.startswith("contradicts:"))),
        many("mentions_file", "file:", F.transform("code_refs", lambda x: F.regexp_replace(x, r"(:[0-9]+)+$|/$", ""))),
    ]
    drafts = capsules.select(me.alias("from_node"), F.explode(reduce(lambda a, b: F.concat(a, b), parts)).alias("d"))
    return drafts.select("from_node", "d.relation", "d.to_node").where("to_node is not null").distinct()
