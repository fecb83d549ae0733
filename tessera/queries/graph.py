"""Graph queries over the edges view."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.fixtures import edges, prelude, view
from tessera.operators import graph as G
from tessera.queries import query

E = prelude("edges")
KEY = ("from_node", "relation", "to_node", "valid_from")
K = ", ".join(KEY)
AS_OF = "00000001704067200300"


@query(f"{E} SELECT {K} FROM edges WHERE relation = 'located_in' AND valid_from <= '{AS_OF}' AND (valid_to IS NULL OR valid_to > '{AS_OF}')")
def edges_as_of(spark, sf_dir):
    return G.predicate(edges(spark, sf_dir), "located_in", AS_OF).select(*KEY)


@query(f"{E} SELECT {K} FROM edges WHERE relation = 'part_of'")
def edges_of_relation(spark, sf_dir):
    return G.predicate(edges(spark, sf_dir), "part_of").select(*KEY)


@query(f"{E} SELECT {K} FROM edges WHERE (from_node = 'nation:3' OR to_node = 'nation:3') AND valid_to IS NULL")
def neighbors(spark, sf_dir):
    return G.neighbors(edges(spark, sf_dir), "nation:3").select(*KEY)


@query(f"{E} SELECT {K}, valid_to FROM edges WHERE from_node = 'nation:3' OR to_node = 'nation:3'")
def timeline(spark, sf_dir):
    return G.timeline(edges(spark, sf_dir), "nation:3").select(*KEY, "valid_to")


@query(f"{E} SELECT {K} FROM edges WHERE relation LIKE 'user\\_tunnel:%' ESCAPE '\\' AND valid_to IS NULL ORDER BY relation, from_node, to_node LIMIT 50")
def list_tunnels(spark, sf_dir):
    return G.tunnels(edges(spark, sf_dir), 50).select(*KEY)


@query(f"{E} SELECT DISTINCT {K} FROM edges WHERE valid_to IS NULL AND ((from_node LIKE 'supplier:%' AND to_node LIKE 'nation:1%') OR (from_node LIKE 'nation:1%' AND to_node LIKE 'supplier:%')) ORDER BY from_node, to_node, relation, valid_from LIMIT 40")
def find_tunnels(spark, sf_dir):
    return G.find_tunnels(edges(spark, sf_dir), "supplier:", "nation:1", 40).select(*KEY)


def hops_sql(source: str, node: str, n: int) -> str:
    steps = [f"e1 AS (SELECT * FROM {source} WHERE from_node = '{node}' OR to_node = '{node}')"]
    for i in range(2, n + 1):
        steps.append(f"e{i} AS (SELECT DISTINCT e.* FROM {source} e WHERE from_node IN (SELECT from_node FROM e{i - 1} UNION SELECT to_node FROM e{i - 1}) OR to_node IN (SELECT from_node FROM e{i - 1} UNION SELECT to_node FROM e{i - 1}))")
    return ", ".join(steps) + f" SELECT {K} FROM e{n}"


@query(f"{E}, live AS (SELECT * FROM edges WHERE valid_to IS NULL), {hops_sql('live', 'supplier:4', 3)}")
def k_hop(spark, sf_dir):
    return G.within_hops(edges(spark, sf_dir), "supplier:4", 3).select(*KEY)


@query(f"{E}, live AS (SELECT * FROM edges WHERE valid_from <= '{AS_OF}' AND (valid_to IS NULL OR valid_to > '{AS_OF}')), {hops_sql('live', 'supplier:4', 2)}")
def k_hop_as_of(spark, sf_dir):
    return G.within_hops(edges(spark, sf_dir), "supplier:4", 2, AS_OF).select(*KEY)


@query(f"{E}, live AS (SELECT * FROM edges WHERE valid_to IS NULL AND starts_with(relation, 'user_tunnel:')), {hops_sql('live', 'supplier:4', 3)}")
def follow_tunnels(spark, sf_dir):
    return G.follow_tunnels(edges(spark, sf_dir), "supplier:4", 3).select(*KEY)


@query(f"{E} SELECT DISTINCT CASE WHEN from_node IN ('nation:1', 'nation:2') THEN to_node ELSE from_node END AS other FROM edges WHERE valid_to IS NULL AND (from_node IN ('nation:1', 'nation:2') OR to_node IN ('nation:1', 'nation:2')) AND CASE WHEN from_node IN ('nation:1', 'nation:2') THEN to_node ELSE from_node END LIKE 'customer:%'")
def related_nodes(spark, sf_dir):
    return G.related(edges(spark, sf_dir), spark.createDataFrame([("nation:1",), ("nation:2",)], "node string"), "customer:")


@query(f"{E} SELECT DISTINCT {K} FROM edges WHERE valid_to IS NULL AND (from_node IN ('nation:1', 'region:2') OR to_node IN ('nation:1', 'region:2'))")
def incident_edges(spark, sf_dir):
    return G.incident(edges(spark, sf_dir), spark.createDataFrame([("nation:1",), ("region:2",)], "node string")).select(*KEY)


@query(f"{E} SELECT count(*) AS edges, count(*) FILTER (WHERE valid_to IS NULL) AS active, count(*) FILTER (WHERE valid_to IS NOT NULL) AS closed, (SELECT count(DISTINCT n) FROM (SELECT from_node AS n FROM edges UNION ALL SELECT to_node FROM edges)) AS nodes FROM edges")
def graph_stats(spark, sf_dir):
    return G.stats(edges(spark, sf_dir))


@query(f"{E} SELECT relation, count(*) AS n FROM edges GROUP BY relation ORDER BY n DESC, relation LIMIT 16")
def top_relations(spark, sf_dir):
    return G.top_relations(edges(spark, sf_dir))


@query(f"{E}, nw AS (SELECT from_node, to_node, relation, '99' AS valid_from, CASE WHEN from_node LIKE '%7' THEN '00' END AS valid_to FROM edges WHERE relation = 'located_in') SELECT DISTINCT from_node, to_node, relation FROM nw WHERE (valid_to IS NULL OR valid_to >= valid_from) AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.valid_to IS NULL AND e.from_node = nw.from_node AND e.to_node = nw.to_node AND e.relation = nw.relation)")
def add_edges(spark, sf_dir):
    e = edges(spark, sf_dir)
    new = e.where("relation = 'located_in'").withColumn("valid_from", F.lit("99")).withColumn("valid_to", F.when(F.col("from_node").endswith("7"), "00"))
    return G.add_edges(e, new).select("from_node", "to_node", "relation")


@query(f"{E} SELECT from_node, to_node, relation, CASE WHEN from_node = 'nation:3' AND relation = 'part_of' AND to_node = 'region:1' AND valid_to IS NULL THEN '9' ELSE valid_to END AS valid_to FROM edges")
def invalidate_edge(spark, sf_dir):
    return G.invalidate(edges(spark, sf_dir), "nation:3", "part_of", "region:1", "9").select("from_node", "to_node", "relation", "valid_to")


@query(f"{E} SELECT from_node, to_node, relation, CASE WHEN relation = 'located_in' AND from_node LIKE 'supplier:%' AND valid_to IS NULL AND to_node <> 'nation:0' THEN '9' ELSE valid_to END AS valid_to FROM edges")
def functional_conflicts(spark, sf_dir):
    e = edges(spark, sf_dir)
    new = e.where("relation = 'located_in' and from_node like 'supplier:%'").withColumn("to_node", F.lit("nation:0"))
    return G.close_conflicts(e, new, ["located_in"], "9").select("from_node", "to_node", "relation", "valid_to")


@query(
    f"""{E}, l AS (SELECT *, CASE WHEN extractor IN ('ingest_link', 'o7_neardup_cluster') THEN 4 * least(1.0, greatest(0.0, coalesce(confidence, 1.0))) ELSE 12.0 END AS base FROM edges WHERE valid_to IS NULL),
x AS (SELECT from_node AS a, to_node AS node, base FROM l UNION ALL SELECT to_node, from_node, base FROM l), y AS (SELECT * FROM x WHERE a IN ('nation:1', 'supplier:4', 'supplier:8')), d AS (SELECT a, count(*) AS deg FROM y GROUP BY a)
SELECT node, max(CAST(round(base * (1.0 / (1.0 + 0.001 * (deg - 1) * (deg - 1)))) AS BIGINT)) AS boost FROM y JOIN d USING (a) WHERE node NOT IN ('nation:1', 'supplier:4', 'supplier:8') GROUP BY node"""
)
def one_hop_boosts(spark, sf_dir):
    return G.one_hop_boosts(edges(spark, sf_dir), ["nation:1", "supplier:4", "supplier:8"])


BASE = "CASE WHEN extractor IN ('ingest_link', 'o7_neardup_cluster') THEN 4 * least(1.0, greatest(0.0, coalesce(confidence, 1.0))) ELSE 12.0 END"


def walk_sql(edges: str, anchors: str, rounds: int) -> str:
    """CTEs up to p<rounds> (node, p): the walk over a table of edges from a table of anchors (node); no step from a node to itself."""
    head = f"""w AS (SELECT *, {BASE} AS b FROM {edges}), nd AS (SELECT from_node AS node FROM w UNION SELECT to_node FROM w), pr AS (SELECT node FROM {anchors} WHERE node IN (SELECT node FROM nd)),
sd AS (SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM pr) AS seed FROM pr),
ar AS (SELECT from_node AS u, to_node AS v, b FROM w WHERE b > 0 AND from_node <> to_node UNION ALL SELECT to_node, from_node, b FROM w WHERE b > 0 AND from_node <> to_node),
sh AS MATERIALIZED (SELECT u, v, sum(b / t) AS share FROM ar JOIN (SELECT u, sum(b) AS t FROM ar GROUP BY u) USING (u) GROUP BY u, v), p0 AS (SELECT node, seed AS p FROM sd)"""
    steps = [
        f"p{i} AS MATERIALIZED (SELECT node, 0.5 * coalesce(flow, 0) + 0.5 * coalesce(seed, 0) AS p FROM (SELECT v AS node, sum(p * share) AS flow FROM p{i - 1} JOIN sh ON node = u GROUP BY v) FULL OUTER JOIN sd USING (node))"
        for i in range(1, rounds + 1)
    ]
    return ", ".join([head, *steps])


def ppr_sql(rounds: int) -> str:
    return f"""{E}, live AS (SELECT * FROM edges WHERE valid_to IS NULL), an AS (SELECT unnest(['supplier:4', 'supplier:8', 'absent:1']) AS node), {walk_sql('live', 'an', rounds)} SELECT node, CAST(round(p * 1000000) AS BIGINT) AS p FROM p{rounds}"""


@query(ppr_sql(20))
def personalised_pagerank(spark, sf_dir):
    p = G.personalised_pagerank(edges(spark, sf_dir).where("valid_to is null"), ["supplier:4", "supplier:8", "absent:1"])
    return p.select("node", F.round(F.col("p") * 1_000_000).cast("bigint").alias("p"))


@query(
    f"""{prelude('capsules')}, d AS (SELECT capsule_id, 'applies_to' AS relation, 'project:' || project AS to_node FROM capsules UNION SELECT capsule_id, 'observed_in', 'repo:' || repo FROM capsules
UNION SELECT capsule_id, 'relevant_to', 'module:' || module FROM capsules UNION SELECT capsule_id, 'supersedes', 'capability_capsule:' || supersedes_id FROM capsules UNION SELECT capsule_id, 'extracted_from', 'session:' || session_id FROM capsules
UNION SELECT capsule_id, 'discusses', 'topic:' || lower(trim(x)) FROM (SELECT capsule_id, unnest(topics) AS x FROM capsules) UNION SELECT capsule_id, 'tagged', 'tag:' || lower(trim(x)) FROM (SELECT capsule_id, unnest(tags) AS x FROM capsules)
UNION SELECT capsule_id, 'mentions_file', 'file:' || regexp_replace(x, '(:[0-9]+)+$', '') FROM (SELECT capsule_id, unnest(code_refs) AS x FROM capsules))
SELECT 'capability_capsule:' || capsule_id AS from_node, relation, to_node FROM d WHERE to_node IS NOT NULL"""
)
def edge_drafts(spark, sf_dir):
    return G.edge_drafts(view(spark, sf_dir, "capsules"))
