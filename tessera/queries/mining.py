"""Mining, similarity, evolution and fact checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.fixtures import edges, prelude, view
from tessera.operators import mining as M
from tessera.operators import retrieval as R
from tessera.operators import workers
from tessera.queries import query

CAP = prelude("capsules")
CV = prelude("capsules", "vectors")


def caps(spark, sf_dir):
    return view(spark, sf_dir, "capsules")


def vecs(spark, sf_dir):
    return view(spark, sf_dir, "vectors")


@query(f"{CAP}, t AS (SELECT DISTINCT project, capsule_id, unnest(topics) AS topic FROM capsules) SELECT x.project, x.topic AS a, y.topic AS b, count(*) AS n FROM t x JOIN t y ON x.capsule_id = y.capsule_id AND x.topic < y.topic GROUP BY x.project, x.topic, y.topic HAVING count(*) >= 2")
def cooccurrence(spark, sf_dir):
    return M.cooccurrence(caps(spark, sf_dir), 2)


@query(f"{CAP}, t AS (SELECT DISTINCT project, unnest(topics) AS topic FROM capsules), p AS (SELECT x.project AS p1, y.project AS p2, x.topic FROM t x JOIN t y ON x.topic = y.topic AND x.project < y.project), c AS (SELECT p1, p2, count(*) AS shared FROM p GROUP BY p1, p2 HAVING count(*) >= 10) SELECT p1, p2, topic, shared FROM p JOIN c USING (p1, p2)")
def topic_tunnels(spark, sf_dir):
    return M.topic_tunnels(caps(spark, sf_dir), 10)


@query(
    f"""{CAP}, e AS (SELECT tenant, capsule_id, lower('Goal  ' || CAST(n % 30 AS VARCHAR)) AS g, n FROM capsules WHERE n % 4 <> 0)
SELECT tenant, lower('Goal ' || CAST(n % 30 AS VARCHAR)) || chr(30) || 'step ' || CAST(n % 2 AS VARCHAR) || chr(31) || 'done' AS key, count(*) AS n, min(capsule_id) AS first_id, array_to_string(list_sort(list_distinct(list('ev_' || CAST(n % 5 AS VARCHAR)))), ',') AS evidence FROM e GROUP BY 1, 2 HAVING count(*) >= 2"""
)
def recurrent_workflows(spark, sf_dir):
    e = caps(spark, sf_dir).select(
        "tenant", F.col("capsule_id").alias("episode_id"), F.concat(F.lit("Goal  "), (F.col("n") % 30).cast("string")).alias("goal"), F.array(F.concat(F.lit("Step "), (F.col("n") % 2).cast("string")), F.lit(" DONE ")).alias("steps"),
        F.when(F.col("n") % 4 != 0, "success").otherwise("failure").alias("outcome"), F.array(F.concat(F.lit("ev_"), (F.col("n") % 5).cast("string"))).alias("evidence"),
    )
    return M.recurrent_workflows(e).withColumn("evidence", F.array_join("evidence", ","))


@query(f"{CAP}, r AS (SELECT * FROM capsules WHERE status = 'active' AND last_recalled_at IS NOT NULL), s AS (SELECT tenant, last_recalled_at FROM r GROUP BY 1, 2 HAVING count(*) BETWEEN 2 AND 12) SELECT x.capsule_id AS a, y.capsule_id AS b FROM r x JOIN r y ON x.tenant = y.tenant AND x.last_recalled_at = y.last_recalled_at AND x.capsule_id < y.capsule_id JOIN s ON s.tenant = x.tenant AND s.last_recalled_at = x.last_recalled_at WHERE NOT (x.capsule_id = 'cap_0' AND y.capsule_id = 'cap_4')")
def corecall_pairs(spark, sf_dir):
    return M.corecall(caps(spark, sf_dir), spark.createDataFrame([("cap_0", "cap_4")], "a string, b string"))


UNIT = "u AS (SELECT capsule_id, n, label, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS norm FROM vectors)"
SIM = "CAST(round(list_dot_product(x.e, y.e) / x.norm / y.norm * 1000000) AS BIGINT)"


@query(f"{prelude('vectors')}, {UNIT} SELECT x.capsule_id AS a, y.capsule_id AS b, {SIM} AS sim FROM u x JOIN u y ON x.capsule_id < y.capsule_id WHERE {SIM} >= 350000")
def similarity_pairs(spark, sf_dir):
    return R.similarity_pairs(vecs(spark, sf_dir), 0.35, block=128)


@query(
    f"""{prelude('vectors')}, {UNIT}, p AS (SELECT x.capsule_id AS f, y.capsule_id AS t, {SIM} AS sim FROM u x JOIN u y ON x.capsule_id <> y.capsule_id WHERE {SIM} >= 300000 AND {SIM} < 450000),
r AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY sim DESC, t) AS pos FROM p) SELECT f AS from_id, t AS to_id, sim, CAST(pos AS INTEGER) AS pos FROM r WHERE pos <= 4"""
)
def band_links(spark, sf_dir):
    return M.band_links(vecs(spark, sf_dir), 0.30, 0.45)


NEIGHBOURS = f"""{CV}, {UNIT}, v AS (SELECT u.*, c.tenant, c.status, octet_length(encode(c.content)) AS bytes, c.created_at, u.n % 3 = 0 AS model FROM u JOIN capsules c USING (capsule_id) WHERE c.status NOT IN ('archived', 'rejected') AND c.capsule_type <> 'diary'),
p AS (SELECT x.capsule_id AS f, y.capsule_id AS t, {SIM} AS sim, x.model = y.model AS alike, y.bytes, y.created_at FROM v x JOIN v y ON x.tenant = y.tenant AND x.capsule_id <> y.capsule_id WHERE x.status = 'active'),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY f ORDER BY sim DESC, t) AS pos FROM p) WHERE pos <= 11 AND alike),
fl AS (SELECT f, t, sim, row_number() OVER (PARTITION BY f ORDER BY bytes DESC, created_at, t) AS pos FROM k WHERE sim >= 420000), li AS (SELECT f, t, sim, row_number() OVER (PARTITION BY f ORDER BY sim DESC, t) AS pos FROM k WHERE sim >= 250000 AND sim < 420000)
SELECT 'capability_capsule:' || f AS from_node, 'capability_capsule:' || t AS to_node, 'suspected_supersede' AS relation, sim, 'pending_confirmation' AS status FROM fl WHERE pos = 1
UNION ALL SELECT 'capability_capsule:' || f, 'capability_capsule:' || t, 'related_to', sim, CASE WHEN EXISTS (SELECT 1 FROM fl WHERE fl.f = li.f) THEN 'pending_confirmation' ELSE 'active' END FROM li WHERE pos <= 4"""


@query(NEIGHBOURS)
def embedding_neighbourhood(spark, sf_dir):
    """All active capsules as if their vectors had just been committed; two models."""
    c, v = caps(spark, sf_dir), vecs(spark, sf_dir).select("capsule_id", F.lit(0).alias("chunk"), "embedding", (F.col("n") % 3 == 0).alias("model"))
    state, links = workers.neighbourhood(c, v, c.select("capsule_id"), "00000001704070000000", 0.42, 0.25)
    now = state.select(F.concat(F.lit("capability_capsule:"), "capsule_id").alias("from_node"), "status")
    return links.join(now, "from_node").select("from_node", "to_node", "relation", F.round(F.col("confidence") * 1_000_000).cast("bigint").alias("sim"), "status")


CLUSTER = f"""{CV}, {UNIT}, g AS (SELECT u.*, c.capsule_type AS k FROM u JOIN capsules c USING (capsule_id)), pr AS (SELECT x.capsule_id AS a, y.capsule_id AS b FROM g x JOIN g y ON x.k = y.k AND x.capsule_id < y.capsule_id WHERE {SIM} >= 300000),
l AS (SELECT a, b FROM pr UNION SELECT b, a FROM pr), reach(id, r) AS (SELECT capsule_id, capsule_id FROM g UNION SELECT l.b, reach.r FROM reach JOIN l ON l.a = reach.id), roots AS (SELECT id AS capsule_id, min(r) AS root FROM reach GROUP BY id),
cl AS (SELECT c.*, roots.root FROM roots JOIN capsules c USING (capsule_id))"""


def clustered(spark, sf_dir):
    c = caps(spark, sf_dir)
    return M.clusters(c, vecs(spark, sf_dir), 0.30, ("capsule_type",)).join(c, "capsule_id")


@query(f"{CLUSTER} SELECT capsule_id, root FROM cl")
def similarity_clusters(spark, sf_dir):
    return clustered(spark, sf_dir).select("capsule_id", "root")


@query(f"{CLUSTER}, m AS (SELECT * FROM cl WHERE capsule_type NOT IN ('preference', 'workflow')), f AS (SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM m o WHERE o.root = m.root AND o.capsule_id = m.supersedes_id)) SELECT root, array_to_string(list_sort(list(capsule_id)), ',') AS members FROM f GROUP BY root HAVING count(*) >= 2")
def detect_merge(spark, sf_dir):
    return M.detect_merge(clustered(spark, sf_dir)).withColumn("members", F.array_join("members", ","))


@query(
    f"""{CLUSTER}, e AS (SELECT * FROM cl WHERE capsule_type IN ('experience', 'episode')), s AS (SELECT root, count(*) AS n, avg(confidence) AS c FROM e GROUP BY root HAVING count(*) >= 2 AND avg(confidence) >= 0.3 - 1e-9),
t AS (SELECT root, capsule_id, unnest(list_distinct(list_filter(list_transform(list_concat(topics, tags), lambda x: lower(trim(x))), lambda x: x <> ''))) AS th FROM e), k AS (SELECT root, th, count(*) AS k FROM t GROUP BY root, th)
SELECT root, max(n) AS n, count(*) AS themes FROM k JOIN s USING (root) WHERE k = n GROUP BY root HAVING count(*) >= 1"""
)
def detect_generalize(spark, sf_dir):
    return M.detect_generalize(clustered(spark, sf_dir), 2, 1, 0.3)


@query(
    f"""{CLUSTER}, p AS (SELECT root, count(*) AS n, count(*) FILTER (WHERE last_recalled_at >= '00000001704067300000') AS rc, max(last_recalled_at) AS ever, max(decay_score) AS d, bool_or(capsule_type IN ('preference', 'workflow')) AS g FROM cl GROUP BY root),
w AS (SELECT root, n, CASE WHEN n >= 2 AND rc / n > 0.5 THEN 'up' WHEN n = 1 AND ever IS NULL AND d <= 0.8 AND NOT g THEN 'decay' END AS way FROM p) SELECT root, way, n FROM w WHERE way IS NOT NULL"""
)
def detect_reweight(spark, sf_dir):
    return M.detect_reweight(clustered(spark, sf_dir), "00000001704067300000")


@query(
    f"""{CLUSTER}, sv AS (SELECT root, capsule_id, row_number() OVER (PARTITION BY root ORDER BY octet_length(encode(content)) DESC, created_at, capsule_id) AS rn FROM cl)
SELECT c.capsule_id, c.root, s.capsule_id AS survivor FROM cl c JOIN sv s ON s.root = c.root AND s.rn = 1"""
)
def merge_survivors(spark, sf_dir):
    from tessera.operators.storage import first_of_each

    c = clustered(spark, sf_dir)
    best = first_of_each(c, ["root"], F.desc(F.octet_length("content")), F.asc("created_at"), F.asc("capsule_id")).select("root", F.col("capsule_id").alias("survivor"))
    return c.join(best, "root").select("capsule_id", "root", "survivor")


@query(
    f"""{prelude('vectors')}, {UNIT}, c AS (SELECT 'owner_' || CAST(n % 100 AS VARCHAR) AS o, capsule_id AS id, e, norm FROM u), pr AS (SELECT x.o, x.id AS a, y.id AS b, {SIM} AS sim FROM c x JOIN c y ON x.o = y.o AND x.id < y.id),
l AS (SELECT a, b FROM pr WHERE sim >= 200000 UNION SELECT b, a FROM pr WHERE sim >= 200000), reach(id, r) AS (SELECT id, id FROM c UNION SELECT l.b, reach.r FROM reach JOIN l ON l.a = reach.id), roots AS (SELECT id, min(r) AS root FROM reach GROUP BY id),
lb AS (SELECT o, c.id, root FROM c JOIN roots USING (id)), cr AS (SELECT DISTINCT pr.o FROM pr JOIN roots ra ON ra.id = a JOIN roots rb ON rb.id = b WHERE sim > 180000 AND ra.root <> rb.root)
SELECT o AS capsule_id, count(DISTINCT root) AS groups FROM lb WHERE o NOT IN (SELECT o FROM cr) GROUP BY o HAVING count(DISTINCT root) >= 2"""
)
def detect_split(spark, sf_dir):
    v = vecs(spark, sf_dir)
    chunks = v.select(F.concat(F.lit("owner_"), (F.col("n") % 100).cast("string")).alias("capsule_id"), F.col("n").alias("chunk"), "embedding")
    return M.detect_split(chunks, 0.20, 0.18)


@query(
    """WITH p AS (SELECT p_partkey AS pid, 'k' || CAST(p_size % 2 AS VARCHAR) AS k, [CAST(p_partkey % 40 AS VARCHAR), CAST(p_partkey % 40 + 1 AS VARCHAR), CAST(p_size % 3 AS VARCHAR)] AS m FROM part), c AS (SELECT s_suppkey AS cid, 'k' || CAST(s_suppkey % 2 AS VARCHAR) AS k, [CAST(s_suppkey % 40 AS VARCHAR), CAST(s_suppkey % 40 + 1 AS VARCHAR)] AS m FROM supplier),
j AS (SELECT pid, cid, CAST(round(len(list_intersect(p.m, c.m)) / len(list_distinct(list_concat(p.m, c.m))) * 1000000) AS BIGINT) AS s FROM p JOIN c USING (k) WHERE len(list_intersect(p.m, c.m)) > 0), r AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY s DESC, cid) AS rn FROM j WHERE s >= 600000) SELECT pid AS proposal_id, cid AS candidate_id, s AS score FROM r WHERE rn = 1"""
)
def candidate_matching(spark, sf_dir):
    part, supplier = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("part", "supplier"))
    s = lambda c: c.cast("string")
    p = part.select(F.col("p_partkey").alias("proposal_id"), F.concat(F.lit("k"), s(F.col("p_size") % 2)).alias("op_kind"), F.array(s(F.col("p_partkey") % 40), s(F.col("p_partkey") % 40 + 1), s(F.col("p_size") % 3)).alias("members"))
    c = supplier.select(F.col("s_suppkey").alias("candidate_id"), F.concat(F.lit("k"), s(F.col("s_suppkey") % 2)).alias("op_kind"), F.array(s(F.col("s_suppkey") % 40), s(F.col("s_suppkey") % 40 + 1)).alias("member_ids"))
    return M.match_candidates(p, c, 0.6)


@query(
    """WITH RECURSIVE s AS (SELECT user_id % 40 AS cid, CAST(epoch_ms(ts) // 86400000 AS BIGINT) AS sweep, bool_or(event_type = 'click') AS sig FROM events GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY sweep) AS i, count(*) OVER (PARTITION BY cid) AS n FROM s),
f(cid, i, n, e, c) AS (SELECT cid, i, n, CASE WHEN sig THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END, CASE WHEN sig THEN 1 ELSE 0 END FROM o WHERE i = 1 UNION ALL SELECT o.cid, o.i, o.n, f.e * 0.8::DOUBLE + CASE WHEN sig THEN 1.0 ELSE 0.0 END, CASE WHEN sig THEN f.c + 1 ELSE 0 END FROM f JOIN o ON o.cid = f.cid AND o.i = f.i + 1)
SELECT cid AS candidate_id, CAST(round(e * 1000000) AS BIGINT) AS evidence, CAST(c AS BIGINT) AS cycles, CASE WHEN c >= 3 THEN 'execute' WHEN e < 0.25 THEN 'cancel' ELSE 'hold' END AS decision FROM f WHERE i = n"""
)
def evidence_gate(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("user_id") % 40).alias("candidate_id"), F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / 86400000).alias("sweep"), (F.col("event_type") == "click").alias("signal"))
    return M.gate(e.groupBy("candidate_id", "sweep").agg(F.bool_or("signal").alias("signal")))


@query(
    f"""{prelude('entities')}, q AS (SELECT tenant, 'entity:' || CASE CAST(substr(entity_id, 5) AS INTEGER) % 3 WHEN 0 THEN substring(canonical_name, 3) WHEN 1 THEN upper(canonical_name) || ' xy' ELSE replace(canonical_name, 'a', 'oo') END AS node FROM entities),
w AS (SELECT DISTINCT tenant, node, lower(trim(regexp_replace(substr(node, 8), '\\s+', ' ', 'g'))) AS word FROM q), n AS (SELECT tenant, entity_id, canonical_name, lower(trim(canonical_name)) AS norm FROM entities),
d AS (SELECT w.tenant, node, entity_id, canonical_name, levenshtein(word, norm) AS distance FROM w JOIN n USING (tenant) WHERE abs(length(word) - length(norm)) <= 3 AND levenshtein(word, norm) BETWEEN 1 AND 3)
SELECT tenant, node, CAST(row_number() OVER (PARTITION BY tenant, node ORDER BY distance, canonical_name, entity_id) AS INTEGER) AS pos, 'entity:' || entity_id AS suggested, canonical_name, CAST(distance AS INTEGER) AS distance FROM d QUALIFY pos <= 5"""
)
def neighbour_suggestions(spark, sf_dir):
    e, name = view(spark, sf_dir, "entities"), F.col("canonical_name")
    way = F.substring("entity_id", 5, 20).cast("int") % 3
    asked = F.when(way == 0, F.expr("substring(canonical_name, 3)")).when(way == 1, F.concat(F.upper(name), F.lit(" xy"))).otherwise(F.replace(name, F.lit("a"), F.lit("oo")))
    return M.neighbour_suggestions(e.select("tenant", F.concat(F.lit("entity:"), asked).alias("node")), e)


@query(
    """WITH n AS (SELECT DISTINCT p_name AS name, lower(trim(p_name)) AS norm FROM part), w AS (SELECT DISTINCT lower(trim(CASE p_partkey % 3 WHEN 0 THEN substring(p_name, 2) WHEN 1 THEN p_name || 'x' ELSE replace(p_name, 'e', '') END)) AS word FROM part)
SELECT word, name, CAST(levenshtein(word, norm) AS INTEGER) AS distance FROM w JOIN n ON levenshtein(word, norm) BETWEEN 1 AND 2 WHERE word NOT IN (SELECT norm FROM n)"""
)
def similar_names(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    word = F.when(F.col("p_partkey") % 3 == 0, F.substring("p_name", 2, 1 << 20)).when(F.col("p_partkey") % 3 == 1, F.concat("p_name", F.lit("x"))).otherwise(F.replace("p_name", F.lit("e"), F.lit("")))
    return M.similar_names(p.select(word.alias("word")), p.select(F.col("p_name").alias("name")))


@query(
    f"""{prelude('edges')}, c AS (SELECT DISTINCT to_node AS subject, relation, from_node AS object FROM edges WHERE relation = 'part_of' UNION SELECT DISTINCT from_node, relation, 'region:4' FROM edges WHERE relation = 'part_of' UNION SELECT DISTINCT from_node, relation, to_node FROM edges WHERE relation = 'located_in' AND valid_to IS NOT NULL),
a AS (SELECT * FROM edges WHERE valid_to IS NULL), u AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM a WHERE from_node = subject AND a.relation = c.relation AND to_node = object))
SELECT DISTINCT u.subject, u.relation, u.object, 'direction' AS conflict FROM u JOIN a ON a.to_node = subject AND a.relation = u.relation AND a.from_node = object
UNION SELECT DISTINCT subject, u.relation, object, 'different_object' FROM u JOIN a ON a.from_node = subject AND a.relation = u.relation UNION SELECT DISTINCT subject, u.relation, object, 'restates_closed' FROM u JOIN edges e ON e.valid_to IS NOT NULL AND e.from_node = subject AND e.relation = u.relation AND e.to_node = object"""
)
def relation_conflicts(spark, sf_dir):
    e = edges(spark, sf_dir)
    part_of = e.where("relation = 'part_of'")
    claims = (
        part_of.select(F.col("to_node").alias("subject"), "relation", F.col("from_node").alias("object")).unionByName(part_of.select(F.col("from_node").alias("subject"), "relation", F.lit("region:4").alias("object")))
        .unionByName(e.where("relation = 'located_in' and valid_to is not null").select(F.col("from_node").alias("subject"), "relation", F.col("to_node").alias("object"))).distinct()
    )
    return M.relation_conflicts(claims, e)
