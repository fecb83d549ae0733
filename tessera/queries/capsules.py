"""Reads, predicates and roll-ups of capsules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.fixtures import prelude, view
from tessera.operators import capsules as C
from tessera.operators.storage import first_of_each
from tessera.queries import query
from tessera.schemas import FEEDBACK, STATUSES

CAP = prelude("capsules")
NOW = "00000001704070000000"
T = "en"


def caps(spark, sf_dir):
    return view(spark, sf_dir, "capsules")


@query(f"{CAP} SELECT capsule_id, tenant, status, version FROM capsules WHERE capsule_id = 'cap_7' AND tenant = 'en'")
def point_lookup(spark, sf_dir):
    return C.by_id(caps(spark, sf_dir), "cap_7", T).select("capsule_id", "tenant", "status", "version")


@query(f"{CAP} SELECT capsule_id, tenant, status FROM capsules WHERE status = 'pending_confirmation' AND tenant = 'en' AND capsule_id = 'cap_7'")
def pending_lookup(spark, sf_dir):
    return C.pending(caps(spark, sf_dir), T, "cap_7").select("capsule_id", "tenant", "status")


@query(f"{CAP} SELECT 'cap_1' AS capsule_id, coalesce((SELECT CASE WHEN status = 'pending_confirmation' THEN 'pending' ELSE 'conflict' END FROM capsules WHERE capsule_id = 'cap_1' AND tenant = 'en'), 'not_found') AS outcome")
def pending_verdict(spark, sf_dir):
    return C.pending_verdict(caps(spark, sf_dir), T, "cap_1")


@query(
    f"""{CAP}, h AS (SELECT content_hash AS h FROM capsules WHERE capsule_id = 'cap_3')
SELECT capsule_id, updated_at FROM capsules WHERE tenant = 'en' AND (idempotency_key = 'key_17' OR content_hash = sha256('nothing'))
ORDER BY CASE WHEN idempotency_key = 'key_17' THEN 0 ELSE 1 END, updated_at DESC, capsule_id LIMIT 1"""
)
def key_or_hash_lookup(spark, sf_dir):
    import hashlib

    return C.by_key_or_hash(caps(spark, sf_dir), T, "key_17", hashlib.sha256(b"nothing").hexdigest()).select("capsule_id", "updated_at")


@query(f"{CAP} SELECT capsule_id, status, updated_at FROM capsules WHERE tenant = 'en'")
def tenant_scan(spark, sf_dir):
    return caps(spark, sf_dir).where(F.col("tenant") == T).select("capsule_id", "status", "updated_at")


@query(f"{CAP} SELECT capsule_id, tenant FROM capsules WHERE tenant = 'en' AND capsule_id IN ('cap_1', 'cap_2', 'cap_5', 'nope')")
def semi_join_by_ids(spark, sf_dir):
    ids = spark.createDataFrame([("cap_1",), ("cap_2",), ("cap_5",), ("nope",)], "capsule_id string")
    return C.by_ids(caps(spark, sf_dir), T, ids).select("capsule_id", "tenant")


@query(
    f"""{CAP}, p AS (SELECT capsule_id, updated_at, row_number() OVER (ORDER BY updated_at DESC, capsule_id) AS pos, count(*) OVER () AS n FROM capsules
WHERE tenant = 'en' AND status = 'active' AND (updated_at < '{NOW}' OR (updated_at = '{NOW}' AND capsule_id > 'cap_5')))
SELECT capsule_id, updated_at, CAST(pos AS INTEGER) AS pos, n > 20 AS has_more FROM p WHERE pos <= 20"""
)
def scope_page(spark, sf_dir):
    return C.scope_page(caps(spark, sf_dir), T, (NOW, "cap_5"), 20, status="active", project=None).select("capsule_id", "updated_at", "pos", "has_more")


@query(f"{CAP} SELECT capsule_id, created_at FROM capsules WHERE tenant = 'en' AND status = 'pending_confirmation'")
def pending_review(spark, sf_dir):
    return C.pending_review(caps(spark, sf_dir), T).select("capsule_id", "created_at")


@query(f"{CAP} SELECT capsule_id, created_at FROM capsules WHERE tenant = 'en' AND status = 'pending_confirmation' AND updated_at < '{NOW}' AND decay_score < 0.4 AND capsule_type IN ('experience', 'episode')")
def auto_promote_candidates(spark, sf_dir):
    return C.auto_promote_candidates(caps(spark, sf_dir), T, NOW, ["experience", "episode"], 0.4).select("capsule_id", "created_at")


SUPERSEDED = "(SELECT tenant AS st, supersedes_id AS sid FROM capsules WHERE status = 'active' AND supersedes_id IS NOT NULL)"


@query(f"{CAP} SELECT capsule_id, tenant, updated_at, version FROM capsules c WHERE status NOT IN ('rejected', 'archived') AND capsule_type <> 'diary' AND NOT EXISTS (SELECT 1 FROM {SUPERSEDED} s WHERE st = c.tenant AND sid = c.capsule_id)")
def recall_pool(spark, sf_dir):
    return C.recall_pool(caps(spark, sf_dir)).select("capsule_id", "tenant", "updated_at", "version")


@query(
    f"""{CAP}, p AS (SELECT *, row_number() OVER (PARTITION BY tenant ORDER BY updated_at DESC, version DESC, capsule_id) AS r FROM capsules c
WHERE status NOT IN ('rejected', 'archived') AND capsule_type <> 'diary' AND NOT EXISTS (SELECT 1 FROM {SUPERSEDED} s WHERE st = c.tenant AND sid = c.capsule_id))
SELECT capsule_id, tenant FROM p WHERE r <= 10 OR capsule_type IN ('preference', 'workflow')"""
)
def recall_pool_bounded(spark, sf_dir):
    return C.recall_pool(caps(spark, sf_dir), newest=10).select("capsule_id", "tenant")


@query(f"{CAP} SELECT capsule_id, updated_at FROM capsules WHERE tenant = 'en' AND status NOT IN ('rejected', 'archived') AND capsule_type <> 'diary' ORDER BY updated_at DESC, capsule_id LIMIT 32")
def recent_pool(spark, sf_dir):
    return C.recent_pool(caps(spark, sf_dir), T, 32).select("capsule_id", "updated_at")


@query(f"{CAP} SELECT capsule_id, updated_at FROM capsules WHERE tenant = 'en'")
def id_list(spark, sf_dir):
    return C.id_list(caps(spark, sf_dir), T)


@query(
    f"""{CAP} SELECT capsule_id,
coalesce(length(expires_at) = 20 AND expires_at <= '{NOW}', false) AS expired,
NOT (capsule_type = 'workflow' AND source_agent = 'skill-proposal-compiler') AS admitted,
capsule_type IN ('preference', 'workflow') AS guidance, capsule_type IN ('experience', 'episode') AS episodic,
CASE WHEN capsule_type IN ('preference', 'workflow') OR scope = 'project' THEN 'pending_confirmation' ELSE 'active' END AS first_status,
CASE WHEN capsule_type = 'workflow' AND source_agent = 'skill-proposal-compiler' THEN 'skill_bundle_required' WHEN capsule_type IN ('preference', 'workflow') THEN 'human_review_only' ELSE 'auto_eligible' END AS policy,
CAST(round(CASE status WHEN 'active' THEN 0.9 WHEN 'pending_confirmation' THEN 0.6 WHEN 'provisional' THEN 0.5 ELSE 0 END * 10) AS BIGINT) AS usual_confidence,
CASE WHEN capsule_type <> 'experience' THEN NULL WHEN length(trim(content, ' ' || chr(9) || chr(10) || chr(13))) < 40 THEN 'too_short'
 WHEN len(code_refs) = 0 AND NOT contains(trim(content, ' ' || chr(9) || chr(10) || chr(13)), chr(10)) AND length(trim(content, ' ' || chr(9) || chr(10) || chr(13))) < 120 THEN 'single_line_without_evidence' END AS low_value
FROM capsules"""
)
def capsule_rules(spark, sf_dir):
    return caps(spark, sf_dir).select(
        "capsule_id", C.is_expired(NOW).alias("expired"), C.allowed_in_recall().alias("admitted"), C.is_guidance().alias("guidance"), C.is_episodic().alias("episodic"),
        C.initial_status(F.col("capsule_type"), F.when(F.col("scope") == "project", "propose").otherwise("auto")).alias("first_status"), C.activation_policy().alias("policy"),
        F.round(C.default_confidence(F.col("status")) * 10).cast("bigint").alias("usual_confidence"), C.low_value_reason().alias("low_value"),
    )


@query(f"{CAP} SELECT capsule_id, (repo = 'repo_1' OR coalesce(module = 'mod_2', false) OR list_contains(tags, ' Tag_1')) AS in_scope FROM capsules")
def scope_predicate(spark, sf_dir):
    return caps(spark, sf_dir).select("capsule_id", C.matches_any_scope(["repo:repo_1", "module:mod_2", " Tag_1"]).alias("in_scope"))


@query(
    f"""{CAP} SELECT capsule_id FROM capsules WHERE status = 'active' AND last_recalled_at IS NULL AND created_at <= '{NOW}' AND confidence <= 0.5 + 1e-6 AND decay_score >= 0.3
AND capsule_type = 'experience' AND (length(trim(content, ' ' || chr(9) || chr(10) || chr(13))) < 400 OR (len(code_refs) = 0 AND NOT contains(trim(content, ' ' || chr(9) || chr(10) || chr(13)), chr(10)) AND length(trim(content, ' ' || chr(9) || chr(10) || chr(13))) < 1200))"""
)
def idle_archive_candidates(spark, sf_dir):
    return caps(spark, sf_dir).where(C.idle_candidate(NOW, 0.5, 0.3, 400)).select("capsule_id")


@query(f"{CAP} SELECT tenant, count(*) AS total, {', '.join(f'''count(*) FILTER (WHERE status = '{s}') AS {s}''' for s in STATUSES)} FROM capsules GROUP BY tenant")
def status_histogram(spark, sf_dir):
    return C.status_histogram(caps(spark, sf_dir))


@query(f"{prelude('feedback')} SELECT capsule_id, count(*) AS total, {', '.join(f'''count(*) FILTER (WHERE kind = '{k}') AS {k}''' for k in FEEDBACK)} FROM feedback GROUP BY capsule_id")
def feedback_histogram(spark, sf_dir):
    return C.feedback_histogram(view(spark, sf_dir, "feedback"))


@query(f"{CAP} SELECT DISTINCT project FROM capsules WHERE tenant = 'en' AND project IS NOT NULL")
def wings(spark, sf_dir):
    return C.wings(caps(spark, sf_dir), T)


@query(f"{CAP} SELECT project, array_to_string(list_sort(list(DISTINCT repo)), ',') AS repos FROM capsules WHERE tenant = 'en' AND project IS NOT NULL GROUP BY project")
def taxonomy(spark, sf_dir):
    return C.taxonomy(caps(spark, sf_dir), T).select("project", F.array_join("repos", ",").alias("repos"))


@query(
    f"""{prelude('capsules', 'entities')},
u AS (SELECT 'preferences' AS section, capsule_id AS id, updated_at FROM capsules WHERE tenant = 't1' AND status = 'active' AND capsule_type = 'preference'
UNION ALL SELECT 'workflows', capsule_id, updated_at FROM capsules WHERE tenant = 't1' AND status = 'active' AND capsule_type = 'workflow'
UNION ALL SELECT 'entities', entity_id, created_at FROM entities WHERE tenant = 't1'),
r AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY updated_at DESC, id) AS pos FROM u)
SELECT section, id, updated_at, CAST(pos AS INTEGER) AS pos FROM r WHERE pos <= 5"""
)
def profile(spark, sf_dir):
    return C.profile(caps(spark, sf_dir), view(spark, sf_dir, "entities"), "t1", 5)


@query(
    f"""{CAP}, e AS (SELECT n % 77 AS cohort, list_distinct(list_filter(list_transform(list_concat(topics, tags), lambda x: lower(trim(x))), lambda x: x <> '')) AS th FROM capsules),
n AS (SELECT cohort, count(*) AS members FROM e GROUP BY cohort), u AS (SELECT cohort, unnest(th) AS theme FROM e)
SELECT cohort, theme, members FROM (SELECT cohort, theme, count(*) AS c FROM u GROUP BY cohort, theme) JOIN n USING (cohort) WHERE c = members"""
)
def shared_themes(spark, sf_dir):
    return C.shared_themes(caps(spark, sf_dir).withColumn("cohort", F.col("n") % 77), "cohort")


@query(f"{CAP} SELECT session_id, CASE WHEN count(DISTINCT module) = 1 AND count(module) = count(*) THEN max(module) END AS module, CASE WHEN count(DISTINCT tenant) = 1 AND count(tenant) = count(*) THEN max(tenant) END AS tenant FROM capsules GROUP BY session_id")
def common_value(spark, sf_dir):
    return caps(spark, sf_dir).groupBy("session_id").agg(C.shared_value("module").alias("module"), C.shared_value("tenant").alias("tenant"))


@query(
    f"""{CAP}, v AS (SELECT capsule_id AS a, supersedes_id AS b FROM capsules WHERE tenant = 'en' AND supersedes_id IN (SELECT capsule_id FROM capsules WHERE tenant = 'en')),
l AS (SELECT a, b FROM v UNION SELECT b, a FROM v), r(id) AS (SELECT 'cap_18' UNION SELECT b FROM l JOIN r ON l.a = r.id)
SELECT capsule_id, version, updated_at, supersedes_id FROM capsules WHERE tenant = 'en' AND capsule_id IN (SELECT id FROM r)"""
)
def version_chain(spark, sf_dir):
    return C.version_chain(caps(spark, sf_dir), T, "cap_18").select("capsule_id", "version", "updated_at", "supersedes_id")


@query(f"{CAP}, r AS (SELECT *, row_number() OVER (PARTITION BY coalesce(idempotency_key, content_hash) ORDER BY capsule_id) AS rn FROM capsules) SELECT capsule_id, content_hash FROM r WHERE rn = 1")
def ingest_batch_dedup(spark, sf_dir):
    rows = caps(spark, sf_dir).withColumn("dedup_key", F.coalesce("idempotency_key", "content_hash"))
    return first_of_each(rows, ["dedup_key"], F.asc("capsule_id")).select("capsule_id", "content_hash")
