"""Queues, lifecycle changes and the registry of entities: tables after a change."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.fixtures import prelude, view
from tessera.operators import queue as Q
from tessera.operators import storage
from tessera.queries import query

JOBS = prelude("jobs")
CAP = prelude("capsules")
NOW = "00000001704067700000"


def jobs(spark, sf_dir):
    return view(spark, sf_dir, "jobs")


def caps(spark, sf_dir):
    return view(spark, sf_dir, "capsules")


CLAIM = f"pk AS (SELECT * FROM jobs WHERE available_at <= '{NOW}' AND (status = 'pending' OR (status = 'failed' AND attempts < 3) OR (status = 'processing' AND updated_at <= lpad(CAST({int(NOW)} - 300000 AS VARCHAR), 20, '0'))) ORDER BY available_at, created_at, job_id LIMIT 25)"


@query(f"{JOBS}, {CLAIM} SELECT job_id, status, available_at FROM pk")
def claim_jobs(spark, sf_dir):
    return Q.claim(jobs(spark, sf_dir), NOW, 3, 25).select("job_id", "status", "available_at")


@query(f"{JOBS}, {CLAIM} SELECT job_id, CASE WHEN job_id IN (SELECT job_id FROM pk) THEN 'processing' ELSE status END AS status, CASE WHEN job_id IN (SELECT job_id FROM pk) THEN '{NOW}' ELSE updated_at END AS updated_at FROM jobs")
def claimed_state(spark, sf_dir):
    j = jobs(spark, sf_dir)
    return Q.claimed(j, Q.claim(j, NOW, 3, 25), NOW).select("job_id", "status", "updated_at")


@query(f"{JOBS}, h AS (SELECT *, row_number() OVER (PARTITION BY serial_key ORDER BY created_at, job_id) AS rn FROM jobs WHERE status NOT IN ('completed', 'stale', 'dead_letter')) SELECT job_id, serial_key FROM h WHERE rn = 1 AND status = 'pending' AND available_at <= '{NOW}' ORDER BY created_at, job_id LIMIT 10")
def serial_heads(spark, sf_dir):
    return Q.heads(jobs(spark, sf_dir), NOW, 10).select("job_id", "serial_key")


@query(f"{JOBS} SELECT job_id, CASE WHEN job_id IN ('job_6', 'job_12', 'job_7') AND status = 'processing' THEN 'completed' ELSE status END AS status FROM jobs")
def finish_jobs(spark, sf_dir):
    return Q.finish(jobs(spark, sf_dir), ["job_6", "job_12", "job_7"], "completed", NOW).select("job_id", "status")


@query(
    f"""{JOBS}, f AS (SELECT *, job_id IN ('job_6', 'job_12', 'job_18', 'job_24', 'job_7') AND status = 'processing' AS hit FROM jobs)
SELECT job_id, attempts + CASE WHEN hit THEN 1 ELSE 0 END AS attempts, CASE WHEN hit THEN CASE WHEN attempts + 1 >= 4 THEN 'dead_letter' ELSE 'failed' END ELSE status END AS status,
CASE WHEN hit AND attempts + 1 < 4 THEN lpad(CAST({int(NOW)} + CASE WHEN attempts + 1 <= 1 THEN 60000 WHEN attempts + 1 = 2 THEN 300000 ELSE 1800000 END AS VARCHAR), 20, '0') ELSE available_at END AS available_at FROM f"""
)
def fail_jobs(spark, sf_dir):
    return Q.fail(jobs(spark, sf_dir), ["job_6", "job_12", "job_18", "job_24", "job_7"], 4, NOW).select("job_id", "attempts", "status", "available_at")


@query(f"{JOBS}, nw AS (SELECT tenant, capsule_id, content_hash, provider, min('new_' || job_id) AS job_id FROM jobs GROUP BY ALL) SELECT job_id FROM nw WHERE NOT EXISTS (SELECT 1 FROM jobs j WHERE j.status IN ('pending', 'processing') AND j.tenant = nw.tenant AND j.capsule_id = nw.capsule_id AND j.content_hash = nw.content_hash AND j.provider = nw.provider)")
def enqueue_jobs(spark, sf_dir):
    j = jobs(spark, sf_dir)
    return Q.enqueue(j, j.withColumn("job_id", F.concat(F.lit("new_"), "job_id"))).select("job_id")


@query(f"{JOBS} SELECT capsule_id, content_hash, max_by(status, updated_at) AS status FROM jobs GROUP BY capsule_id, content_hash")
def latest_job_status(spark, sf_dir):
    return Q.latest_status(jobs(spark, sf_dir))


@query(
    f"""{prelude('capsules', 'vectors', 'jobs')}, v AS (SELECT v.capsule_id, CASE WHEN v.n % 3 = 0 THEN 'old' ELSE c.content_hash END AS vh FROM vectors v JOIN capsules c USING (capsule_id)), j AS (SELECT capsule_id, max_by(status, updated_at) AS js FROM jobs GROUP BY capsule_id)
SELECT capsule_id, CASE WHEN vh = content_hash THEN 'indexed' WHEN vh IS NOT NULL THEN 'stale' ELSE coalesce(js, 'none') END AS state FROM capsules LEFT JOIN v USING (capsule_id) LEFT JOIN j USING (capsule_id)"""
)
def embedding_state(spark, sf_dir):
    c = caps(spark, sf_dir)
    v = view(spark, sf_dir, "vectors").join(c.select("capsule_id", "content_hash"), "capsule_id").withColumn("content_hash", F.when(F.col("n") % 3 == 0, "old").otherwise(F.col("content_hash")))
    return Q.embedding_state(c, v, jobs(spark, sf_dir))


@query(
    f"""{prelude('capsules', 'feedback')}, p AS (SELECT capsule_id, sum(CASE kind WHEN 'useful' THEN 0.1 WHEN 'applies_here' THEN 0.05 ELSE 0 END) AS dc, sum(CASE kind WHEN 'outdated' THEN 0.2 WHEN 'does_not_apply_here' THEN 0.1 ELSE 0 END) AS dd, max(CASE WHEN kind = 'incorrect' THEN 'archived' END) AS st, max(CASE WHEN kind IN ('useful', 'applies_here') THEN created_at END) AS v FROM feedback GROUP BY capsule_id)
SELECT capsule_id, CAST(round(least(1.0, confidence + coalesce(dc, 0)) * 1000) AS BIGINT) AS confidence, CAST(round(least(1.0, decay_score + coalesce(dd, 0)) * 1000) AS BIGINT) AS decay_score, coalesce(st, status) AS status, v AS validated_at FROM capsules LEFT JOIN p USING (capsule_id)"""
)
def feedback_applied(spark, sf_dir):
    out = Q.apply_feedback(caps(spark, sf_dir), view(spark, sf_dir, "feedback"))
    return out.select("capsule_id", F.round(F.col("confidence") * 1000).cast("bigint").alias("confidence"), F.round(F.col("decay_score") * 1000).cast("bigint").alias("decay_score"), "status", "validated_at")


@query(
    f"""{CAP} SELECT capsule_id, CASE WHEN coalesce(expires_at <= '{NOW}', false) THEN 'archived' ELSE status END AS status, CAST(round(least(1.0, decay_score + 0.01 * greatest(0.0, ({int(NOW)} - CAST(coalesce(last_used_at, updated_at) AS BIGINT)) / 86400000.0)) * 1000000000) AS BIGINT) AS decay_score, '{NOW}' AS last_used_at FROM capsules"""
)
def time_decay(spark, sf_dir):
    return Q.decay(caps(spark, sf_dir), NOW).select("capsule_id", "status", F.round(F.col("decay_score") * 1_000_000_000).cast("bigint").alias("decay_score"), "last_used_at")


@query(f"{CAP} SELECT capsule_id, CASE WHEN tenant = 'en' AND capsule_id = 'cap_7' AND status = 'pending_confirmation' THEN 'active' ELSE status END AS status FROM capsules")
def accept_pending(spark, sf_dir):
    return Q.transition(caps(spark, sf_dir), "en", "cap_7", "active").select("capsule_id", "status")


@query(f"{prelude('capsules', 'feedback')}, u AS (SELECT DISTINCT capsule_id FROM feedback WHERE kind = 'useful') SELECT capsule_id, CASE WHEN capsule_id IN (SELECT capsule_id FROM u) THEN '{NOW}' ELSE last_used_at END AS last_used_at, CASE WHEN capsule_id IN (SELECT capsule_id FROM u) THEN '{NOW}' ELSE last_recalled_at END AS last_recalled_at FROM capsules")
def touched_capsules(spark, sf_dir):
    c = caps(spark, sf_dir)
    used = view(spark, sf_dir, "feedback").where("kind = 'useful'").select("capsule_id").join(c.select("tenant", "capsule_id"), "capsule_id")
    return Q.touched(c, used, NOW).select("capsule_id", "last_used_at", "last_recalled_at")


@query(f"{CAP}, r AS (SELECT capsule_id, session_id, row_number() OVER (PARTITION BY session_id ORDER BY created_at, capsule_id) AS slot FROM capsules WHERE session_id IS NOT NULL) SELECT capsule_id, CAST(slot AS INTEGER) AS slot, slot <= 5 AS accepted FROM r")
def ingest_slots(spark, sf_dir):
    return Q.within_budget(caps(spark, sf_dir).where("session_id is not null"), ["session_id"], 5, F.asc("created_at"), F.asc("capsule_id")).select("capsule_id", "slot", "accepted")


@query(f"{prelude('messages')}, i AS (SELECT *, row_number() OVER (PARTITION BY transcript_path, line_number // 2, block_index ORDER BY block_id) AS rn FROM messages) SELECT transcript_path, line_number // 2 AS line_number, block_id FROM i WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM messages m WHERE m.transcript_path = i.transcript_path AND m.line_number = i.line_number // 2 AND m.block_index = i.block_index AND m.role = 'user')")
def idempotent_append(spark, sf_dir):
    m = view(spark, sf_dir, "messages")
    incoming = m.withColumn("line_number", F.floor(F.col("line_number") / 2).cast("bigint"))
    out = storage.append_new(m.where("role = 'user'"), incoming, ["transcript_path", "line_number", "block_index"], F.asc("block_id"))
    return out.select("transcript_path", "line_number", "block_id")


@query(f"{CAP} SELECT capsule_id, content FROM (SELECT capsule_id, content FROM capsules WHERE n % 10 <> 3 UNION ALL SELECT capsule_id, 'replaced' FROM capsules WHERE n % 10 = 3)")
def upsert_by_key(spark, sf_dir):
    c = caps(spark, sf_dir).select("capsule_id", "n", "content")
    return storage.replace_by_key(c, c.where("n % 10 = 3").withColumn("content", F.lit("replaced")), ["capsule_id"]).select("capsule_id", "content")


@query(f"{prelude('entities')} SELECT entity_id, canonical_name, created_at FROM entities WHERE tenant = 't1' AND kind = 'topic' AND contains(canonical_name, 'a') ORDER BY created_at DESC, entity_id LIMIT 40")
def list_entities(spark, sf_dir):
    from tessera.operators.registry import list_entities as listed

    return listed(view(spark, sf_dir, "entities"), "t1", "topic", "a", 40).select("entity_id", "canonical_name", "created_at")


@query(
    f"""{prelude('entities')}, a AS (SELECT tenant, lower(trim(canonical_name)) AS alias, min(entity_id) AS entity_id FROM entities WHERE kind = 'topic' GROUP BY 1, 2), w AS (SELECT DISTINCT tenant, lower(trim(canonical_name)) AS alias FROM entities)
SELECT w.tenant, w.alias, coalesce(a.entity_id, 'ent_' || substring(sha256(w.tenant || chr(31) || w.alias), 1, 16)) AS entity_id, a.entity_id IS NULL AS minted FROM w LEFT JOIN a ON a.tenant = w.tenant AND a.alias = w.alias"""
)
def resolve_or_create(spark, sf_dir):
    from tessera.operators import registry

    e = view(spark, sf_dir, "entities")
    aliases = e.where("kind = 'topic'").groupBy("tenant", registry.norm(F.col("canonical_name")).alias("alias_text")).agg(F.min("entity_id").alias("entity_id"))
    return registry.resolve_or_create(e.select("tenant", F.col("canonical_name").alias("alias")), aliases)


@query(
    f"""{prelude('entities')}, o AS (SELECT tenant, lower(trim(canonical_name)) AS al, min(entity_id) AS owner FROM entities GROUP BY 1, 2)
SELECT e.entity_id, CASE WHEN o.owner = e.entity_id THEN 'already_on_same_entity' WHEN o.owner IS NOT NULL THEN 'conflict' ELSE 'inserted' END AS outcome FROM entities e LEFT JOIN o ON o.tenant = e.tenant AND o.al = lower(trim(e.canonical_name)) || CASE WHEN e.kind = 'tag' THEN '!' ELSE '' END"""
)
def alias_conflicts(spark, sf_dir):
    from tessera.operators import registry

    e = view(spark, sf_dir, "entities")
    aliases = e.groupBy("tenant", registry.norm(F.col("canonical_name")).alias("alias_text")).agg(F.min("entity_id").alias("entity_id"))
    asked = e.select("tenant", "entity_id", F.concat("canonical_name", F.when(F.col("kind") == "tag", "!").otherwise("")).alias("alias"))
    return registry.alias_outcomes(asked, aliases).select("entity_id", "outcome")


@query(
    f"""{CAP}, k AS (SELECT capsule_id, tenant, idempotency_key, content_hash, updated_at FROM capsules WHERE n % 2 = 0), r AS (SELECT 'r_' || lpad(CAST(n AS VARCHAR), 8, '0') AS request_id, *, CASE WHEN n % 3 = 0 THEN content ELSE summary END AS s2 FROM capsules),
bk AS (SELECT tenant, idempotency_key, max_by(capsule_id, updated_at) AS by_key FROM k WHERE idempotency_key IS NOT NULL GROUP BY 1, 2), bh AS (SELECT tenant, content_hash, max_by(capsule_id, updated_at) AS by_hash FROM k GROUP BY 1, 2),
x AS (SELECT r.*, by_key, by_hash, least(first_value(request_id) OVER (PARTITION BY r.tenant, coalesce(r.idempotency_key, request_id) ORDER BY request_id), first_value(request_id) OVER (PARTITION BY r.tenant, r.content_hash ORDER BY request_id)) AS first_id,
 CASE WHEN s2 = content THEN 'summary repeats content' WHEN scope IN ('project', 'repo') AND coalesce(trim(project), '') = '' THEN 'scope needs a project' WHEN capsule_type = 'experience' AND length(trim(content, ' ' || chr(9) || chr(10) || chr(13))) < 40 THEN 'too_short'
 WHEN capsule_type = 'experience' AND len(code_refs) = 0 AND NOT contains(trim(content, ' ' || chr(9) || chr(10) || chr(13)), chr(10)) AND length(trim(content, ' ' || chr(9) || chr(10) || chr(13))) < 120 THEN 'single_line_without_evidence' END AS problem
 FROM r LEFT JOIN bk ON bk.tenant = r.tenant AND bk.idempotency_key = r.idempotency_key LEFT JOIN bh ON bh.tenant = r.tenant AND bh.content_hash = r.content_hash)
SELECT request_id, CASE WHEN coalesce(by_key, by_hash) IS NOT NULL THEN 'stored' WHEN problem IS NOT NULL THEN 'refused' WHEN first_id <> request_id THEN 'repeated' ELSE 'new' END AS outcome, coalesce(by_key, by_hash, CASE WHEN problem IS NULL THEN first_id END) AS stands_for, problem FROM x"""
)
def ingest_outcomes(spark, sf_dir):
    from tessera.plans import ingest

    c = caps(spark, sf_dir)
    requests = c.withColumn("request_id", F.concat(F.lit("r_"), F.lpad(F.col("n").cast("string"), 8, "0"))).withColumn("summary", F.when(F.col("n") % 3 == 0, F.col("content")).otherwise(F.col("summary"))).drop("capsule_id", "updated_at")
    return ingest.outcomes(requests, c.where("n % 2 = 0")).select("request_id", "outcome", "stands_for", "problem")


SKILLS = """WITH v AS (SELECT 't' AS tenant, 's' || CAST(p_partkey % 40 AS VARCHAR) AS skill_id, 'v' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS version_id, p_size FROM part), hd AS (SELECT tenant, skill_id, max(version_id) AS version_id FROM v GROUP BY 1, 2),
b AS (SELECT 't' AS tenant, 'a' || CAST(s_suppkey % 7 AS VARCHAR) AS agent_id, 's' || CAST(s_suppkey % 40 AS VARCHAR) AS skill_id, max(s_nationkey) AS priority, bool_or(s_acctbal > 0) AS enabled FROM supplier GROUP BY 1, 2, 3),
pn AS (SELECT 't' AS tenant, 'ses' AS session_id, agent_id, skill_id, 'v00000001' AS version_id, CASE WHEN priority % 2 = 0 THEN '9' ELSE '0' END AS expires_at FROM b WHERE priority % 3 = 0), rv AS (SELECT tenant, version_id FROM hd WHERE skill_id IN ('s3', 's5'))"""


def skill_tables(spark, sf_dir):
    part, supplier = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("part", "supplier"))
    t = F.lit("t").alias("tenant")
    skill = lambda c: F.concat(F.lit("s"), (F.col(c) % 40).cast("string")).alias("skill_id")
    v = part.select(t, skill("p_partkey"), F.concat(F.lit("v"), F.lpad(F.col("p_partkey").cast("string"), 8, "0")).alias("version_id"))
    heads = v.groupBy("tenant", "skill_id").agg(F.max("version_id").alias("version_id"))
    b = supplier.groupBy(t, F.concat(F.lit("a"), (F.col("s_suppkey") % 7).cast("string")).alias("agent_id"), skill("s_suppkey")).agg(F.max("s_nationkey").alias("priority"), F.bool_or(F.col("s_acctbal") > 0).alias("enabled"))
    pins = b.where("priority % 3 = 0").select("tenant", F.lit("ses").alias("session_id"), "agent_id", "skill_id", F.lit("v00000001").alias("version_id"), F.when(F.col("priority") % 2 == 0, "9").otherwise("0").alias("expires_at"), F.lit(1).cast("bigint").alias("revision"))
    return v, heads, b, pins, heads.where("skill_id in ('s3', 's5')").select("tenant", "version_id")


@query(
    f"""{SKILLS}, op AS (SELECT * FROM pn WHERE session_id = 'ses' AND expires_at > '5'), ch AS (SELECT b.*, coalesce(op.version_id, hd.version_id) AS version_id FROM b LEFT JOIN op USING (tenant, agent_id, skill_id) LEFT JOIN hd USING (tenant, skill_id) WHERE enabled)
SELECT agent_id, skill_id, version_id, CAST(row_number() OVER (PARTITION BY tenant, agent_id ORDER BY priority DESC, skill_id) AS INTEGER) AS pos FROM ch WHERE version_id IS NOT NULL AND version_id NOT IN (SELECT version_id FROM rv) AND skill_id IN (SELECT skill_id FROM v WHERE p_size > 25)"""
)
def resolve_loadout(spark, sf_dir):
    from tessera.operators import skills

    v, heads, b, pins, revoked = skill_tables(spark, sf_dir)
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    anchors = part.select(F.lit("t").alias("tenant"), F.concat(F.lit("s"), (F.col("p_partkey") % 40).cast("string")).alias("skill_id"), F.when(F.col("p_size") > 25, "active").otherwise("archived").alias("status"))
    return skills.resolve_loadout(b, heads, pins, revoked, anchors, "ses", "5").select("agent_id", "skill_id", "version_id", "pos")


@query(
    f"""{SKILLS}, a AS (SELECT DISTINCT 't' AS tenant, 'ses' AS session_id, agent_id, skill_id, 'v00000002' AS version_id FROM b)
SELECT a.agent_id, a.skill_id, CASE WHEN pn.expires_at > '5' THEN pn.version_id ELSE a.version_id END AS version_id, CASE WHEN pn.expires_at > '5' THEN pn.expires_at ELSE lpad('86400005', 20, '0') END AS expires_at, CAST(CASE WHEN pn.expires_at > '5' THEN 1 WHEN pn.version_id IS NULL THEN 1 ELSE 2 END AS BIGINT) AS revision FROM a LEFT JOIN pn USING (tenant, session_id, agent_id, skill_id)"""
)
def session_pins(spark, sf_dir):
    from tessera.operators import skills

    _, _, b, pins, _ = skill_tables(spark, sf_dir)
    asked = b.select("tenant", F.lit("ses").alias("session_id"), "agent_id", "skill_id", F.lit("v00000002").alias("version_id"))
    return skills.pin(pins, asked, "5").select("agent_id", "skill_id", "version_id", "expires_at", "revision")


@query(
    """WITH f AS (SELECT event_id, user_id % 30 AS s, row_number() OVER (PARTITION BY user_id % 30 ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'error') SELECT 's' || CAST(s AS VARCHAR) AS skill_id, CAST(n / 3 AS BIGINT) AS revision, event_id AS trigger_id FROM f WHERE n % 3 = 0"""
)
def revision_jobs(spark, sf_dir):
    from tessera.operators import skills

    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    f = e.select(F.lit("t").alias("tenant"), F.concat(F.lit("s"), (F.col("user_id") % 30).cast("string")).alias("skill_id"), F.lit("v").alias("version_id"), (F.col("event_type") == "error").alias("negative"), F.col("ts").alias("created_at"), F.col("event_id").alias("feedback_id"))
    return skills.revision_jobs(f).select("skill_id", "revision", "trigger_id")


@query(
    """WITH s AS (SELECT p_partkey, ['use {{a}}', CASE WHEN p_size % 2 = 0 THEN 'then {{b}} and {{a}}' ELSE 'done' END] AS steps, CASE p_size % 3 WHEN 0 THEN ['a', 'b'] WHEN 1 THEN ['a'] ELSE ['a', 'c'] END AS declared, p_size FROM part)
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size % 3 = 0 ELSE p_size % 3 = 1 END AS valid FROM s"""
)
def draft_validation(spark, sf_dir):
    from tessera.operators import skills

    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    steps = F.array(F.lit("use {{a}}"), F.when(F.col("p_size") % 2 == 0, "then {{b}} and {{a}}").otherwise("done"))
    declared = F.when(F.col("p_size") % 3 == 0, F.array(F.lit("a"), F.lit("b"))).when(F.col("p_size") % 3 == 1, F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("c")))
    return p.select("p_partkey", skills.draft_valid(steps, declared).alias("valid"))


@query("SELECT doc_id, sha256(unhex('0300000000') || encode(text)) AS fingerprint FROM documents")
def versioned_fingerprints(spark, sf_dir):
    from tessera.functions import hashing

    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", hashing.versioned(3, F.col("text")).alias("fingerprint"))


@query()
def stable_ids(spark, sf_dir):
    from tessera.functions import hashing

    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", hashing.uuid5_oid(F.concat_ws("/", "source", F.col("doc_id").cast("string"))).alias("round_id"), hashing.framed_sha256(F.array("lang", "source", "text")).alias("evidence_key"), F.sha2(hashing.task_text(F.col("text")), 256).alias("task"))


SES = "ss AS (SELECT 'ses_' || CAST(c_custkey AS VARCHAR) AS session_id, 't' || CAST(c_nationkey % 2 AS VARCHAR) AS tenant, 'a' || CAST(c_custkey % 60 AS VARCHAR) AS caller_agent, lpad(CAST(1704067200000 + c_custkey * 60000 AS VARCHAR), 20, '0') AS last_seen_at, CASE WHEN c_custkey % 3 = 0 THEN '1' END AS ended_at, CAST(c_custkey % 4 AS BIGINT) AS memory_count FROM customer)"


def session_table(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    k = F.col("c_custkey")
    s = lambda x: x.cast("string")
    return c.select(F.concat(F.lit("ses_"), s(k)).alias("session_id"), F.concat(F.lit("t"), s(F.col("c_nationkey") % 2)).alias("tenant"), F.concat(F.lit("a"), s(k % 60)).alias("caller_agent"), F.lpad(s(k * 60000 + 1704067200000), 20, "0").alias("last_seen_at"), F.when(k % 3 == 0, "1").alias("ended_at"), (k % 4).cast("bigint").alias("memory_count"))


AT = "00000001704067200000"


@query(f"WITH {SES}, o AS (SELECT *, row_number() OVER (PARTITION BY tenant, caller_agent ORDER BY last_seen_at DESC, session_id) AS rn FROM ss WHERE ended_at IS NULL), a AS (SELECT DISTINCT tenant, caller_agent, lpad(CAST(1704067200000 + 1500 * 60000 + 120000 AS VARCHAR), 20, '0') AS now FROM ss) SELECT a.tenant, a.caller_agent, CASE WHEN trunc((CAST(now AS BIGINT) - CAST(last_seen_at AS BIGINT)) / 60000.0) BETWEEN 0 AND 29 THEN session_id END AS session_id FROM a LEFT JOIN o ON o.tenant = a.tenant AND o.caller_agent = a.caller_agent AND rn = 1")
def session_decisions(spark, sf_dir):
    from tessera.operators import sessions as S

    t = session_table(spark, sf_dir)
    arrivals = t.select("tenant", "caller_agent").distinct().withColumn("now", F.lit(str(1704067200000 + 1500 * 60000 + 120000).rjust(20, "0")))
    return S.decide(t, arrivals).select("tenant", "caller_agent", "session_id")


@query(f"WITH {SES}, e AS (SELECT 'ses_' || CAST(user_id AS VARCHAR) AS session_id, lpad(CAST(epoch_us(ts) // 1000 AS VARCHAR), 20, '0') AS seen FROM events), p AS (SELECT session_id, max(seen) AS seen, count(*) AS n FROM e GROUP BY 1) SELECT ss.session_id, greatest(last_seen_at, coalesce(seen, last_seen_at)) AS last_seen_at, memory_count + coalesce(n, 0) AS memory_count FROM ss LEFT JOIN p USING (session_id)")
def session_touches(spark, sf_dir):
    from tessera.functions.timefn import stamp
    from tessera.operators import sessions as S

    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat(F.lit("ses_"), F.col("user_id").cast("string")).alias("session_id"), stamp(F.unix_millis(F.col("ts").cast("timestamp"))).alias("at"))
    return S.touch(session_table(spark, sf_dir), e).select("session_id", "last_seen_at", "memory_count")


@query(f"{CAP} SELECT capsule_id, CASE WHEN status = 'pending_confirmation' AND n % 3 <> 0 THEN 'active' ELSE status END AS status FROM capsules")
def promoted_capsules(spark, sf_dir):
    from tessera.operators import sessions as S

    c = caps(spark, sf_dir)
    return S.promote(c, c.where("n % 3 <> 0"), NOW)[0].select("capsule_id", "status")
