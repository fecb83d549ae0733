"""Sweeps carried out, and candidate jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.fixtures import edges, prelude, view
from tessera.operators import evolution as V
from tessera.plans import evolution_sweep
from tessera.queries import query

CAP = prelude("capsules")
NOW = "00000001704070000000"
#: Proposals: active capsules of one (project, n % 3).
MEM = "mb AS (SELECT project || '/' || CAST(n % 3 AS VARCHAR) AS proposal_id, capsule_id, content, created_at FROM capsules WHERE status = 'active')"


def tables(spark, sf_dir):
    c = view(spark, sf_dir, "capsules")
    return c, c.where("status = 'active'").select(F.concat_ws("/", "project", (F.col("n") % 3).cast("string")).alias("proposal_id"), "capsule_id")


SURV = f"{CAP}, {MEM}, sv AS (SELECT proposal_id, capsule_id AS survivor FROM (SELECT *, row_number() OVER (PARTITION BY proposal_id ORDER BY octet_length(encode(content)) DESC, created_at, capsule_id) AS rn FROM mb) WHERE rn = 1), ls AS (SELECT capsule_id, survivor FROM mb JOIN sv USING (proposal_id) WHERE capsule_id <> survivor)"


@query(f"{SURV} SELECT capsule_id, CASE WHEN capsule_id IN (SELECT capsule_id FROM ls) THEN 'archived' ELSE status END AS status FROM capsules")
def execute_merge(spark, sf_dir):
    c, members = tables(spark, sf_dir)
    return V.execute_merge(c, members, NOW)[0].select("capsule_id", "status")


@query(f"{SURV} SELECT 'capability_capsule:' || capsule_id AS from_node, 'capability_capsule:' || survivor AS to_node, 'merged_into' AS relation FROM ls")
def merge_lineage(spark, sf_dir):
    c, members = tables(spark, sf_dir)
    return V.execute_merge(c, members, NOW)[1].select("from_node", "to_node", "relation")


@query(f"{CAP} SELECT capsule_id, status FROM capsules")
def rollback_merge(spark, sf_dir):
    """A merge and its rollback leave every status as it was."""
    c, members = tables(spark, sf_dir)
    merged, edges = V.execute_merge(c, members, NOW)
    return V.rollback_merge(merged, edges, members, NOW)[0].select("capsule_id", "status")


@query(f"{CAP} SELECT capsule_id, CAST(round(CASE WHEN n % 2 = 0 AND decay_score <= 0.8 THEN least(1.0, confidence + 0.02) ELSE confidence END * 1000) AS BIGINT) AS confidence, CAST(round(CASE WHEN n % 2 = 1 AND decay_score <= 0.8 THEN least(0.9, decay_score + 0.05) ELSE decay_score END * 1000) AS BIGINT) AS decay_score FROM capsules")
def execute_reweight(spark, sf_dir):
    c, _ = tables(spark, sf_dir)
    out = V.execute_reweight(c, c.select("capsule_id", F.when(F.col("n") % 2 == 0, "up").otherwise("decay").alias("way")))
    return out.select("capsule_id", F.round(F.col("confidence") * 1000).cast("bigint").alias("confidence"), F.round(F.col("decay_score") * 1000).cast("bigint").alias("decay_score"))


@query(f"{CAP}, {MEM}, l AS (SELECT proposal_id, list_sort(list(DISTINCT capsule_id)) AS s FROM mb GROUP BY 1) SELECT 'evo_' || substring(sha256('generalize' || chr(31) || array_to_string(s, chr(31))), 1, 16) AS capsule_id, 'generalize placeholder, pending review. Sources: ' || array_to_string(s, ', ') AS content FROM l")
def review_placeholders(spark, sf_dir):
    c, members = tables(spark, sf_dir)
    return V.placeholders(members, c, "generalize", "generalizes", NOW)[0].select("capsule_id", "content")


@query(
    """WITH e AS (SELECT 'capability_capsule:cap_' || CAST(s_suppkey AS VARCHAR) AS f, 'capability_capsule:cap_' || CAST(s_suppkey + 1 AS VARCHAR) AS t, lpad(CAST(s_suppkey * 7 % 100 AS VARCHAR), 20, '0') AS vf, CASE WHEN s_suppkey % 3 = 0 THEN lpad(CAST(s_suppkey * 5 % 100 AS VARCHAR), 20, '0') END AS la, CASE WHEN s_suppkey % 11 = 0 THEN '1' END AS vt FROM supplier),
k AS (SELECT 'capability_capsule:cap_' || CAST(doc_id AS VARCHAR) AS n FROM documents WHERE doc_id % 10 NOT IN (6, 7, 8, 9))
SELECT f AS from_node, t AS to_node, CASE WHEN vt IS NULL AND greatest(coalesce(la, ''), vf) < lpad('50', 20, '0') AND (f IN (SELECT n FROM k) OR t IN (SELECT n FROM k)) THEN '9' ELSE vt END AS valid_to FROM e"""
)
def prune_corecall(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    pad = lambda c: F.lpad(c.cast("string"), 20, "0")
    k = F.col("s_suppkey")
    e = s.select(F.concat(F.lit("capability_capsule:cap_"), k.cast("string")).alias("from_node"), F.concat(F.lit("capability_capsule:cap_"), (k + 1).cast("string")).alias("to_node"), F.lit("co_recalled_with").alias("relation"), pad(k * 7 % 100).alias("valid_from"), F.when(k % 11 == 0, "1").alias("valid_to"), F.when(k % 3 == 0, pad(k * 5 % 100)).alias("last_activated"))
    return V.prune_idle(e, view(spark, sf_dir, "capsules"), "co_recalled_with", "50".rjust(20, "0"), "9").select("from_node", "to_node", "valid_to")


JOB = "jb AS (SELECT o_orderkey AS job_id, CASE o_orderkey % 3 WHEN 0 THEN 'stale' WHEN 1 THEN 'pending' ELSE 'completed' END AS status, o_orderkey % 2 AS v, CASE WHEN o_orderkey % 5 = 0 THEN '9' END AS lease FROM orders), rf AS (SELECT l_orderkey AS job_id, l_partkey AS k FROM lineitem), ev AS (SELECT p_partkey AS k FROM part WHERE p_partkey % 4 <> 0)"


def job_tables(spark, sf_dir):
    o, li, p = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem", "part"))
    k = F.col("o_orderkey")
    jobs = o.select(k.alias("job_id"), F.when(k % 3 == 0, "stale").when(k % 3 == 1, "pending").otherwise("completed").alias("status"), (k % 2).alias("trigger_version"), F.when(k % 5 == 0, "9").alias("lease_expires_at"))
    return jobs, li.select(F.col("l_orderkey").alias("job_id"), F.col("l_partkey").alias("evidence_key")), p.where("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("evidence_key"))


@query(f"WITH {JOB} SELECT job_id FROM jb WHERE status NOT IN ('completed', 'stale') AND NOT coalesce(lease > '5', false) AND (v <> 1 OR job_id IN (SELECT job_id FROM rf WHERE k NOT IN (SELECT k FROM ev)))")
def invalid_candidate_jobs(spark, sf_dir):
    return V.invalid_jobs(*job_tables(spark, sf_dir), 1, "5")


@query(f"WITH {JOB} SELECT job_id FROM jb WHERE status = 'stale' AND v = 1 AND job_id IN (SELECT job_id FROM rf GROUP BY job_id HAVING count(*) = count(*) FILTER (WHERE k IN (SELECT k FROM ev)))")
def reactivatable_candidate_jobs(spark, sf_dir):
    return V.reactivatable_jobs(*job_tables(spark, sf_dir), 1)


@query(
    """WITH p AS (SELECT s_suppkey AS pid, [CAST(s_suppkey % 50 AS VARCHAR), CAST(s_suppkey % 50 + 1 AS VARCHAR), 'x'] AS m FROM supplier), e AS (SELECT 'w' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS target, [CAST(p_partkey % 50 AS VARCHAR), CAST(p_partkey % 7 AS VARCHAR)] AS m, CAST(p_partkey % 9 AS VARCHAR) AS made FROM part),
j AS (SELECT pid, target, made, CAST(round(len(list_intersect(p.m, e.m)) / least(len(list_distinct(p.m)), len(list_distinct(e.m))) * 1000000) AS BIGINT) AS s FROM p JOIN e ON len(list_intersect(p.m, e.m)) > 0)
SELECT pid AS proposal_id, target, s AS score FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY s DESC, made DESC, target) AS rn FROM j WHERE s >= 500000) WHERE rn = 1"""
)
def supersede_targets(spark, sf_dir):
    s, p = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("supplier", "part"))
    t = lambda c: c.cast("string")
    proposals = s.select(F.col("s_suppkey").alias("proposal_id"), F.array(t(F.col("s_suppkey") % 50), t(F.col("s_suppkey") % 50 + 1), F.lit("x")).alias("members"))
    existing = p.select(F.concat(F.lit("w"), F.lpad(t(F.col("p_partkey")), 6, "0")).alias("capsule_id"), F.array(t(F.col("p_partkey") % 50), t(F.col("p_partkey") % 7)).alias("members"), t(F.col("p_partkey") % 9).alias("created_at"))
    return V.supersede_target(proposals, existing)


@query(f"{CAP} SELECT capsule_id, version, status, content FROM capsules WHERE NOT (tenant = 'en' AND capsule_id = 'cap_7') UNION ALL SELECT capsule_id, version, CASE WHEN status = 'pending_confirmation' THEN 'rejected' ELSE status END, content FROM capsules WHERE tenant = 'en' AND capsule_id = 'cap_7' UNION ALL SELECT 'cap_7b', version + 1, 'active', 'edited' FROM capsules WHERE tenant = 'en' AND capsule_id = 'cap_7' AND status = 'pending_confirmation'")
def edit_and_accept(spark, sf_dir):
    return V.edit_and_accept(view(spark, sf_dir, "capsules"), "en", "cap_7", "edited", "cap_7b", NOW).select("capsule_id", "version", "status", "content")


# the sweep --------------------------------------------------------------------------------------------------------------

_OPS = ("merge", "generalize", "reweight_up", "corecall")
SWEEP_SQL = f"""{CAP}, g AS (SELECT tenant, n % 25 AS k, list(capsule_id ORDER BY capsule_id) AS members, list(capsule_id ORDER BY capsule_id) FILTER (WHERE n % 125 <> n % 25) AS kept FROM capsules GROUP BY 1, 2),
pr AS (SELECT tenant, k, CASE k % 4 WHEN 0 THEN 'merge' WHEN 1 THEN 'generalize' WHEN 2 THEN 'reweight_up' ELSE 'corecall' END AS op_kind, members, '{{"k":' || k || '}}' AS params FROM g WHERE k % 6 <> 5),
cd AS (SELECT 'cand_' || tenant || '_' || lpad(CAST(k AS VARCHAR), 2, '0') AS candidate_id, tenant, CASE k % 4 WHEN 0 THEN 'merge' WHEN 1 THEN 'generalize' WHEN 2 THEN 'reweight_up' ELSE 'corecall' END AS op_kind, CASE WHEN k % 8 = 7 THEN members ELSE coalesce(kept, []) END AS member_ids, CASE WHEN k % 3 = 0 THEN '{{"k":' || k || '}}' ELSE '{{}}' END AS params,
 k % 7 / 5.0::DOUBLE AS evidence, k % 4 AS cycles, CASE k % 5 WHEN 3 THEN 'executed' WHEN 4 THEN 'cancelled' ELSE 'pending' END AS status FROM g WHERE k % 7 <> 6),
mt AS (SELECT p.tenant, p.op_kind, p.k, p.params AS np, c.candidate_id, c.params, c.status, c.member_ids = p.members AS same, len(list_intersect(p.members, c.member_ids)) / len(list_distinct(list_concat(p.members, c.member_ids))) AS j FROM pr p JOIN cd c ON c.tenant = p.tenant AND c.op_kind = p.op_kind),
dr AS (SELECT tenant, k FROM mt WHERE round(j * 1000000) >= 800000 AND status = 'executed' AND op_kind IN ('merge', 'generalize') UNION SELECT tenant, k FROM mt WHERE op_kind = 'corecall' AND status = 'cancelled' AND same AND params = np),
bs AS (SELECT *, row_number() OVER (PARTITION BY tenant, k ORDER BY round(j * 1000000) DESC, candidate_id) AS rn FROM mt WHERE round(j * 1000000) >= 800000 AND status = 'pending' AND (tenant, k) NOT IN (SELECT (tenant, k) FROM dr)),
hr AS (SELECT candidate_id, max(np) AS np FROM bs WHERE rn = 1 AND NOT (op_kind = 'corecall' AND params = np) GROUP BY 1),
nw AS (SELECT * FROM pr WHERE (tenant, k) NOT IN (SELECT (tenant, k) FROM dr) AND (tenant, k) NOT IN (SELECT (tenant, k) FROM bs)),
st AS (SELECT c.tenant, c.op_kind, c.member_ids, CASE WHEN np IS NOT NULL AND op_kind = 'corecall' THEN np ELSE params END AS params, 0.7::DOUBLE * evidence + CASE WHEN np IS NULL THEN 0 ELSE 1 END AS evidence, CASE WHEN np IS NULL THEN 0 ELSE cycles + 1 END AS cycles, np IS NOT NULL AS heard FROM cd c LEFT JOIN hr USING (candidate_id) WHERE status = 'pending'
 UNION ALL SELECT tenant, op_kind, members, params, 1.0, 1, true FROM nw),
af AS (SELECT *, CASE WHEN heard AND cycles >= 3 AND op_kind <> 'reweight_up' THEN 'executed' WHEN NOT heard AND evidence < 0.5 THEN 'cancelled' ELSE 'pending' END AS status, heard AND cycles >= 3 AS ran FROM st)
SELECT tenant, op_kind, md5(array_to_string(member_ids, ',')) AS members, params, CAST(round(evidence * 1000000) AS BIGINT) AS evidence, CAST(cycles AS BIGINT) AS cycles, status, ran FROM af
UNION ALL SELECT tenant, op_kind, md5(array_to_string(member_ids, ',')), params, CAST(round(evidence * 1000000) AS BIGINT), CAST(cycles AS BIGINT), status, false FROM cd WHERE status <> 'pending'"""


@query(SWEEP_SQL)
def evolution_reconcile(spark, sf_dir):
    """Proposals of a sweep against candidates of earlier ones: groups of capsules, and the same groups with a fifth of their members gone."""
    c = view(spark, sf_dir, "capsules")
    k = F.col("n") % 25
    g = c.groupBy("tenant", k.alias("k")).agg(F.array_sort(F.collect_list("capsule_id")).alias("members"), F.array_sort(F.collect_list(F.when(F.col("n") % 125 != k, F.col("capsule_id")))).alias("kept"))
    k = F.col("k")
    op, params = F.element_at(F.array(*map(F.lit, _OPS)), (k % 4 + 1).cast("int")), F.concat(F.lit('{"k":'), k, F.lit("}"))
    found = g.where(k % 6 != 5).select("tenant", op.alias("op_kind"), "members", params.alias("params"))
    none = F.lit(None).cast("string")
    before = g.where(k % 7 != 6).select(
        F.concat(F.lit("cand_"), "tenant", F.lit("_"), F.lpad(k.cast("string"), 2, "0")).alias("candidate_id"), "tenant", op.alias("op_kind"), F.when(k % 8 == 7, F.col("members")).otherwise(F.col("kept")).alias("member_ids"), F.when(k % 3 == 0, params).otherwise("{}").alias("params"),
        (k % 7 / 5.0).cast("double").alias("evidence"), (k % 4).cast("bigint").alias("cycles"), F.when(k % 5 == 3, "executed").when(k % 5 == 4, "cancelled").otherwise("pending").alias("status"), F.lit("0").alias("first_proposed_at"), F.lit("0").alias("last_signal_at"), none.alias("executed_at"),
    )
    after = evolution_sweep.reconcile(found, before, evolution_sweep.Sweep(NOW))[1]
    return after.select("tenant", "op_kind", F.md5(F.array_join("member_ids", ",")).alias("members"), "params", F.round(F.col("evidence") * 1_000_000).cast("bigint").alias("evidence"), "cycles", "status", (F.col("executed_at") == NOW).alias("ran")).na.fill({"ran": False})


@query()
def evolution_sweep_of_all(spark, sf_dir):
    """All detectors over all capsules and their vectors; held against plain Python in tests."""
    c = view(spark, sf_dir, "capsules")
    v = view(spark, sf_dir, "vectors").select("capsule_id", F.lit(0).alias("chunk"), "embedding")
    none = spark.createDataFrame([], evolution_sweep.CANDIDATES)
    _, _, candidates = evolution_sweep.sweep(c, v, edges(spark, sf_dir), view(spark, sf_dir, "feedback"), none, evolution_sweep.Sweep(NOW, cluster_at=0.3, merge_at=0.4))
    return candidates.select("candidate_id", "tenant", "op_kind", F.array_join("member_ids", ",").alias("members"), F.round(F.col("evidence") * 1_000_000).cast("bigint").alias("evidence"), "cycles", "status")
