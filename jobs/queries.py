"""The jobs as registered queries: each runs its job twice into a new folder and returns the output as it stands after the second run. And their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import archive_transcripts, sweep_lifecycle
from tessera.fixtures import prelude
from tessera.functions.text import CONTINUATIONS
from tessera.operators.storage import ensure_importable, shared_dir
from tessera.queries.dialect import fingerprint, trim
from tessera.queries.text import redact_sql

NOW = "00000001704900000000"


def new_folder(spark: SparkSession, name: str) -> str:
    ensure_importable(spark)
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def job1_archive_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = new_folder(spark, "job1")
    for _ in range(2):  # a pattern: it matches a table that is one file as well as one that is a folder
        archive_transcripts.run(spark, f"{sf_dir}/conversations.parque[t]", f"{at}/tables", f"{at}/checkpoint", parts=8)
    out = archive_transcripts.read_back(spark, f"{at}/tables")
    return out.withColumn("content", F.md5("content")).withColumn("tokens", F.array_join("tokens", "|"))


def job2_sweep_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = new_folder(spark, "job2")
    for _ in range(2):
        sweep_lifecycle.run(spark, sf_dir, at, NOW)
    whole = lambda c: F.round(F.col(c) * 1_000_000).cast("bigint")
    return sweep_lifecycle.read_back(spark, at, NOW).withColumns({c: whole(c) for c in ("confidence", "decay_score")})


_P = trim("content")
JOB1_SQL = f"""WITH c AS (SELECT *, coalesce(text, '') AS said, row_number() OVER (PARTITION BY conv_id, turn ORDER BY role NULLS FIRST, text NULLS FIRST) AS nth FROM conversations),
b AS (SELECT conv_id || ':' || turn AS block_id, 'conv_' || conv_id AS session_id, turn AS line_number, role, said, {redact_sql('said')} AS content FROM c WHERE nth = 1),
u AS (SELECT block_id, i, r[i] AS x FROM (SELECT block_id, r, unnest(generate_series(1, len(r))) AS i FROM (SELECT block_id, {fingerprint('content')} AS r FROM b))), f AS (SELECT block_id, x, min(i) AS i FROM u GROUP BY 1, 2),
k AS (SELECT block_id, array_to_string(list(x ORDER BY i)[1:64], '|') AS tokens FROM f GROUP BY block_id),
e AS (SELECT b.*, sha256(content) AS content_hash, length(content) AS n_chars, said <> content AS redacted, coalesce(tokens, '') AS tokens,
 coalesce(role = 'user', false) AND NOT ({_P} = '' OR starts_with({_P}, '/') OR starts_with({_P}, '!') OR length({_P}) < 4 OR lower({_P}) IN ({", ".join(f"'{x}'" for x in CONTINUATIONS)})) AS recall FROM b LEFT JOIN k USING (block_id)),
s AS (SELECT session_id, count(*) AS session_blocks, CAST(sum(n_chars) AS BIGINT) AS session_chars, count(*) FILTER (WHERE recall) AS session_prompts, count(*) FILTER (WHERE redacted) AS session_redacted, min(line_number) AS first_line, max(line_number) AS last_line FROM e GROUP BY 1)
SELECT block_id, session_id, line_number, role, md5(content) AS content, content_hash, n_chars, redacted, tokens, recall, session_blocks, session_chars, session_prompts, session_redacted, first_line, last_line FROM e LEFT JOIN s USING (session_id)"""

_BODY = "trim(content, ' ' || chr(9) || chr(10) || chr(13))"
JOB2_SQL = f"""{prelude('capsules', 'feedback')},
p AS (SELECT capsule_id, sum(CASE kind WHEN 'useful' THEN 0.1 WHEN 'applies_here' THEN 0.05 ELSE 0 END) AS dc, sum(CASE kind WHEN 'outdated' THEN 0.2 WHEN 'does_not_apply_here' THEN 0.1 ELSE 0 END) AS dd,
 max(CASE WHEN kind = 'incorrect' THEN 'archived' END) AS st, max(CASE WHEN kind IN ('useful', 'applies_here') THEN created_at END) AS validated_at FROM feedback GROUP BY capsule_id),
f AS (SELECT c.*, coalesce(tenant, '') AS t, coalesce(st, status) AS s1, least(1.0, confidence + coalesce(dc, 0)) AS conf, least(1.0, decay_score + coalesce(dd, 0)) AS d1, validated_at FROM capsules c LEFT JOIN p USING (capsule_id)),
d AS (SELECT *, CASE WHEN coalesce(expires_at <= '{NOW}', false) THEN 'archived' ELSE s1 END AS s2, least(1.0, d1 + 0.01 * greatest(0.0, ({int(NOW)} - CAST(coalesce(last_used_at, updated_at) AS BIGINT)) / 86400000.0)) AS d2 FROM f),
a AS (SELECT *, CASE WHEN s2 IS DISTINCT FROM s1 THEN 'expired' WHEN s1 IS DISTINCT FROM status THEN 'by_feedback'
 WHEN s2 = 'pending_confirmation' AND updated_at < '{int(NOW) - 7 * 86_400_000:020d}' AND d2 < 0.45 AND capsule_type IN ('experience', 'episode') THEN 'promoted'
 WHEN s2 = 'active' AND last_recalled_at IS NULL AND created_at <= '{int(NOW) - 9 * 86_400_000:020d}' AND conf <= 0.5 + 1e-6 AND d2 >= 0.25 AND capsule_type = 'experience'
  AND (length({_BODY}) < 400 OR (len(code_refs) = 0 AND NOT contains({_BODY}, chr(10)) AND length({_BODY}) < 1200)) THEN 'archived_idle' END AS action FROM d),
r AS (SELECT capsule_id, capsule_type, status AS status_before, CASE action WHEN 'promoted' THEN 'active' WHEN 'archived_idle' THEN 'archived' ELSE s2 END AS status, CAST(round(conf * 1000000) AS BIGINT) AS confidence, CAST(round(d2 * 1000000) AS BIGINT) AS decay_score,
 '{NOW}' AS last_used_at, validated_at, action, t AS tenant FROM a)
SELECT r.*, (SELECT count(*) FROM r x WHERE x.tenant = r.tenant AND x.status_before = r.status) AS before, count(*) OVER (PARTITION BY tenant, status) AS after FROM r"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"job1_archive_transcripts": job1_archive_transcripts, "job2_sweep_lifecycle": job2_sweep_lifecycle}
SQL = {"job1_archive_transcripts": JOB1_SQL, "job2_sweep_lifecycle": JOB2_SQL}
