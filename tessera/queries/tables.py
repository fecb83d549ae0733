"""Named reads and writes of a store's smaller tables, and rules of short texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.fixtures import prelude, view
from tessera.functions import hashing, text
from tessera.operators import tables as T
from tessera.queries import query
from tessera.queries.dialect import SPACE, trim
from tessera.sources import jsonl

CHUNKS = "vc AS (SELECT 'cap_' || (vec_id // 3) AS capsule_id, CAST(vec_id % 3 AS INTEGER) AS chunk, embedding FROM embeddings)"


def chunked(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(F.concat(F.lit("cap_"), F.floor(F.col("vec_id") / 3).cast("string")).alias("capsule_id"), (F.col("vec_id") % 3).cast("int").alias("chunk"), F.col("embedding"))


@query(f"WITH {CHUNKS} SELECT capsule_id, chunk, CAST(round(embedding[1] * 1000000) AS BIGINT) AS first FROM vc WHERE capsule_id = 'cap_5'")
def vector_chunks(spark, sf_dir):
    return T.vectors_of(chunked(spark, sf_dir), "capsule_id", "cap_5").select("capsule_id", "chunk", F.round(F.col("embedding")[0].cast("double") * 1_000_000).cast("bigint").alias("first"))


@query(f"WITH {CHUNKS} SELECT len(embedding) AS dim, CAST(round(embedding[1] * 1000000) AS BIGINT) AS first FROM vc WHERE capsule_id = 'cap_7' AND chunk = 0")
def vector_read(spark, sf_dir):
    return T.first_vector(chunked(spark, sf_dir), "capsule_id", "cap_7").select(F.size("embedding").cast("bigint").alias("dim"), F.round(F.col("embedding")[0].cast("double") * 1_000_000).cast("bigint").alias("first"))


@query(f"WITH {CHUNKS}, n AS (SELECT capsule_id, CAST(substr(capsule_id, 5) AS BIGINT) % 4 AS m, chunk FROM vc) SELECT capsule_id, CASE WHEN m = 1 THEN 1 ELSE count(*) END AS chunks FROM n WHERE m <> 2 GROUP BY capsule_id, m")
def vectors_replaced_and_deleted(spark, sf_dir):
    """A quarter of the ids gets one chunk in place of its old ones, another quarter goes."""
    v, m = chunked(spark, sf_dir), F.substring("capsule_id", 5, 20).cast("bigint") % 4
    out = T.delete_vectors(T.replace_vectors(v, v.where((m == 1) & (F.col("chunk") == 0)), "capsule_id"), v.where(m == 2).select("capsule_id").distinct(), "capsule_id")
    return out.groupBy("capsule_id").agg(F.count("*").alias("chunks"))


@query("SELECT 'u' || user_id AS consumer, max(event_id) AS position FROM events GROUP BY user_id")
def cursor_moves(spark, sf_dir):
    """Cursors at even events, moved by all, many of which lie behind."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("consumer"), F.col("event_id").alias("position"))
    return T.move_cursors(T.move_cursors(spark.createDataFrame([], e.schema), e.where("position % 2 = 0")), e)


@query("SELECT max(event_id) AS position FROM events WHERE user_id = 3")
def cursor_read(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("consumer"), F.col("event_id").alias("position"))
    return T.cursor(T.move_cursors(spark.createDataFrame([], e.schema), e), "u3")


CANDIDATES = "cn AS (SELECT 'c' || (o_custkey % 300) AS candidate_id, 't' || (o_custkey % 2) AS tenant, o_orderstatus AS status, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS updated_at FROM orders)"


def candidates(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    at = F.lpad(k.cast("string"), 12, "0")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.concat(F.lit("c"), (c % 300).cast("string")).alias("candidate_id"), F.concat(F.lit("t"), (c % 2).cast("string")).alias("tenant"), F.col("o_orderstatus").alias("status"), at.alias("created_at"), at.alias("updated_at"))


@query(f"WITH {CANDIDATES} SELECT candidate_id, max_by(status, updated_at) AS status, max(updated_at) AS updated_at FROM cn GROUP BY 1")
def candidate_upserts(spark, sf_dir):
    c = candidates(spark, sf_dir)
    first = T.upsert_candidates(spark.createDataFrame([], c.schema), c.where("updated_at % 2 = 0"))
    return T.upsert_candidates(first, c).select("candidate_id", "status", "updated_at")


@query(f"WITH {CANDIDATES} SELECT candidate_id, updated_at FROM cn WHERE tenant = 't1' AND status = 'O'")
def candidate_list(spark, sf_dir):
    return T.candidates_of(candidates(spark, sf_dir), "t1", "O").select("candidate_id", "updated_at")


@query(f"{prelude('capsules')} SELECT capsule_id AS episode_id FROM capsules WHERE tenant = 'en' AND n % 4 <> 0")
def successful_episodes(spark, sf_dir):
    c = view(spark, sf_dir, "capsules").select(F.col("capsule_id").alias("episode_id"), "tenant", F.when(F.col("n") % 4 == 0, "failed").otherwise(" Success ").alias("outcome"))
    return T.successful_episodes(c, "en").select("episode_id")


@query(f"{prelude('feedback')} SELECT feedback_id, kind FROM feedback WHERE capsule_id = 'cap_9'")
def feedback_log(spark, sf_dir):
    return T.feedback_of(view(spark, sf_dir, "feedback"), "cap_9").select("feedback_id", "kind")


@query(f"{prelude('messages')} SELECT block_id FROM messages WHERE tenant = 't1' AND role = 'user' AND block_type = 'text'")
def filtered_blocks(spark, sf_dir):
    return T.blocks_where(view(spark, sf_dir, "messages"), "t1", role="user", block_type="text").select("block_id")


@query(f"{prelude('messages')} SELECT block_id FROM messages WHERE tenant = 't1' ORDER BY created_at, line_number, block_index, block_id LIMIT 25")
def capped_scan(spark, sf_dir):
    return T.blocks_where(view(spark, sf_dir, "messages"), "t1", limit=25).select("block_id")


@query(f"{prelude('jobs')} SELECT status FROM jobs WHERE job_id = (SELECT min(job_id) FROM jobs)")
def job_status_read(spark, sf_dir):
    jobs = view(spark, sf_dir, "jobs")
    return T.job_status(jobs, jobs.agg(F.min("job_id")).first()[0])


PINS = "pn AS (SELECT 's' || s_suppkey AS skill_id, 'v' || s_suppkey AS version_id, CASE WHEN s_suppkey % 2 = 0 THEN '9' ELSE '1' END AS expires_at FROM supplier)"


@query(f"WITH {PINS} SELECT 'pin' AS what, version_id FROM pn WHERE skill_id = 's4' AND expires_at > '5' UNION ALL SELECT 'head', version_id FROM pn WHERE skill_id = 's3' UNION ALL SELECT 'bundle', version_id FROM pn WHERE skill_id = 's5' UNION ALL SELECT 'by job', version_id FROM pn WHERE skill_id = 's6' UNION ALL SELECT 'by id', version_id FROM pn WHERE skill_id = 's7'")
def skill_reads(spark, sf_dir):
    k = F.col("s_suppkey")
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        F.lit("t").alias("tenant"), F.lit("x").alias("session_id"), F.lit("a").alias("agent_id"), F.concat(F.lit("s"), k.cast("string")).alias("skill_id"), F.concat(F.lit("v"), k.cast("string")).alias("version_id"), F.when(k % 2 == 0, "9").otherwise("1").alias("expires_at"),
        F.concat(F.lit("c"), k.cast("string")).alias("capsule_id"), F.concat(F.lit("p"), k.cast("string")).alias("proposal_id"), k.alias("job_id"),
    )
    found = {"pin": T.pin_of(s, "t", "x", "a", "s4", "5"), "head": T.head(s, "t", "s3"), "bundle": T.bundle_of(s, "t", "c5"), "by job": T.proposal(s, "t", job_id=6), "by id": T.proposal(s, "t", "p7")}
    parts = [df.select(F.lit(what).alias("what"), "version_id") for what, df in found.items()]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3]).unionAll(parts[4])


# short texts ---------------------------------------------------------------------------------------------------------------

_LINES = "string_split(text, chr(10))"


@query(
    f"""SELECT doc_id, md5(array_to_string(list_filter(list_transform({_LINES}, lambda x: {trim(f"regexp_replace({trim('x')}, '^[0-9]+[.)]\\s*', '')")}), lambda x: x <> ''), '|')) AS numbered,
md5(array_to_string(list_filter(list_transform(string_split_regex(text, '[\\n;•]'), lambda x: {trim(f"regexp_replace({trim('x')}, '^-+', '')")}), lambda x: x <> ''), '|')) AS split, substring({trim(f"regexp_replace(text, '{SPACE}+', ' ', 'g')")}, 1, 50) AS cut FROM documents"""
)
def step_texts(spark, sf_dir):
    d, t = spark.read.parquet(f"{sf_dir}/documents.parquet"), F.col("text")
    return d.select("doc_id", F.md5(F.array_join(text.steps(t), "|")).alias("numbered"), F.md5(F.array_join(text.split_steps(t), "|")).alias("split"), text.clean_to(t, 50).alias("cut"))


@query(
    f"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'x <mem-save>' || chr(9) || substring(text, 1, 30) || ' </mem-save> <mem-save>second one here</mem-save>' WHEN doc_id % 3 = 1 THEN '<mem-save> ab </mem-save>' ELSE text END AS t FROM documents), f AS (SELECT doc_id, {trim("regexp_extract(t, '<mem-save>([\\s\\S]*?)</mem-save>', 1)")} AS f FROM t)
SELECT doc_id, CASE WHEN length(f) >= 12 AND length(regexp_replace(f, '[^\\p{{L}}\\p{{N}}]', '', 'g')) >= 4 THEN f END AS memory FROM f"""
)
def memory_tags(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    t = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("x <mem-save>\t"), F.substring("text", 1, 30), F.lit(" </mem-save> <mem-save>second one here</mem-save>"))).when(F.col("doc_id") % 3 == 1, "<mem-save> ab </mem-save>").otherwise(F.col("text"))
    return d.select("doc_id", text.memory_tag(t).alias("memory"))


@query("SELECT vec_id, CAST(round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), list_transform(generate_series(0, 63), lambda i: round(sin(i), 6))) * 1000000) AS BIGINT) AS cosine FROM embeddings")
def cosine_similarity(spark, sf_dir):
    from tessera.operators.retrieval import cosine
    from tessera.queries.search import VECTOR

    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select("vec_id", F.round(cosine(F.col("embedding"), F.array(*map(F.lit, VECTOR))) * 1_000_000).cast("bigint").alias("cosine"))


@query()
def task_texts(spark, sf_dir):
    """Compatibility normal form is no function of SQL; the rule has unit tests."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.md5(hashing.task_text(F.col("text"))).alias("task"))


@query("SELECT '/c/' || conv_id AS transcript_path, turn + 2 AS line_number, 'ses' || conv_id AS session_id, CASE WHEN turn % 3 = 2 THEN 'user' ELSE role END AS role, CASE turn % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'thinking' ELSE 'tool_result' END AS block_type, text AS content FROM conversations")
def transcript_parse_c(spark, sf_dir):
    c, k = spark.read.parquet(f"{sf_dir}/conversations.parquet"), F.col("turn") % 3
    s = lambda x, n: F.lit(x).alias(n)
    said = F.coalesce("text", F.lit(""))
    part = F.when(k == 1, F.to_json(F.array(F.struct(s("thinking", "type"), said.alias("thinking"))))).otherwise(F.to_json(F.array(F.struct(s("text", "type"), said.alias("text")))))
    role = F.when(k == 2, "toolResult").otherwise(F.col("role"))
    line = F.concat(F.lit('{"type":"message","id":"m","message":{"role":"'), role, F.lit('","toolCallId":"c","content":'), part, F.lit("}}"))
    path = F.concat(F.lit("/c/"), F.col("conv_id").cast("string")).alias("path")
    head = c.select("conv_id").distinct().select(path, F.lit(1).alias("line_number"), F.concat(F.lit('{"type":"session","version":1,"id":"ses'), F.col("conv_id").cast("string"), F.lit('"}')).alias("line"))
    out = jsonl.parse(head.unionAll(c.select(path, (F.col("turn") + 2).cast("int"), line)))
    return out.select("transcript_path", "line_number", "session_id", "role", "block_type", "content")
