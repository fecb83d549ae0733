"""Transcript queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.fixtures import prelude, view
from tessera.operators import retrieval as R
from tessera.operators import transcripts as X
from tessera.queries import query
from tessera.queries.dialect import words

MSG = prelude("messages")


def msgs(spark, sf_dir):
    return view(spark, sf_dir, "messages")


@query(f"{MSG} SELECT tenant, session_id, count(*) AS blocks, min(created_at) AS first_at, max(created_at) AS last_at, max(caller_agent) AS caller_agent FROM messages WHERE session_id IS NOT NULL GROUP BY tenant, session_id")
def session_rollup(spark, sf_dir):
    return X.session_rollup(msgs(spark, sf_dir))


CUR = ("00000001704070600000", 1, 0)


@query(
    f"""{MSG}, p AS (SELECT block_id, created_at, row_number() OVER (ORDER BY created_at, line_number, block_index, block_id) AS pos, count(*) OVER () AS n FROM messages
WHERE tenant = 't1' AND session_id IS NOT NULL AND created_at >= '00000001704067200000' AND created_at < '00000001704090000000' AND (created_at, line_number, block_index) > ('{CUR[0]}', 1, 0))
SELECT block_id, created_at, CAST(pos AS INTEGER) AS pos, n > 25 AS has_more FROM p WHERE pos <= 25"""
)
def range_page(spark, sf_dir):
    return X.page(msgs(spark, sf_dir), "t1", CUR, 25, since="00000001704067200000", until="00000001704090000000").select("block_id", "created_at", "pos", "has_more")


@query(f"{MSG}, p AS (SELECT block_id, row_number() OVER (ORDER BY created_at, line_number, block_index, block_id) AS pos, count(*) OVER () AS n FROM messages WHERE tenant = 't1' AND session_id = 'conv_4' AND role = 'user') SELECT block_id, CAST(pos AS INTEGER) AS pos, n > 3 AS has_more FROM p WHERE pos <= 3")
def session_page(spark, sf_dir):
    return X.page(msgs(spark, sf_dir), "t1", None, 3, session_id="conv_4", role="user").select("block_id", "pos", "has_more")


@query(f"{MSG} SELECT block_id, created_at FROM messages WHERE tenant = 't1' AND embed_eligible ORDER BY created_at DESC, line_number DESC, block_index DESC, block_id DESC LIMIT 30")
def newest_blocks(spark, sf_dir):
    return X.newest(msgs(spark, sf_dir), "t1", 30).select("block_id", "created_at")


@query(f"{MSG} SELECT block_id FROM messages WHERE tenant = 't1' AND session_id = 'conv_4' AND embed_eligible ORDER BY created_at DESC, line_number DESC LIMIT 2")
def anchor_blocks(spark, sf_dir):
    return X.newest(msgs(spark, sf_dir), "t1", 2, session_id="conv_4").select("block_id")


@query(f"{MSG}, w AS (SELECT unnest(['mb_4_2', 'mb_1_0', 'mb_2_1', 'zz']) AS block_id, unnest([0, 1, 2, 3]) AS pos) SELECT block_id, pos, role FROM messages JOIN w USING (block_id) WHERE tenant = 't1'")
def blocks_by_ids(spark, sf_dir):
    return X.by_ids_in_order(msgs(spark, sf_dir), "t1", ["mb_4_2", "mb_1_0", "mb_2_1", "zz"]).select("block_id", "pos", "role")


HITS = "hits AS (SELECT block_id, CAST(line_number * 10 AS BIGINT) AS score FROM messages WHERE line_number IN (0, 4) AND session_id IS NOT NULL)"
AROUND = f"""{MSG}, {HITS}, a AS (SELECT block_id, session_id, created_at, list(block_id) OVER w1 AS before, list(block_id) OVER w2 AS after, min(created_at) OVER w3 AS first_at, max(created_at) OVER w4 AS last_at
FROM messages WHERE session_id IS NOT NULL WINDOW w1 AS (PARTITION BY tenant, session_id ORDER BY created_at, line_number, block_index, block_id ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING),
w2 AS (PARTITION BY tenant, session_id ORDER BY created_at, line_number, block_index, block_id ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING),
w3 AS (PARTITION BY tenant, session_id ORDER BY created_at, line_number, block_index, block_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW),
w4 AS (PARTITION BY tenant, session_id ORDER BY created_at, line_number, block_index, block_id ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)), cw AS (SELECT a.*, score FROM a JOIN hits USING (block_id))"""


def windows(spark, sf_dir):
    m = msgs(spark, sf_dir)
    hits = m.where("line_number in (0, 4) and session_id is not null").select("block_id", (F.col("line_number") * 10).alias("score"))
    return X.context_windows(m, hits, 2, 2)


@query(f"{AROUND} SELECT block_id, coalesce(array_to_string(before, ','), '') AS before, coalesce(array_to_string(after, ','), '') AS after FROM cw")
def context_windows(spark, sf_dir):
    return windows(spark, sf_dir).select("block_id", F.array_join("before", ",").alias("before"), F.array_join("after", ",").alias("after"))


@query(
    f"""{AROUND}, o AS (SELECT *, max(last_at) OVER (PARTITION BY session_id ORDER BY created_at, block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM cw),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR first_at > reach THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY created_at, block_id) AS island FROM o)
SELECT 's:' || session_id AS key, CAST(island AS BIGINT) AS island, min(first_at) AS first_at, max(last_at) AS last_at, count(*) AS hits, max(score) AS score FROM i GROUP BY session_id, island"""
)
def merged_windows(spark, sf_dir):
    return X.merge_windows(windows(spark, sf_dir))


@query(
    f"""{MSG}, lx AS (SELECT block_id, CAST(1 + line_number AS INTEGER) AS rank FROM messages WHERE line_number < 3), sx AS (SELECT block_id, CAST(10 - line_number AS INTEGER) AS rank FROM messages WHERE line_number > 0),
c AS (SELECT * FROM messages WHERE tenant = 't1' AND embed_eligible), g AS (SELECT session_id, count(*) AS k FROM c WHERE session_id IS NOT NULL GROUP BY session_id)
SELECT block_id, CAST(coalesce(round(1000.0 / (60 + lx.rank)), 0) + coalesce(round(1000.0 / (60 + sx.rank)), 0) + 3 * least(4, coalesce(k, 1) - 1) + CASE WHEN session_id = 'conv_4' THEN 20 ELSE 0 END
+ 6 - least(20, floor(((SELECT max(CAST(created_at AS BIGINT)) FROM c) - CAST(created_at AS BIGINT)) / 10000.0)) AS BIGINT) AS score
FROM c LEFT JOIN lx USING (block_id) LEFT JOIN sx USING (block_id) LEFT JOIN g USING (session_id)"""
)
def transcript_score(spark, sf_dir):
    m = msgs(spark, sf_dir)
    lexical = m.where("line_number < 3").select("block_id", (1 + F.col("line_number")).cast("int").alias("rank"))
    semantic = m.where("line_number > 0").select("block_id", (10 - F.col("line_number")).cast("int").alias("rank"))
    return X.score_hits(m.where("tenant = 't1' and embed_eligible"), lexical, semantic, "conv_4").select("block_id", "score")


@query(
    f"""{MSG}, l AS (SELECT *, lag(message_uuid) OVER w AS pu, lag(line_number) OVER w AS pl FROM messages WINDOW w AS (PARTITION BY transcript_path ORDER BY line_number, block_index)),
m AS (SELECT *, CASE WHEN pl IS NULL THEN 1 WHEN message_uuid IS NULL AND pu IS NULL THEN CASE WHEN pl = line_number THEN 0 ELSE 1 END WHEN coalesce(message_uuid = pu, false) THEN 0 ELSE 1 END AS f FROM l)
SELECT block_id, CAST(sum(f) OVER (PARTITION BY transcript_path ORDER BY line_number, block_index) AS BIGINT) AS group_no FROM m"""
)
def message_groups(spark, sf_dir):
    return X.message_groups(msgs(spark, sf_dir)).select("block_id", "group_no")


@query(
    """WITH e AS (SELECT event_id, user_id, epoch_ms(ts) AS at_ms FROM events), g AS (SELECT *, floor((at_ms - lag(at_ms) OVER (PARTITION BY user_id ORDER BY at_ms, event_id)) / 60000.0) AS gap FROM e)
SELECT event_id, user_id, CAST(sum(CASE WHEN gap IS NULL OR gap >= 30 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY at_ms, event_id) AS BIGINT) AS session_no FROM g"""
)
def inactivity_sessions(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"))
    return X.sessions_by_inactivity(e, ["user_id"]).select("event_id", "user_id", "session_no")


@query(
    f"""{MSG}, p AS (SELECT * FROM messages WHERE tenant = 't1' AND embed_eligible AND session_id IS NOT NULL ORDER BY created_at DESC, line_number DESC, block_index DESC, block_id DESC LIMIT 60),
s AS (SELECT session_id, max(created_at) AS last_at FROM p GROUP BY session_id ORDER BY last_at DESC, session_id LIMIT 5),
r AS (SELECT p.*, last_at, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, line_number DESC, block_index DESC) AS pos FROM p JOIN s USING (session_id))
SELECT session_id, block_id, CAST(pos AS INTEGER) AS pos FROM r WHERE pos <= 3"""
)
def recent_highlights(spark, sf_dir):
    return X.recent_highlights(msgs(spark, sf_dir), "t1", 5, 3).select("session_id", "block_id", "pos")


@query(
    f"""{MSG}, tk AS (SELECT block_id AS capsule_id, tenant, {words('content')} AS tok FROM messages WHERE embed_eligible),
st AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len(tok)) AS a, CAST(count(*) FILTER (WHERE list_contains(tok, 'the')) AS DOUBLE) AS d FROM tk),
sc AS (SELECT capsule_id, CAST(len(list_filter(tok, lambda x: x = 'the')) AS DOUBLE) AS tf, len(tok) AS l FROM tk WHERE tenant = 't1'),
rs AS (SELECT capsule_id AS block_id, CAST(round(ln(1 + (n - d + 0.5) / (d + 0.5)) * tf * 2.2 / (tf + (1.2 * (1 - 0.75 + 0.75 * l / a))) * 1000000) AS BIGINT) AS score FROM sc, st)
SELECT block_id, score, CAST(row_number() OVER (ORDER BY score DESC, block_id) AS INTEGER) AS rank FROM rs WHERE score > 0 ORDER BY score DESC, block_id LIMIT 40"""
)
def transcript_lexical_rank(spark, sf_dir):
    return R.bm25(msgs(spark, sf_dir).where("embed_eligible"), F.col("content"), "block_id", "the", 40, F.col("tenant") == "t1")


@query(
    f"""{MSG}, tk AS (SELECT *, {words('content')} AS tok FROM messages WHERE embed_eligible),
st AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len(tok)) AS a, CAST(count(*) FILTER (WHERE list_contains(tok, 'the')) AS DOUBLE) AS d FROM tk),
sc AS (SELECT block_id, CAST(round(ln(1 + (n - d + 0.5) / (d + 0.5)) * CAST(len(list_filter(tok, lambda x: x = 'the')) AS DOUBLE) * 2.2 / (CAST(len(list_filter(tok, lambda x: x = 'the')) AS DOUBLE) + (1.2 * (1 - 0.75 + 0.75 * len(tok) / a))) * 1000000) AS BIGINT) AS score FROM tk, st WHERE tenant = 't1'),
lx AS (SELECT block_id, row_number() OVER (ORDER BY score DESC, block_id) AS rank FROM sc WHERE score > 0 ORDER BY score DESC, block_id LIMIT 160),
an AS (SELECT block_id FROM messages WHERE tenant = 't1' AND embed_eligible AND session_id = 'conv_4' ORDER BY created_at DESC, line_number DESC, block_index DESC, block_id DESC LIMIT 160),
c AS (SELECT * FROM messages WHERE tenant = 't1' AND embed_eligible AND block_id IN (SELECT block_id FROM lx UNION SELECT block_id FROM an)), g AS (SELECT session_id, count(*) AS k FROM c WHERE session_id IS NOT NULL GROUP BY session_id),
s AS (SELECT c.block_id, session_id, role, CAST(coalesce(round(1000.0 / (60 + lx.rank)), 0) + 3 * least(4, coalesce(k, 1) - 1) + CASE WHEN session_id = 'conv_4' THEN 20 ELSE 0 END + 6 - least(20, floor(((SELECT max(CAST(created_at AS BIGINT)) FROM c) - CAST(created_at AS BIGINT)) / 10000.0)) AS BIGINT) AS score FROM c LEFT JOIN lx USING (block_id) LEFT JOIN g USING (session_id))
SELECT block_id, session_id, score FROM s WHERE role = 'user' ORDER BY score DESC, block_id LIMIT 10"""
)
def transcript_search(spark, sf_dir):
    from tessera.plans import transcript_search as P

    m = msgs(spark, sf_dir)
    return P.search(m, None, P.TranscriptSearch("t1", "the", limit=10, role="user", anchor_session="conv_4")).select("block_id", "session_id", "score")
