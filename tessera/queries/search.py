"""Retrieval: lexical, vector and hybrid ranks, and capsule search over them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.fixtures import prelude, view
from tessera.functions.text import WHITE, redact
from tessera.operators import retrieval as R
from tessera.plans import capsule_search as S
from tessera.plans import packing
from tessera.queries import query
from tessera.queries.dialect import SPACE, trim, words
from tessera.queries.text import redact_sql
from tessera.schemas import CAPSULE_TYPES

QUERY = "the thing of erin für than in heer"
TERMS = R.query_terms(QUERY)
SCORED = R.score_terms(QUERY)
#: A fixed query vector, by rule: component i is sin(i).
VECTOR = [round(__import__("math").sin(i), 6) for i in range(64)]
NOW = "00000001704070000000"
TENANT = "en"
LIVE = "status NOT IN ('archived', 'rejected') AND capsule_type <> 'diary'"


def vector_sql() -> str:
    return "[" + ", ".join(f"CAST({x!r} AS DOUBLE)" for x in VECTOR) + "]"


def bm25_sql(k: int, tenant: bool = True) -> str:
    """CTEs up to `lex` (capsule_id, score, rank)."""
    count = lambda q: f"CAST(len(list_filter(tok, lambda x: x = '{q}')) AS DOUBLE)"
    df = ", ".join(f"CAST(count(*) FILTER (WHERE list_contains(tok, '{q}')) AS DOUBLE) AS df{i}" for i, q in enumerate(TERMS))
    norm = f"({R.K1} * (1 - {R.B} + {R.B} * len(tok) / avg_len))"
    score = " + ".join(f"ln(1 + (n_all - df{i} + 0.5) / (df{i} + 0.5)) * {count(q)} * {R.K1 + 1} / ({count(q)} + {norm})" for i, q in enumerate(TERMS))
    return f"""tk AS (SELECT capsule_id, tenant, {words("concat_ws(' ', summary, content)")} AS tok FROM capsules WHERE {LIVE}),
st AS (SELECT CAST(count(*) AS DOUBLE) AS n_all, avg(len(tok)) AS avg_len, {df} FROM tk),
sc AS (SELECT capsule_id, CAST(round(({score}) * 1000000) AS BIGINT) AS score FROM tk, st {"WHERE tenant = '" + TENANT + "'" if tenant else ""}),
lex AS (SELECT capsule_id, score, row_number() OVER (ORDER BY score DESC, capsule_id) AS rank FROM sc WHERE score > 0 ORDER BY score DESC, capsule_id LIMIT {k})"""


def near_sql(k: int) -> str:
    return f"""sm AS (SELECT capsule_id, CAST(round(list_distance(CAST(embedding AS DOUBLE[]), {vector_sql()}) * 1000000) AS BIGINT) AS distance FROM vectors),
nr AS (SELECT capsule_id, distance, row_number() OVER (ORDER BY distance, capsule_id) AS rank FROM sm ORDER BY distance, capsule_id LIMIT {k})"""


def hybrid_sql(k: int) -> str:
    return f"""{prelude('capsules', 'vectors')}, {bm25_sql(2 * k)}, {near_sql(2 * k)},
nt AS (SELECT capsule_id, row_number() OVER (ORDER BY distance, capsule_id) AS rank FROM nr WHERE capsule_id IN (SELECT capsule_id FROM capsules WHERE tenant = '{TENANT}')),
fu AS (SELECT capsule_id, coalesce(1.0 / (60 + lex.rank), 0) + coalesce(1.0 / (60 + nt.rank), 0) AS rrf FROM lex FULL OUTER JOIN nt USING (capsule_id)),
hy AS (SELECT c.*, fu.rrf, CAST(round(fu.rrf * 1000000) AS BIGINT) AS rrf_score FROM fu JOIN capsules c USING (capsule_id) WHERE tenant = '{TENANT}' AND {LIVE}),
hits AS (SELECT *, row_number() OVER (ORDER BY rrf_score DESC, updated_at DESC, capsule_id) AS rank FROM hy ORDER BY rrf_score DESC, updated_at DESC, capsule_id LIMIT {k})"""


@query(f"{prelude('capsules')}, {bm25_sql(50, tenant=False)} SELECT capsule_id, score, CAST(rank AS INTEGER) AS rank FROM lex")
def lexical_rank(spark, sf_dir):
    corpus = view(spark, sf_dir, "capsules").where(LIVE)
    return R.bm25(corpus, F.concat_ws(" ", "summary", "content"), "capsule_id", QUERY, 50)


#: Texts of scripts with and without spaces, with accents, in both cases.
MANY = ("修复了报错，改用缓存", "缓存失效导致报错", "Straße café Über", "strasse cafe uber", "Kubernetes 报错 café", "日本語のテキスト検索", "한국어 검색 엔진", "café CAFÉ Café", "étude de cas", "")
MANY_SQL = " UNION ALL ".join(f"SELECT 'x{i}' AS capsule_id, '{x}' AS content" for i, x in enumerate(MANY))
MANY_QUERY = "报错 café Straße テキスト 검색"


def many_sql() -> str:
    terms = R.query_terms(MANY_QUERY)
    count = lambda q: f"CAST(len(list_filter(tok, lambda x: x = '{q}')) AS DOUBLE)"
    df = ", ".join(f"CAST(count(*) FILTER (WHERE list_contains(tok, '{q}')) AS DOUBLE) AS df{i}" for i, q in enumerate(terms))
    norm = f"({R.K1} * (1 - {R.B} + {R.B} * len(tok) / avg_len))"
    score = " + ".join(f"ln(1 + (n_all - df{i} + 0.5) / (df{i} + 0.5)) * {count(q)} * {R.K1 + 1} / ({count(q)} + {norm})" for i, q in enumerate(terms))
    return f"""WITH c AS (SELECT CAST(doc_id AS VARCHAR) AS capsule_id, text AS content FROM documents UNION ALL {MANY_SQL}), tk AS (SELECT capsule_id, {words("content")} AS tok FROM c),
st AS (SELECT CAST(count(*) AS DOUBLE) AS n_all, avg(len(tok)) AS avg_len, {df} FROM tk), sc AS (SELECT capsule_id, CAST(round(({score}) * 1000000) AS BIGINT) AS score FROM tk, st)
SELECT capsule_id, score, CAST(row_number() OVER (ORDER BY score DESC, capsule_id) AS INTEGER) AS rank FROM sc WHERE score > 0 ORDER BY score DESC, capsule_id LIMIT 50"""


@query(many_sql())
def lexical_rank_of_many_scripts(spark, sf_dir):
    more = spark.createDataFrame([(f"x{i}", x) for i, x in enumerate(MANY)], "capsule_id string, content string")
    corpus = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("capsule_id"), F.col("text").alias("content"))
    return R.bm25(corpus.unionByName(more), F.col("content"), "capsule_id", MANY_QUERY, 50)


@query(f"{prelude('vectors')}, {near_sql(50)} SELECT capsule_id, distance, CAST(rank AS INTEGER) AS rank FROM nr")
def vector_rank(spark, sf_dir):
    return R.nearest(view(spark, sf_dir, "vectors"), VECTOR, 50)


@query(
    f"{prelude('capsules', 'vectors')}, {bm25_sql(60, tenant=False)}, {near_sql(60)} "
    "SELECT capsule_id, CAST(lex.rank AS INTEGER) AS lexical_rank, CAST(nr.rank AS INTEGER) AS vector_rank, CAST(round((coalesce(1.0 / (60 + lex.rank), 0) + coalesce(1.0 / (60 + nr.rank), 0)) * 1000000) AS BIGINT) AS rrf FROM lex FULL OUTER JOIN nr USING (capsule_id)"
)
def rrf_fusion(spark, sf_dir):
    corpus = view(spark, sf_dir, "capsules").where(LIVE)
    fused = R.fuse(R.bm25(corpus, F.concat_ws(" ", "summary", "content"), "capsule_id", QUERY, 60), R.nearest(view(spark, sf_dir, "vectors"), VECTOR, 60))
    return fused.withColumn("rrf", F.round(F.col("rrf") * R.SCALE).cast("bigint"))


@query(f"{hybrid_sql(20)} SELECT capsule_id, rrf_score, updated_at, CAST(rank AS INTEGER) AS rank FROM hits")
def hybrid_search(spark, sf_dir):
    out = R.hybrid(view(spark, sf_dir, "capsules"), view(spark, sf_dir, "vectors"), TENANT, QUERY, VECTOR, 20)
    return out.select("capsule_id", "rrf_score", "updated_at", "rank")


FILTERS = ["repo:repo_1", "project:src0"]


def request() -> S.Search:
    return S.Search(TENANT, QUERY, VECTOR, intent="debugging", scope_filters=FILTERS, now=NOW)


def score_sql(rows: str, out: str, boost: str = "0") -> str:
    """CTE `out`: rows with their score; `boost` is what the graph adds."""
    from tessera.functions.scoring import INTENT_SCORES

    has = lambda field, t: f"contains({field}, '{t}')"
    fields = {"lower(coalesce(summary, ''))": 8, "lower(coalesce(content, ''))": 6, "lower(array_to_string(code_refs, ' '))": 3, "lower(array_to_string(tags, ' '))": 3, "lower(coalesce(project, ''))": 2, "lower(coalesce(repo, ''))": 2, "lower(coalesce(module, ''))": 2}
    text = " + ".join(" + ".join(f"CASE WHEN {has(f, t)} THEN {w} ELSE 0 END" for f, w in fields.items()) + f" + CASE WHEN {' OR '.join(has(f, t) for f in fields)} THEN 4 ELSE 0 END" for t in SCORED)
    kind = "CASE capsule_type " + " ".join(f"WHEN '{t}' THEN {INTENT_SCORES['debug'][t]}" for t in CAPSULE_TYPES) + " END"
    anchor = "CAST(coalesce(last_used_at, updated_at) AS BIGINT)"
    return f"""sd_{out} AS (SELECT *, CAST({text} AS BIGINT) AS text_score, CASE WHEN repo = 'repo_1' THEN 18 ELSE -4 END + CASE WHEN project = 'src0' THEN 18 ELSE -4 END AS scope_points,
 {kind} AS type_points, CAST(round(confidence * 10) AS BIGINT) + CASE WHEN last_validated_at IS NULL THEN 0 ELSE 3 END - CAST(round(decay_score * 12) AS BIGINT) AS trust,
 6 - least(20, CAST(floor(((SELECT max({anchor}) FROM {rows}) - {anchor}) / 10000.0) AS BIGINT)) AS fresh,
 CASE WHEN status IN ('provisional', 'pending_confirmation') THEN -4 ELSE 0 END AS unsettled, CASE WHEN rrf IS NOT NULL THEN CAST(round(rrf * 1000) AS BIGINT) + 2 ELSE 0 END AS fused FROM {rows}),
{out} AS (SELECT *, text_score + scope_points + type_points + trust + fresh + unsettled + fused + {boost} AS score FROM sd_{out})"""


def final_sql(scored: str) -> str:
    """CTE `rk`: the scored rows that are shown, with their rank."""
    return f"""ad AS (SELECT * FROM {scored} WHERE CASE WHEN capsule_type IN ('preference', 'workflow') THEN (scope NOT IN ('project', 'repo') OR repo = 'repo_1' OR project = 'src0') ELSE score > 25 END),
ov AS (SELECT *, row_number() OVER (PARTITION BY coalesce(session_id, capsule_id) ORDER BY score DESC, updated_at DESC, version DESC, capsule_id) > 3 AS overflow FROM ad),
rk AS (SELECT *, row_number() OVER (ORDER BY overflow, score DESC, updated_at DESC, version DESC, capsule_id) AS rank FROM ov QUALIFY rank <= 1000)"""


SHOWN = f"""NOT coalesce(length(expires_at) = 20 AND expires_at <= '{NOW}', false) AND NOT (capsule_type = 'workflow' AND source_agent = 'skill-proposal-compiler')"""
IN_POOL = f"tenant = '{TENANT}' AND {LIVE} AND NOT EXISTS (SELECT 1 FROM capsules s WHERE s.status = 'active' AND s.tenant = c.tenant AND s.supersedes_id = c.capsule_id)"


def candidates_sql(newest: int | None = None) -> str:
    """CTEs up to `rw`: pool and hits."""
    pool = f"SELECT capsule_id FROM capsules c WHERE {IN_POOL}"
    if newest:
        pool = f"SELECT capsule_id FROM (SELECT * FROM capsules c WHERE {IN_POOL} ORDER BY updated_at DESC, version DESC, capsule_id LIMIT {newest}) UNION {pool} AND capsule_type IN ('preference', 'workflow')"
    return f"""{hybrid_sql(192)},
top AS (SELECT capsule_id, rrf FROM hits WHERE rank <= 48), pool AS ({pool} UNION SELECT capsule_id FROM top),
rw AS (SELECT c.*, top.rrf FROM capsules c JOIN pool USING (capsule_id) LEFT JOIN top USING (capsule_id) WHERE tenant = '{TENANT}' AND {SHOWN})"""


def search_sql() -> str:
    return f"{candidates_sql()}, {score_sql('rw', 'ss')}, {final_sql('ss')}"


@query(f"{search_sql()} SELECT capsule_id, CAST(score AS BIGINT) AS score, overflow, CAST(rank AS INTEGER) AS rank FROM rk")
def capsule_search(spark, sf_dir):
    out = S.search(view(spark, sf_dir, "capsules"), view(spark, sf_dir, "vectors"), request())
    return out.select("capsule_id", "score", "overflow", "rank")


@query(f"{search_sql()} SELECT capsule_id, CAST(score AS BIGINT) AS score, CAST(text_score AS BIGINT) AS text_score, CAST(fresh AS BIGINT) AS fresh FROM ss")
def recall_score(spark, sf_dir):
    from tessera.functions.scoring import freshness_anchor, freshness_score, text_match_score

    out = S.score(S.candidates(view(spark, sf_dir, "capsules"), view(spark, sf_dir, "vectors"), request()), request())
    return out.select("capsule_id", "score", text_match_score(SCORED).alias("text_score"), freshness_score(F.col("newest"), freshness_anchor()).alias("fresh"))


def sections_sql(rows: str, most: tuple[int, int, int]) -> str:
    """ps: the first rows of each section; directives, facts and patterns as many as `most`."""
    return f"""us AS (SELECT *, CASE WHEN capsule_type = 'preference' THEN 'directive' WHEN capsule_type = 'workflow' THEN 'workflow'
 WHEN regexp_matches(lower(concat_ws(' ', summary, content, array_to_string(tags, ' '))), 'pattern|heuristic|workflow|repeat') THEN 'pattern' ELSE 'fact' END AS section FROM {rows}),
ps AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY section ORDER BY rank) AS pos FROM us WHERE section <> 'workflow' OR status = 'active') WHERE pos <= CASE section WHEN 'directive' THEN {most[0]} WHEN 'fact' THEN {most[1]} WHEN 'pattern' THEN {most[2]} ELSE 1 END)"""


@query(f"""{search_sql()}, {sections_sql('rk', (1, 2, 1))} SELECT section, CAST(pos AS INTEGER) AS pos, capsule_id FROM ps""")
def packed_sections(spark, sf_dir):
    r = request()
    return S.pack(S.search(view(spark, sf_dir, "capsules"), view(spark, sf_dir, "vectors"), r), r.budget).select("section", "pos", "capsule_id")


def words_cut(x: str, n: int) -> str:
    """A text cut to so many words, its secrets masked."""
    safe, n = redact_sql(x), max(8, n)
    return f"CASE WHEN len(regexp_extract_all({safe}, '[^{WHITE}]+')) <= {n} THEN {safe} ELSE {trim(f"regexp_extract({safe}, '^({SPACE}*([^{WHITE}]+{SPACE}+){{{n}}})', 1)")} END"


def packed_sql(budget: int) -> str:
    """The texts of ps."""
    share = S.shares_of(max(80, budget))
    flow = share["workflow"]
    items = S.section_items(flow)
    spoken, patterns = f"CASE WHEN {trim('summary')} = '' THEN content ELSE summary END", "CASE WHEN contains(content, chr(10)) THEN content ELSE summary END"
    facts = f"CASE WHEN {trim('content')} = '' THEN summary ELSE content END"
    split = lambda c: f"list_filter(list_transform(regexp_split_to_array({c}, '[\n;•]'), lambda x: {trim(f"regexp_replace({trim('x')}, '^-+', '')")}), lambda x: x <> '')"
    steps = f"(CASE WHEN len({split('content')}) > 0 THEN {split('content')} ELSE {split('summary')} END)[1:{max(2, items)}]"
    signals = f"(CASE WHEN len(code_refs) = 0 THEN ['task completed without rollback'] ELSE [array_to_string(code_refs, ', ')] END)[1:{max(1, items)}]"
    cut_all = lambda xs, n: f"list_transform({xs}, lambda y: {words_cut('y', n)})"
    return f"""SELECT section, CAST(pos AS INTEGER) AS pos, capsule_id,
 md5(CASE section WHEN 'directive' THEN {words_cut(spoken, share['directive'])} WHEN 'fact' THEN {words_cut(facts, share['fact'])} WHEN 'pattern' THEN {words_cut(patterns, share['pattern'])} ELSE {words_cut(spoken, flow // 3 + 8)} END) AS text,
 CASE section {" ".join(f"WHEN '{n}' THEN {words_cut('summary', share[n] // 2 + 8)}" for n in ('directive', 'fact', 'pattern'))} END AS source_summary,
 CASE WHEN section = 'fact' THEN array_to_string(code_refs, '|') END AS code_refs, CASE WHEN section = 'pattern' THEN nullif(concat_ws(', ', 'project ' || project, 'repo ' || repo, 'module ' || module), '') END AS applies,
 CASE WHEN section = 'workflow' THEN array_to_string({cut_all(steps, flow // max(2, items) + 6)}, '|') END AS steps, CASE WHEN section = 'workflow' THEN array_to_string({cut_all(signals, flow // max(1, items) + 4)}, '|') END AS signals FROM ps"""


def with_evidence(spark, sf_dir):
    return view(spark, sf_dir, "capsules").withColumn("evidence", F.expr("CAST(array() AS array<string>)"))


def plain_texts(out):
    return out.withColumns({"text": F.md5("text")} | {c: F.array_join(c, "|") for c in ("code_refs", "steps", "signals")})


@query(f"{search_sql()}, {sections_sql('rk', (1, 2, 1))} {packed_sql(400)}")
def packed_texts(spark, sf_dir):
    """Search down to its texts, cut by words, which SQL can count; by subwords they are tested against the library."""
    r = request()
    found = S.search(with_evidence(spark, sf_dir), view(spark, sf_dir, "vectors"), r)
    return plain_texts(packing.packed(found, r.budget, packing.by_words))


@query(
    f"""{prelude('capsules')}, p AS (SELECT * FROM capsules WHERE tenant = '{TENANT}' AND {LIVE} ORDER BY updated_at DESC, version DESC, capsule_id LIMIT 256),
q AS (SELECT * FROM p WHERE NOT (capsule_type = 'workflow' AND source_agent = 'skill-proposal-compiler')),
rk AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN repo = 'repo_1' OR project = 'src0' THEN 0 ELSE 1 END, updated_at DESC, version DESC, capsule_id) AS rank FROM q QUALIFY rank <= 64),
{sections_sql('rk', (3, 3, 2))} {packed_sql(1000)}"""
)
def wake_up_texts(spark, sf_dir):
    r = request()
    r.budget = 1000
    return plain_texts(packing.wake_up(with_evidence(spark, sf_dir), None, r, packing.by_words)[0])


@query(
    f"""{prelude('messages')}, p AS (SELECT * FROM messages WHERE tenant = 't1' AND embed_eligible AND session_id IS NOT NULL ORDER BY created_at DESC, line_number DESC, block_index DESC, block_id DESC LIMIT 80),
s AS (SELECT session_id, max(created_at) AS last_at FROM p GROUP BY session_id ORDER BY last_at DESC, session_id LIMIT 3),
h AS (SELECT p.*, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, line_number DESC, block_index DESC) AS pos FROM p JOIN s USING (session_id) QUALIFY pos <= 4),
n AS (SELECT *, greatest(20, greatest(40, 300 // (SELECT count(DISTINCT session_id) FROM h)) // count(*) OVER (PARTITION BY session_id)) AS own FROM h)
SELECT session_id, CAST(pos AS INTEGER) AS pos, block_id, role, md5(array_to_string(regexp_extract_all({redact_sql('content')}, '[^{WHITE}]+')[1:own], ' ')) AS text FROM n"""
)
def wake_up_sessions(spark, sf_dir):
    first_words = lambda c, n: F.array_join(F.slice(F.regexp_extract_all(redact(c), F.lit(f"[^{WHITE}]+"), 0), F.lit(1), n.cast("int")), " ")
    r = S.Search("t1", "", [], budget=1000)
    out = packing.wake_up(with_evidence(spark, sf_dir), view(spark, sf_dir, "messages"), r, packing.by_words, first_words)[1]
    return out.withColumn("text", F.md5("text"))


@query(
    f"""{prelude('capsules')}, p AS (SELECT * FROM capsules WHERE tenant = '{TENANT}' AND {LIVE} ORDER BY updated_at DESC, capsule_id LIMIT 64)
SELECT capsule_id, CAST(row_number() OVER (ORDER BY CASE WHEN repo = 'repo_1' OR project = 'src0' THEN 0 ELSE 1 END, updated_at DESC, capsule_id) AS INTEGER) AS rank FROM p
WHERE NOT coalesce(length(expires_at) = 20 AND expires_at <= '{NOW}', false)"""
)
def wake_up(spark, sf_dir):
    return S.wake_up(view(spark, sf_dir, "capsules"), request()).select("capsule_id", "rank")


# the graph channel ----------------------------------------------------------------------------------------------------

#: Capsules hang at their project, repository and topics; every third is linked to the one seven places on, as by its likeness.
GRAPH_SQL = """ge AS (SELECT 'capability_capsule:' || capsule_id AS from_node, 'repo:' || repo AS to_node, 'observed_in' AS relation, 'ingest' AS extractor, NULL::DOUBLE AS confidence, 1.0 AS strength, NULL AS last_activated FROM capsules WHERE n % 8 = 0
UNION ALL SELECT 'capability_capsule:' || capsule_id, 'topic:' || topics[1], 'discusses', 'ingest', NULL, 1.0, NULL FROM capsules WHERE n % 6 = 1
UNION ALL SELECT 'capability_capsule:' || capsule_id, 'capability_capsule:cap_' || (n + 7), 'related_to', 'ingest_link', (n % 10) / 10.0, 2.0, lpad(CAST(1704070000000 - n * 3600000 AS VARCHAR), 20, '0') FROM capsules WHERE n % 3 <> 2
UNION ALL SELECT 'capability_capsule:' || capsule_id, 'capability_capsule:' || capsule_id, 'mentions', 'ingest', 1.0, 1.0, NULL FROM capsules WHERE n % 50 = 0)"""


def graph_edges(spark, sf_dir):
    n, me = F.col("n"), F.concat(F.lit("capability_capsule:"), "capsule_id")
    none = F.lit(None).cast("string")
    edge = lambda rows, to, relation, extractor, confidence, strength, last: rows.select(
        me.alias("from_node"), to.alias("to_node"), F.lit(relation).alias("relation"), F.lit("0" * 20).alias("valid_from"), none.alias("valid_to"), confidence.cast("double").alias("confidence"), F.lit(extractor).alias("extractor"), F.lit(strength).alias("strength"), F.lit(1.0).alias("stability"), last.alias("last_activated")
    )
    c = view(spark, sf_dir, "capsules")
    return (
        edge(c.where("n % 8 = 0"), F.concat(F.lit("repo:"), "repo"), "observed_in", "ingest", F.lit(None), 1.0, none)
        .unionAll(edge(c.where("n % 6 = 1"), F.concat(F.lit("topic:"), F.col("topics")[0]), "discusses", "ingest", F.lit(None), 1.0, none))
        .unionAll(edge(c.where("n % 3 <> 2"), F.concat(F.lit("capability_capsule:cap_"), n + 7), "related_to", "ingest_link", (n % 10) / 10.0, 2.0, F.lpad((F.lit(1704070000000) - n * 3600000).cast("string"), 20, "0")))
        .unionAll(edge(c.where("n % 50 = 0"), me, "mentions", "ingest", F.lit(1.0), 1.0, none))
    )


def anchored_sql(newest: int | None) -> str:
    """CTEs up to `an` (node): the anchors of the first pass."""
    node = lambda prefix, c: f"SELECT '{prefix}' || {c} AS node FROM bs"
    return f"""{candidates_sql(newest)}, {GRAPH_SQL}, {score_sql('rw', 's1')}, bs AS (SELECT * FROM s1 ORDER BY score DESC, updated_at DESC, version DESC, capsule_id LIMIT 5),
an AS (SELECT node FROM ({node('capability_capsule:', 'capsule_id')} UNION {node('project:', 'project')} UNION {node('repo:', 'repo')} UNION {node('module:', 'module')} UNION {node('workflow:', 'capsule_id')} WHERE capsule_type = 'workflow') WHERE node IS NOT NULL)"""


def boosts_sql(rounds: int = 20) -> str:
    from tessera.queries.graph import walk_sql

    return f"""f1 AS (SELECT * FROM ge WHERE from_node IN (SELECT node FROM an) OR to_node IN (SELECT node FROM an)),
fn AS (SELECT node FROM (SELECT from_node AS node FROM f1 UNION SELECT to_node FROM f1) WHERE node NOT IN (SELECT node FROM an) ORDER BY node LIMIT (SELECT 2048 - count(*) FROM an)),
fr AS (SELECT DISTINCT * FROM ge WHERE from_node IN (SELECT node FROM an UNION SELECT node FROM fn) OR to_node IN (SELECT node FROM an UNION SELECT node FROM fn)), {walk_sql('fr', 'an', rounds)},
ce AS (SELECT u AS node, max(b) AS ceiling FROM (SELECT u, b FROM ar) GROUP BY u),
bo AS (SELECT node, CAST(round(ceiling * least(1.0, p / (SELECT max(p) FROM p{rounds} WHERE node IN (SELECT node FROM an)))) AS BIGINT) AS boost FROM p{rounds} JOIN ce USING (node) WHERE starts_with(node, 'capability_capsule:') AND node NOT IN (SELECT node FROM an))"""


def graph_search_sql(newest: int | None, boosts: str, select: str) -> str:
    return f"""{anchored_sql(newest)}, {boosts}, gb AS (SELECT substr(node, 20) AS capsule_id, boost FROM bo WHERE boost > 0),
ms AS (SELECT * FROM capsules WHERE tenant = '{TENANT}' AND status = 'active' AND capsule_id IN (SELECT capsule_id FROM gb) AND capsule_id NOT IN (SELECT capsule_id FROM rw)),
rp AS (SELECT supersedes_id FROM rw WHERE supersedes_id IS NOT NULL UNION SELECT supersedes_id FROM ms WHERE supersedes_id IS NOT NULL),
r2 AS (SELECT x.*, coalesce(boost, 0) AS boost, FALSE AS hydrated FROM rw x LEFT JOIN gb USING (capsule_id) UNION ALL SELECT ms.*, NULL, boost, TRUE FROM ms JOIN gb USING (capsule_id) WHERE {SHOWN} AND capsule_type <> 'diary' AND capsule_id NOT IN (SELECT supersedes_id FROM rp)),
{score_sql('r2', 's2', 'boost')}, {final_sql('s2')} {select}"""


SHOW = "SELECT capsule_id, CAST(score AS BIGINT) AS score, CAST(boost AS BIGINT) AS graph_boost, CAST(rank AS INTEGER) AS rank FROM rk"


def graph_rows(out):
    return out.select("capsule_id", "score", F.coalesce("graph_boost", F.lit(0)).cast("bigint").alias("graph_boost"), "rank")


@query(graph_search_sql(None, boosts_sql(), SHOW))
def graph_search(spark, sf_dir):
    out, _ = S.search_with_graph(view(spark, sf_dir, "capsules"), view(spark, sf_dir, "vectors"), graph_edges(spark, sf_dir), request())
    return graph_rows(out)


@query(graph_search_sql(20, boosts_sql(), SHOW))
def graph_search_of_a_small_pool(spark, sf_dir):
    """Only the 20 newest rows, guidance and the hits are candidates: others come in by the graph alone."""
    r = request()
    r.pool = 20
    out, _ = S.search_with_graph(view(spark, sf_dir, "capsules"), view(spark, sf_dir, "vectors"), graph_edges(spark, sf_dir), r)
    return graph_rows(out)


@query(
    graph_search_sql(
        None,
        f"""en AS (SELECT from_node AS anchor, to_node AS node, confidence, extractor, strength, last_activated FROM ge UNION ALL SELECT to_node, from_node, confidence, extractor, strength, last_activated FROM ge), ea AS (SELECT * FROM en WHERE anchor IN (SELECT node FROM an)),
dg AS (SELECT anchor, greatest(1, count(*) FILTER (WHERE starts_with(node, 'capability_capsule:'))) AS d FROM ea GROUP BY anchor),
dy AS (SELECT node, CASE WHEN extractor = 'ingest_link' THEN 4 * confidence ELSE 12.0 END * (1.0 / (1.0 + 0.001 * (d - 1) * (d - 1))) * CASE WHEN {int(NOW)} > CAST(last_activated AS BIGINT) THEN greatest(0.05, strength * exp(-({int(NOW)} - CAST(last_activated AS BIGINT)) / 86400000.0)) ELSE strength END AS x FROM ea JOIN dg USING (anchor)),
bo AS (SELECT node, max(CAST(round(x) AS BIGINT)) AS boost FROM dy WHERE starts_with(node, 'capability_capsule:') AND node NOT IN (SELECT node FROM an) GROUP BY node)""",
        SHOW,
    )
)
def dynamic_graph_search(spark, sf_dir):
    out, _ = S.search_with_graph(view(spark, sf_dir, "capsules"), view(spark, sf_dir, "vectors"), graph_edges(spark, sf_dir), request(), dynamic=True)
    return graph_rows(out)
