"""Text, time and hash functions over document texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.fixtures import prelude, view
from tessera.functions import metrics, subwords, text, timefn
from tessera.queries import query
from tessera.queries.dialect import SPACE, fingerprint, trim

CAP = prelude("capsules")


def caps(spark, sf_dir):
    return view(spark, sf_dir, "capsules")


def j(array):
    return F.array_join(array, "|")


@query(f"SELECT doc_id, lower({trim(f"regexp_replace(text, '{SPACE}+', ' ', 'g')")}) AS alias, array_to_string(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> ''), '|') AS words FROM documents")
def normal_forms(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", text.normalize_alias(F.col("text")).alias("alias"), j(text.tokenize(F.col("text"))).alias("words"))


#: Lines that a generated text seldom has: marks, fences, bullets, full-width stops, long lines, other white space.
LINES = (
    "# Title. More", "> quoted! yes", "- a bullet item", "---", "```\ncode line\n```\nafter the fence", "```open\nnever closed", "第一句。第二句", "v3.5.0.3 is out. Next", "   \t ", "", "## **bold** heading", "* * *", "中文！后面",
    "word " * 40, "x" * 130, "a" * 50 + " " + "b" * 80, "\u3000\u3000ideographic space? yes", "```a\nb\n```\n\n+ plus item. rest", "1. numbered",
)
SUMMARY_TEXTS = "SELECT CAST(doc_id AS VARCHAR(20)) AS id, text FROM documents UNION ALL " + " UNION ALL ".join(f"SELECT 'l{i}', '{x}'" for i, x in enumerate(LINES))


def texts(spark, sf_dir, more):
    """Every document, and lines of the query's own."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("id"), "text")
    return d.unionByName(spark.createDataFrame([(f"l{i}", x) for i, x in enumerate(more)], "id string, text string"))


def summary_sql() -> str:
    bare = f"regexp_replace(regexp_replace(x, '^[#>`]+{SPACE}*', ''), '^[-*+] ', '')"
    line = f"list_filter(list_transform(list_transform(string_split(body, chr(10)), lambda x: {trim('x')}), lambda x: CASE WHEN regexp_full_match(x, '[#*_=> -]*') THEN '' ELSE {trim(bare)} END), lambda x: x <> '')[1]"
    fence = r"(\A|\n)[ \t\r\x0b\x0c]*```[\s\S]*?(\n[ \t\r\x0b\x0c]*```[^\n]*|\z)"
    cut = trim(f"regexp_extract(line, '^([\\s\\S]*?([。！？]|[.!?]({SPACE}|\\z)))', 1)")
    back = f"regexp_extract(substring(line, 1, 100), '^([\\s\\S]*){SPACE}', 1)"
    return f"""WITH t AS ({SUMMARY_TEXTS}), b AS (SELECT id, regexp_replace(text, '{fence}', chr(10), 'g') AS body FROM t), l AS (SELECT id, {line} AS line FROM b),
c AS (SELECT id, line, {cut} AS cut, {back} AS back FROM l),
s AS (SELECT id, {trim("CASE WHEN cut <> '' AND length(cut) <= 100 THEN cut WHEN length(line) <= 100 THEN line WHEN length(back) >= 60 THEN back ELSE substring(line, 1, 100) END")} AS s FROM c) SELECT id, CASE WHEN s <> '' THEN s ELSE 'memory' END AS summary FROM s"""


@query(summary_sql())
def summaries(spark, sf_dir):
    return texts(spark, sf_dir, LINES).select("id", text.summarize(F.col("text")).alias("summary"))


def redact_sql(column: str) -> str:
    for pattern, mark in text.SECRETS:
        column = f"regexp_replace({column}, '{pattern}', '{mark}', 'g')"
    return column


@query(f"SELECT doc_id, md5({redact_sql('text')}) AS redacted FROM documents")
def redaction(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", F.md5(text.redact(F.col("text"))).alias("redacted"))


def parameterize_sql(column: str) -> str:
    for pattern, mark in text.PLACEHOLDERS:
        p = pattern.replace("'", "''")
        m = mark.replace("$1", "\\1")
        column = f"regexp_replace({column}, '{p}', '{m}', 'g')"
    return column


@query(f"SELECT doc_id, md5({parameterize_sql('text')}) AS parameterized FROM documents")
def parameterization(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", F.md5(text.parameterize(F.col("text"))).alias("parameterized"))


SAID = (
    "我们最终决定采用 Lance 作为本地存储后端", "default vacuum stays off because aggressive prune deletes a referenced manifest", "报错 Text file busy，最后改用 rm 加 cp 绕过去解决了", "The retry lives in src/storage/decay.py and runs on update",
    "the maintenance window for ProjectFalcon spans the whole weekend", "the weather is nice today and i went out", "因为", "团队决定采用甲方案来处理。团队决定采用乙方案来处理。团队决定采用丙方案来处理", "我们决定采用方案甲来落地实现。我们决定采用方案甲来落地实现",
    "Because the cache was cold we edited deploy.yaml. It helped! We will use version 0.6 now? ok", "a.json\u00a0is read at start\r\nand   turns out\u3000fine", "call reset() before std::move of `x`", "shell.shx is no such file here", "",
)
ALIASES = ("projectfalcon",)


def candidates_sql() -> str:
    cues = " OR ".join(f"contains(lower(x), '{c.replace(chr(39), chr(39) * 2)}')" for c in text.CUES)
    code = r"regexp_matches(x, '`|::|\(\)|[\p{L}\p{N}\p{M}_./-]\.(rs|ts|tsx|js|jsx|py|go|toml|json|md|sql|sh|yaml|yml)([^\p{L}\p{N}\p{M}_]|\z)')"
    known = f"contains(lower({trim(f"regexp_replace(x, '{SPACE}+', ' ', 'g')")}), 'projectfalcon')"
    rows = " UNION ALL ".join(f"SELECT 'l{i}', '{x}'" for i, x in enumerate(SAID))
    return f"""WITH t AS (SELECT CAST(doc_id AS VARCHAR(20)) AS id, text FROM documents UNION ALL {rows}), s AS (SELECT id, list_filter(list_transform(string_split_regex(text, '[。！？\\n\\r]+|[.!?]{SPACE}+'), lambda x: {trim('x')}), lambda x: x <> '') AS s FROM t),
g AS (SELECT id, s, list_filter(s, lambda x: length(x) BETWEEN 12 AND 400 AND length(regexp_replace(x, '[^\\p{{L}}\\p{{N}}]', '', 'g')) >= 4 AND ({cues} OR {code} OR {known})) AS g FROM s),
u AS (SELECT id, i, g[i] AS x FROM (SELECT id, g, unnest(generate_series(1, len(g))) AS i FROM g)), f AS (SELECT id, x, min(i) AS i FROM u GROUP BY 1, 2), k AS (SELECT id, list(x ORDER BY i)[1:2] AS c FROM f GROUP BY id)
SELECT id, CAST(len(s) AS BIGINT) AS sentences, coalesce(array_to_string(c, '|'), '') AS candidates FROM g LEFT JOIN k USING (id)"""


@query(candidates_sql())
def sentence_candidates(spark, sf_dir):
    found = text.candidate_sentences(F.col("text"), ALIASES)
    return texts(spark, sf_dir, SAID).select("id", F.size(text.sentences(F.col("text"))).cast("bigint").alias("sentences"), j(found).alias("candidates"))


@query(
    r"""WITH h AS (SELECT page_id, list_filter(string_split(html, chr(10)), lambda x: regexp_matches(x, '(?i)panic|traceback|exception|assertion|segfault|core dumped|fatal|error\[|could not compile|command not found|no such file|not found|permission denied|connection refused|cannot open|unresolved|undefined reference|[0-9]+ (failed|errors?)|E[0-9]{3,4}|[A-Za-z_.]+(Error|Exception)'))[1:3] AS l FROM pages),
c AS (SELECT page_id, substring(array_to_string(list_transform(l, lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), ' '), 1, 400) AS s FROM h)
SELECT page_id, CASE WHEN length(s) >= 8 THEN s END AS signature FROM c"""
)
def error_signatures(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return p.select("page_id", text.error_signature(F.col("html")).alias("signature"))


FINGERPRINTED = ("广信息学校排查", "今天又翻了一遍广信息学校的排查手册", "duckdb广信息 ok", "DuckDB_single-writer MVCC", "a é bb éé Straße", "per but the", "")


def fingerprint_sql() -> str:
    rows = " UNION ALL ".join(f"SELECT 'l{i}', '{x}'" for i, x in enumerate(FINGERPRINTED))
    return f"""WITH t AS (SELECT CAST(doc_id AS VARCHAR(20)) AS id, text FROM documents UNION ALL {rows}), r AS (SELECT id, {fingerprint('text')} AS r FROM t),
u AS (SELECT id, i, r[i] AS x FROM (SELECT id, r, unnest(generate_series(1, len(r))) AS i FROM r)), f AS (SELECT id, x, min(i) AS i FROM u GROUP BY 1, 2), k AS (SELECT id, list(x ORDER BY i)[1:64] AS c FROM f GROUP BY id)
SELECT id, coalesce(array_to_string(c, '|'), '') AS tokens FROM t LEFT JOIN k USING (id)"""


@query(fingerprint_sql())
def lexical_fingerprint(spark, sf_dir):
    return texts(spark, sf_dir, FINGERPRINTED).select("id", j(text.fingerprint(F.col("text"))).alias("tokens"))


@query(
    r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \t\n\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(CASE WHEN len(w) <= 200 THEN [0] ELSE generate_series(0, len(w) - 21, 180) END) AS i FROM w)
SELECT doc_id, CAST(i / 180 AS INTEGER) AS chunk, md5(array_to_string(w[CAST(i AS BIGINT) + 1 : CAST(i AS BIGINT) + 200], ' ')) AS digest FROM s"""
)
def chunked_texts(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", F.posexplode(text.chunks(F.col("text"), 200, 20)).alias("chunk", "words")).select("doc_id", "chunk", F.md5("words").alias("digest"))


@query(r"""WITH b AS (SELECT doc_id, regexp_replace(text, 'mem_[0-9a-f-]+', ' ', 'g') AS t FROM documents) SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(t, '\b[0-9a-f]{7,40}\b'), lambda x: regexp_matches(x, '[0-9]') AND regexp_matches(x, '[a-f]')))), '|') AS anchors FROM b""")
def fact_anchors(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", j(text.fact_anchors(F.col("text"), F.array().cast("array<string>"))).alias("anchors"))


@query(
    f"""{CAP}, r AS (SELECT capsule_id, repo, unnest(code_refs) AS ref FROM capsules)
SELECT capsule_id, ref, regexp_replace(regexp_replace(trim(ref), '(:[0-9]+)+$', ''), '/+$', '') AS path, repo || ':' || regexp_replace(regexp_replace(trim(ref), '(:[0-9]+)+$', ''), '/+$', '') AS alias FROM r"""
)
def file_references(spark, sf_dir):
    r = caps(spark, sf_dir).select("capsule_id", "repo", F.explode("code_refs").alias("ref"))
    path = text.normalize_file_ref(F.col("ref"))
    return r.select("capsule_id", "ref", path.alias("path"), text.file_alias(F.col("repo"), path).alias("alias"))


PROMPTS = ("\tok\n", " why is it slow ", "继续吧", "!ls", " /help", "abc", "\u3000好的\u3000", "x" * 1200, "  " + "y" * 1200)


def prompts_sql() -> str:
    p = trim("text")
    rows = " UNION ALL ".join(f"SELECT 'l{i}', '{x}'" for i, x in enumerate(PROMPTS))
    said = ", ".join(f"'{c}'" for c in text.CONTINUATIONS)
    return f"""WITH t AS (SELECT conv_id || '/' || turn AS id, text FROM conversations UNION ALL {rows})
SELECT id, CASE WHEN {p} = '' OR starts_with({p}, '/') OR starts_with({p}, '!') OR length({p}) < 4 OR lower({p}) IN ({said}) THEN NULL ELSE substring(text, 1, 1000) END AS prompt FROM t"""


@query(prompts_sql())
def recall_prompts(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "text")
    more = spark.createDataFrame([(f"l{i}", x) for i, x in enumerate(PROMPTS)], "id string, text string")
    return c.unionByName(more).select("id", text.prompt_to_recall(F.col("text")).alias("prompt"))


@query(
    """SELECT event_id, lpad(CAST(epoch_us(ts) // 1000 AS VARCHAR), 20, '0') AS stamp, lpad(CAST((epoch_us(ts) // 1000) + 90061 AS VARCHAR), 20, '0') AS later, lpad(CAST(greatest(0, (epoch_us(ts) // 1000) - 1800000) AS VARCHAR), 20, '0') AS earlier,
CAST(trunc((1704067200000 - (epoch_us(ts) // 1000)) / 60000.0) AS BIGINT) AS minutes FROM events"""
)
def instants(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", timefn.stamp(F.unix_millis(F.col("ts").cast("timestamp"))).alias("stamp"))
    s = F.col("stamp")
    return e.select("event_id", "stamp", timefn.add_ms(s, 90_061).alias("later"), timefn.sub_ms(s, 1_800_000).alias("earlier"), timefn.minutes_between(s, F.lit(timefn.now_literal(1704067200000))).alias("minutes"))


@query(f"""{CAP} SELECT capsule_id, content_hash, substring(content_hash, 1, 8) AS key_suffix, sha256(concat_ws(chr(31), tenant, project, repo, capsule_type, scope, content)) AS record_hash FROM capsules""")
def content_hashes(spark, sf_dir):
    return caps(spark, sf_dir).select("capsule_id", "content_hash", F.substring("content_hash", 1, 8).alias("key_suffix"), F.sha2(F.concat_ws("\x1f", "tenant", "project", "repo", "capsule_type", "scope", "content"), 256).alias("record_hash"))


RUNS = """qr AS (SELECT DISTINCT doc_id % 40 AS query_id, doc_id AS item_id FROM labels WHERE quality = 1 AND doc_id % 3 <> 0),
rn AS (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY (item_id * 7919 + query_id * 31) % 101, item_id) AS rank FROM (SELECT DISTINCT doc_id % 40 AS query_id, doc_id AS item_id FROM labels))"""


@query(
    f"""WITH {RUNS}, n AS (SELECT query_id, count(*) AS relevant FROM (SELECT DISTINCT query_id, item_id FROM qr) GROUP BY query_id),
h AS (SELECT r.*, CASE WHEN q.item_id IS NULL THEN 0 ELSE 1 END AS hit FROM rn r LEFT JOIN (SELECT DISTINCT query_id, item_id FROM qr) q USING (query_id, item_id)),
p AS (SELECT query_id, sum(CASE WHEN rank <= 5 THEN hit / log2(rank + 1.0) ELSE 0 END) AS dcg, sum(CASE WHEN rank <= 5 THEN hit ELSE 0 END) AS hits, min(CASE WHEN hit = 1 THEN rank END) AS first FROM h GROUP BY query_id)
SELECT query_id, CAST(round(dcg * 1000000) AS BIGINT) AS dcg, CASE WHEN relevant IS NULL THEN 0 ELSE CAST(round(dcg / list_sum(list_transform(generate_series(1, least(relevant, 5)), lambda i: 1 / log2(i + 1.0))) * 1000000) AS BIGINT) END AS ndcg, CAST(round(coalesce(1.0 / first, 0) * 1000000) AS BIGINT) AS mrr,
CASE WHEN relevant IS NULL THEN 0 ELSE CAST(round(hits * 1000000.0 / relevant) AS BIGINT) END AS recall, CAST(hits > 0 AS BIGINT) * 1000000 AS recall_any, CASE WHEN relevant IS NULL THEN 0 ELSE CAST(hits = relevant AS BIGINT) * 1000000 END AS recall_all, CAST(round(hits * 200000.0) AS BIGINT) AS precision FROM p LEFT JOIN n USING (query_id)"""
)
def ranking_metrics(spark, sf_dir):
    from pyspark.sql.window import Window

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").withColumn("query_id", F.col("doc_id") % 40).withColumnRenamed("doc_id", "item_id")
    items = labels.select("query_id", "item_id").distinct()
    qr = labels.where("quality = 1 and item_id % 3 <> 0").select("query_id", "item_id")
    runs = items.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy((F.col("item_id") * 7919 + F.col("query_id") * 31) % 101, "item_id")))
    out = metrics.evaluate(runs, qr, 5)
    return out.select("query_id", *(F.round(F.col(c) * 1_000_000).cast("bigint").alias(c) for c in ("dcg", "ndcg", "mrr", "recall", "recall_any", "recall_all", "precision")))


@query()
def subword_windows(spark, sf_dir):
    """Windows of subwords with their bytes' offsets; held against the library's encode and decode in tests, as SQL has no vocabulary."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    w = d.select("doc_id", F.posexplode(subwords.subword_windows(F.col("text"), 200, 20)).alias("chunk", "w"))
    return w.select("doc_id", "chunk", "w.start", "w.stop", F.md5("w.text").alias("text"))
