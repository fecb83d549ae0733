"""Reads of the capsule table: lookups, scoped lists with keyset pages, pools for recall and review, roll-ups and version chains.

Every read is scoped by tenant. Filters are plain conjunctions, so they reach the Parquet scan; ordered reads end in a limit, so they are top-k
plans, not sorts.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.text import trimmed
from tessera.schemas import FEEDBACK, STATUSES

GUIDANCE = ("preference", "workflow")
EPISODIC = ("experience", "episode")
#: Parts in which a tenant's rows are ranked before the parts' best are.
RANK_PARTS = 64
COMPILER_AGENT = "skill-proposal-compiler"
NEWEST = (F.desc, "updated_at"), (F.asc, "capsule_id")


def newest_first(*more: Column) -> list[Column]:
    return [F.desc("updated_at"), *more, F.asc("capsule_id")]


def by_id(capsules: DataFrame, capsule_id: str, tenant: str | None = None) -> DataFrame:
    found = capsules.where(F.col("capsule_id") == capsule_id)
    return (found.where(F.col("tenant") == tenant) if tenant else found).limit(1)


def by_ids(capsules: DataFrame, tenant: str, ids: DataFrame) -> DataFrame:
    """Semi join; ids without a row are absent."""
    return capsules.where(F.col("tenant") == tenant).join(ids.select("capsule_id").distinct(), "capsule_id", "left_semi")


def pending(capsules: DataFrame, tenant: str, capsule_id: str) -> DataFrame:
    return by_id(capsules.where(F.col("status") == "pending_confirmation"), capsule_id, tenant)


def pending_verdict(capsules: DataFrame, tenant: str, capsule_id: str) -> DataFrame:
    """One row: found, or why not (conflict: it exists with another status)."""
    hit = by_id(capsules, capsule_id, tenant).select("capsule_id", F.when(F.col("status") == "pending_confirmation", "pending").otherwise("conflict").alias("outcome"))
    asked = capsules.sparkSession.createDataFrame([(capsule_id,)], "capsule_id string")
    return asked.join(hit, "capsule_id", "left").select("capsule_id", F.coalesce("outcome", F.lit("not_found")).alias("outcome"))


def by_key_or_hash(capsules: DataFrame, tenant: str, key: str | None, content_hash: str) -> DataFrame:
    """Matches of the key come before matches of the hash, then the newest."""
    own = F.coalesce(F.col("idempotency_key") == F.lit(key), F.lit(False)) if key is not None else F.lit(False)
    hit = capsules.where((F.col("tenant") == tenant) & (own | (F.col("content_hash") == content_hash)))
    return hit.orderBy(F.when(own, 0).otherwise(1), *newest_first()).limit(1)


def scope_page(capsules: DataFrame, tenant: str, cursor: tuple[str, str] | None = None, limit: int = 50, **equal: str | None) -> DataFrame:
    """A keyset page, newest first. has_more tells of a row beyond it."""
    limit = max(1, min(200, limit))
    rows = capsules.where(F.col("tenant") == tenant)
    for column, value in equal.items():
        if value is not None:
            rows = rows.where(F.col(column) == value)
    if cursor:
        rows = rows.where((F.col("updated_at") < cursor[0]) | ((F.col("updated_at") == cursor[0]) & (F.col("capsule_id") > cursor[1])))
    top = rows.orderBy(*newest_first()).limit(limit + 1)
    place = top.withColumn("pos", F.row_number().over(Window.orderBy(*newest_first())))  # of limit + 1 rows
    return place.withColumn("has_more", F.max("pos").over(Window.partitionBy()) > limit).where(F.col("pos") <= limit)


def pending_review(capsules: DataFrame, tenant: str) -> DataFrame:
    return capsules.where((F.col("tenant") == tenant) & (F.col("status") == "pending_confirmation")).orderBy(F.desc("created_at"), "capsule_id")


def promotable(cutoff: str, types: Iterable[str], max_decay: float) -> Column:
    """Pending rows of these types that have lain untouched since the cutoff and have hardly decayed."""
    return (F.col("status") == "pending_confirmation") & (F.col("updated_at") < cutoff) & (F.col("decay_score") < max_decay) & F.col("capsule_type").isin(list(types))


def auto_promote_candidates(capsules: DataFrame, tenant: str, cutoff: str, types: Iterable[str], max_decay: float) -> DataFrame:
    return capsules.where((F.col("tenant") == tenant) & promotable(cutoff, types, max_decay)).orderBy("created_at", "capsule_id")


def superseded(capsules: DataFrame) -> DataFrame:
    """(tenant, capsule_id) that an active row of the same tenant supersedes."""
    return capsules.where((F.col("status") == "active") & F.col("supersedes_id").isNotNull()).select("tenant", F.col("supersedes_id").alias("capsule_id")).distinct()


def live(capsules: DataFrame) -> DataFrame:
    return capsules.where(~F.col("status").isin("rejected", "archived") & (F.col("capsule_type") != "diary"))


def recall_pool(capsules: DataFrame, tenant: str | None = None, newest: int | None = None) -> DataFrame:
    """Live rows that no active row supersedes. With `newest`, that many of each tenant, and all guidance."""
    if tenant is not None:
        capsules = capsules.where(F.col("tenant") == tenant)
    pool = live(capsules).join(superseded(capsules), ["tenant", "capsule_id"], "left_anti")
    if newest is None:
        return pool
    # ranked in parts first, so that no task holds more of a tenant than a part, or than the parts' best
    order = (F.desc("updated_at"), F.desc("version"), F.asc("capsule_id"))
    part = F.pmod(F.xxhash64("capsule_id"), F.lit(RANK_PARTS))
    dealt = pool.withColumn("part_", part).withColumn("rank_", F.row_number().over(Window.partitionBy("tenant", "part_").orderBy(*order)))
    best = dealt.where(F.col("rank_") <= newest).withColumn("rank_", F.row_number().over(Window.partitionBy("tenant").orderBy(*order))).where(F.col("rank_") <= newest)
    rest = pool.where(is_guidance()).join(best.select("tenant", "capsule_id"), ["tenant", "capsule_id"], "left_anti")
    return best.drop("part_", "rank_").unionByName(rest)


def recent_pool(capsules: DataFrame, tenant: str, limit: int) -> DataFrame:
    """Superseded rows count here."""
    return live(capsules.where(F.col("tenant") == tenant)).orderBy(*newest_first()).limit(max(1, min(1024, limit)))


def id_list(capsules: DataFrame, tenant: str) -> DataFrame:
    return capsules.where(F.col("tenant") == tenant).orderBy(*newest_first()).select("capsule_id", "updated_at")


# predicates and rules as columns -----------------------------------------------------------------------------------


def is_expired(now: str) -> Column:
    e = F.col("expires_at")
    return F.coalesce((F.length(e) == len(now)) & (e <= now), F.lit(False))


def allowed_in_recall() -> Column:
    return ~((F.col("capsule_type") == "workflow") & F.coalesce(F.col("source_agent") == COMPILER_AGENT, F.lit(False)))


def is_guidance() -> Column:
    return F.col("capsule_type").isin(*GUIDANCE)


def is_episodic() -> Column:
    return F.col("capsule_type").isin(*EPISODIC)


def initial_status(capsule_type: Column, write_mode: Column) -> Column:
    return F.when(capsule_type.isin(*GUIDANCE) | (write_mode == "propose"), "pending_confirmation").otherwise("active")


def activation_policy() -> Column:
    return F.when((F.col("capsule_type") == "workflow") & (F.col("source_agent") == COMPILER_AGENT), "skill_bundle_required").when(is_guidance(), "human_review_only").otherwise("auto_eligible")


def default_confidence(status: Column) -> Column:
    return F.when(status == "active", 0.9).when(status == "pending_confirmation", 0.6).when(status == "provisional", 0.5).otherwise(0.0)


def low_value_reason(min_chars: int = 40) -> Column:
    """Experiences only: too short, or one line without evidence or references and under three times the least length."""
    text = trimmed("content")
    bare = (F.size("code_refs") <= 0) & ~F.contains(text, F.lit("\n")) & (F.char_length(text) < 3 * min_chars)
    return F.when(F.col("capsule_type") != "experience", F.lit(None).cast("string")).when(F.char_length(text) < min_chars, "too_short").when(bare, "single_line_without_evidence")


def scope_matches(kind: Column, value: Column) -> Column:
    return F.coalesce(
        F.when(kind == "repo", F.col("repo") == value).when(kind == "project", F.col("project") == value).when(kind == "module", F.col("module") == value)
        .when(kind == "scope", F.col("scope") == value).when(kind == "tag", F.array_contains("tags", value)).otherwise(F.lit(False)), F.lit(False)
    )


def parse_scope_filters(filters: list[str]) -> dict[str, list[str]]:
    """`kind:value`; a bare word is a tag."""
    out: dict[str, list[str]] = {}
    for f in filters:
        kind, colon, value = f.partition(":")
        out.setdefault(kind if colon else "tag", []).append(value if colon else f)
    return out


def matches_any_scope(filters: list[str]) -> Column:
    parsed = [(k, v) for k, vs in parse_scope_filters(filters).items() for v in vs]
    out = F.lit(not parsed)
    for k, v in parsed:
        out = out | scope_matches(F.lit(k), F.lit(v))
    return out


def guidance_in_scope(filters: list[str]) -> Column:
    return F.when(F.col("scope").isin("project", "repo") & F.lit(bool(filters)), matches_any_scope(filters)).otherwise(F.lit(True))


def idle_candidate(cutoff: str, max_confidence: float, min_decay: float, min_chars: int = 40, low_value: Column | None = None) -> Column:
    """low_value: whether the content is of low value, where that is known already."""
    low_value = low_value_reason(min_chars).isNotNull() if low_value is None else low_value
    return (
        (F.col("status") == "active") & F.col("last_recalled_at").isNull() & (F.col("created_at") <= cutoff)
        & (F.col("confidence") <= max_confidence + 1e-6) & (F.col("decay_score") >= min_decay) & low_value
    )


# roll-ups ----------------------------------------------------------------------------------------------------------


def status_histogram(capsules: DataFrame) -> DataFrame:
    return capsules.groupBy("tenant").agg(F.count("*").alias("total"), *(F.count_if(F.col("status") == s).alias(s) for s in STATUSES))


def feedback_histogram(feedback: DataFrame) -> DataFrame:
    """Kinds that are not known count in the total alone."""
    return feedback.groupBy("capsule_id").agg(F.count("*").alias("total"), *(F.count_if(F.col("kind") == k).alias(k) for k in FEEDBACK))


def wings(capsules: DataFrame, tenant: str) -> DataFrame:
    return capsules.where((F.col("tenant") == tenant) & F.col("project").isNotNull()).select("project").distinct().orderBy("project")


def taxonomy(capsules: DataFrame, tenant: str) -> DataFrame:
    """project and its repos, sorted, one row a pair (a project without repos has a null one)."""
    return capsules.where((F.col("tenant") == tenant) & F.col("project").isNotNull()).groupBy("project").agg(F.array_sort(F.collect_set("repo")).alias("repos"))


def profile(capsules: DataFrame, entities: DataFrame, tenant: str, limit: int) -> DataFrame:
    """Active preferences, workflows and entities, each up to limit, newest first."""
    mine = capsules.where((F.col("tenant") == tenant) & (F.col("status") == "active"))
    parts = [
        mine.where(F.col("capsule_type") == t).orderBy(*newest_first()).limit(limit).select(F.lit(s).alias("section"), F.col("capsule_id").alias("id"), "updated_at")
        for s, t in (("preferences", "preference"), ("workflows", "workflow"))
    ]
    parts.append(entities.where(F.col("tenant") == tenant).orderBy(F.desc("created_at"), "entity_id").limit(limit).select(F.lit("entities").alias("section"), F.col("entity_id").alias("id"), F.col("created_at").alias("updated_at")))
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.withColumn("pos", F.row_number().over(Window.partitionBy("section").orderBy(F.desc("updated_at"), "id")))


def shared_value(column: str) -> Column:
    """The value that all rows of a group have, if they have one."""
    return F.when((F.count_distinct(column) == 1) & (F.count(column) == F.count("*")), F.max(column))


def themes() -> Column:
    """Topics and tags, trimmed and lower-cased, blanks dropped."""
    cleaned = F.transform(F.concat("topics", "tags"), lambda x: F.lower(trimmed(x)))
    return F.array_sort(F.array_distinct(F.filter(cleaned, lambda x: x != "")))


def shared_themes(members: DataFrame, *keys: str) -> DataFrame:
    """Themes that every member of a group has: counted, not intersected array by array, so a large group stays distributed."""
    sizes = members.groupBy(*keys).agg(F.count("*").alias("members"))
    per = members.select(*keys, F.explode(themes()).alias("theme")).groupBy(*keys, "theme").agg(F.count("*").alias("n"))
    return per.join(sizes, list(keys)).where(F.col("n") == F.col("members")).select(*keys, "theme", "members")


def version_chain(capsules: DataFrame, tenant: str, capsule_id: str) -> DataFrame:
    """The undirected closure of supersedes_id around one row, inside its tenant, however long: one component of the tenant's links."""
    from tessera.operators.retrieval import components

    mine = capsules.where(F.col("tenant") == tenant)
    links = mine.where(F.col("supersedes_id").isNotNull()).select(F.col("capsule_id").alias("a"), F.col("supersedes_id").alias("b")).join(mine.select(F.col("capsule_id").alias("b")), "b", "left_semi").select("a", "b")
    roots = components(links)
    own = roots.where(F.col("node") == capsule_id).select("root")
    ends = own.select(F.col("root").alias("node")).unionAll(roots.join(own, "root", "left_semi").select("node")).unionAll(mine.sparkSession.createDataFrame([(capsule_id,)], "node string"))
    ends = ends.unionAll(roots.where(F.col("root") == capsule_id).select("node"))
    return mine.join(ends.select(F.col("node").alias("capsule_id")).distinct(), "capsule_id", "left_semi").orderBy(F.desc("version"), F.desc("updated_at"))
