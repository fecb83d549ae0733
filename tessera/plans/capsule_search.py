"""Capsule search: pool, hybrid channels, lifecycle score, optional graph boost, floor, diversity, sections."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.codec import anchor_nodes
from tessera.functions.scoring import freshness_anchor, half_up, lifecycle_score
from tessera.operators import capsules as C
from tessera.operators import graph as G
from tessera.operators.retrieval import hybrid, ranked, score_terms
from tessera.operators.storage import cut

# Fixed values of ranking.
HYBRID_K = 48
FETCH = 4
FLOOR = 25
SOURCE_CAP = 3
EVIDENCE_BONUS = 2
ANCHOR_ROWS = 5


@dataclass
class Search:
    """The request: what, for whom, within which scopes."""

    tenant: str
    query: str
    vector: list[float]
    intent: str = ""
    scope_filters: list[str] = field(default_factory=list)
    now: str = "0" * 20
    floor: int = FLOOR
    source_cap: int = SOURCE_CAP
    k: int = HYBRID_K
    budget: int = 400
    limit: int = 1000
    #: The newest rows of the tenant that are looked at besides the hits and guidance; all without it.
    pool: int | None = None


def candidates(capsules: DataFrame, vectors: DataFrame, s: Search) -> DataFrame:
    """Pool and hybrid hits together (a row of both is one row), expired and inadmissible ones dropped; rrf is null outside the hits."""
    hits = hybrid(capsules, vectors, s.tenant, s.query, s.vector, s.k * FETCH).orderBy("rank").limit(s.k).select("capsule_id", "rrf")
    hits = capsules.sparkSession.createDataFrame(hits.collect(), hits.schema)  # s.k rows, read four times
    pool = C.recall_pool(capsules, s.tenant, s.pool).select("capsule_id").unionByName(hits.select("capsule_id")).distinct()
    rows = capsules.where(F.col("tenant") == s.tenant).join(pool, "capsule_id", "left_semi").where(~C.is_expired(s.now) & C.allowed_in_recall())
    return rows.join(hits, "capsule_id", "left")


def score(rows: DataFrame, s: Search, boosts: DataFrame | None = None) -> DataFrame:
    boosted = rows.join(boosts, "capsule_id", "left") if boosts is not None else rows.withColumn("graph_boost", F.lit(0).cast("bigint"))
    base = lifecycle_score(F.col("newest"), score_terms(s.query), s.scope_filters, s.intent, F.col("graph_boost"))
    fused = F.when(F.col("rrf").isNotNull(), half_up(F.col("rrf") * 1000) + EVIDENCE_BONUS).otherwise(0)
    # the newest anchor is one aggregate, read as a scalar: no window over the tenant
    top = rows.agg(F.max(freshness_anchor()).alias("m")).scalar()
    return boosted.withColumn("newest", top).withColumn("score", (base + fused).cast("bigint"))


def finalize(scored: DataFrame, s: Search) -> DataFrame:
    """Guidance passes the floor if in scope, the rest must exceed it; beyond `source_cap` rows of one session go to the tail, in order."""
    admitted = scored.where(F.when(C.is_guidance(), C.guidance_in_scope(s.scope_filters)).otherwise(F.col("score") > s.floor))
    order = ranking()
    source = F.coalesce("session_id", "capsule_id")
    capped = admitted.withColumn("overflow", F.row_number().over(Window.partitionBy(source).orderBy(*order)) > (s.source_cap or 1 << 30))
    # a top-k: only s.limit rows are ranked, however many are admitted
    return ranked(capped.orderBy("overflow", *order).limit(s.limit), F.asc("overflow"), *order)


def section() -> Column:
    text = F.lower(F.concat_ws(" ", "summary", "content", F.array_join("tags", " ")))
    return (
        F.when(F.col("capsule_type") == "preference", "directive").when(F.col("capsule_type") == "workflow", "workflow")
        .when(text.rlike("pattern|heuristic|workflow|repeat"), "pattern").otherwise("fact")
    )


def section_items(budget: int) -> int:
    return 1 if budget <= 120 else 2 if budget <= 250 else 3 if budget <= 450 else 4


def shares_of(budget: int) -> dict[str, int]:
    """The sections' shares of a budget."""
    shares = {"directive": budget * 30 // 100, "fact": budget * 35 // 100, "pattern": budget * 20 // 100}
    return shares | {"workflow": budget - sum(shares.values())}


def pack(ranked: DataFrame, budget: int) -> DataFrame:
    """section, pos: the first rows of each section within its share of the budget."""
    most = F.lit(0)
    for name, b in shares_of(budget).items():
        most = F.when(F.col("section") == name, section_items(b) if name != "workflow" else 1).otherwise(most)
    usable = ranked.withColumn("section", section()).where((F.col("section") != "workflow") | (F.col("status") == "active"))
    return usable.withColumn("pos", F.row_number().over(Window.partitionBy("section").orderBy("rank"))).where(F.col("pos") <= most)


def search(capsules: DataFrame, vectors: DataFrame, s: Search, boosts: DataFrame | None = None) -> DataFrame:
    return finalize(score(candidates(capsules, vectors, s), s, boosts), s)


def ranking() -> tuple[Column, ...]:
    return F.desc("score"), F.desc("updated_at"), F.desc("version"), F.asc("capsule_id")


def anchors_of(scored: DataFrame) -> list[str]:
    """The graph nodes that the best rows stand for, before any floor."""
    best = scored.orderBy(*ranking()).limit(ANCHOR_ROWS).select(F.explode(anchor_nodes()).alias("node"))
    return sorted({r["node"] for r in best.collect()})  # a few nodes of a few rows


def reached_by_graph(capsules: DataFrame, rows: DataFrame, boosts: DataFrame, s: Search) -> DataFrame:
    """Boosted capsules that the candidates lack: active, unexpired, admissible, no diary, and no version that a candidate, or an active one of their own, supersedes."""
    mine = capsules.where(F.col("tenant") == s.tenant).join(boosts.select("capsule_id"), "capsule_id", "left_semi").join(rows.select("capsule_id"), "capsule_id", "left_anti")
    mine = mine.where("status = 'active'")
    replaced = rows.select("supersedes_id").unionAll(mine.select("supersedes_id")).where("supersedes_id is not null").select(F.col("supersedes_id").alias("capsule_id")).distinct()
    return mine.where(C.allowed_in_recall() & ~C.is_expired(s.now) & (F.col("capsule_type") != "diary")).join(replaced, "capsule_id", "left_anti")


def search_with_graph(capsules: DataFrame, vectors: DataFrame, edges: DataFrame, s: Search, dynamic: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """(ranked rows, edges walked): search in two passes. The best rows of the first are anchors; what a walk from them reaches is boosted in the second, and joins the candidates if it was none. With `dynamic`, boosts come
    over one step by strengths that decay, and the edges walked are returned to be potentiated. The candidates are written once, for both passes."""
    rows = cut(candidates(capsules, vectors, s))
    first = score(rows, s)
    anchors = anchors_of(first)
    if not anchors:
        return finalize(first, s), None
    boosts, walked = G.dynamic_boosts(edges, anchors, s.now) if dynamic else (G.walked_boosts(edges, anchors), None)
    boosts = cut(boosts.select(F.substring("node", len(G.CAPSULE_NODE) + 1, 1 << 30).alias("capsule_id"), F.col("boost").alias("graph_boost")))
    more = reached_by_graph(capsules, rows, boosts, s).withColumn("rrf", F.lit(None).cast(rows.schema["rrf"].dataType))
    return finalize(score(rows.unionByName(more.select(*rows.columns)), s, boosts), s), walked


def wake_up(capsules: DataFrame, s: Search, newest: int = 64) -> DataFrame:
    """Without a query: the newest live rows, those in scope first."""
    rows = C.recent_pool(capsules, s.tenant, newest).where(~C.is_expired(s.now))
    order = (F.when(C.matches_any_scope(s.scope_filters), 0).otherwise(1), F.desc("updated_at"), F.asc("capsule_id"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("tenant").orderBy(*order)))
