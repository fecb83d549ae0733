"""Integer scores of recall, each rule one column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.timefn import lenient_ms
from tessera.operators.capsules import parse_scope_filters, scope_matches

# Ranks fuse with this constant, and scores have these weights.
RRF_K = 60
INTENT_SCORES = {
    "debug": {"experience": 10, "implementation": 8, "episode": 7, "workflow": 5, "preference": 1, "diary": 0},
    "workflow": {"workflow": 10, "experience": 6, "implementation": 4, "episode": 5, "preference": 1, "diary": 0},
    "default": {"preference": 8, "workflow": 7, "experience": 6, "implementation": 5, "episode": 4, "diary": 0},
}


def half_up(x: Column) -> Column:
    return F.round(x).cast("bigint")


def rrf(rank: Column) -> Column:
    """A rank's share, in thousandths, rounded alone."""
    return half_up(F.lit(1000.0) / (F.lit(RRF_K) + rank))


def rrf_raw(rank: Column) -> Column:
    return F.coalesce(F.lit(1.0) / (F.lit(RRF_K) + rank), F.lit(0.0))


def confidence_score(c: Column) -> Column:
    return half_up(c * 10)


def staleness_penalty(d: Column) -> Column:
    return half_up(d * 12)


def validation_score(validated_at: Column) -> Column:
    return F.when(validated_at.isNotNull(), 3).otherwise(0).cast("bigint")


def freshness_score(newest: Column, current: Column) -> Column:
    """6 for the newest; a point less for every ten seconds, 20 at most."""
    return F.lit(6) - F.least(F.lit(20), F.floor((newest - current) / 10000)).cast("bigint")


def freshness_anchor() -> Column:
    used = lenient_ms(F.coalesce(F.col("last_used_at"), F.lit("")))
    return F.when(used > 0, used).otherwise(lenient_ms(F.col("updated_at"))).cast("bigint")


def type_score(capsule_type: Column, intent: str) -> Column:
    table = INTENT_SCORES["debug" if "debug" in intent.lower() else "workflow" if "workflow" in intent.lower() else "default"]
    out = F.lit(0)
    for name, score in table.items():
        out = F.when(capsule_type == name, score).otherwise(out)
    return out.cast("bigint")


def scope_score(filters: list[str]) -> Column:
    if not filters:
        return F.when(F.col("scope") == "project", 2).when(F.col("scope") == "repo", 4).when(F.col("scope") == "workspace", 3).otherwise(0).cast("bigint")
    out = F.lit(0)
    for kind, values in parse_scope_filters(filters).items():
        hit = F.lit(False)
        for v in values:
            hit = hit | scope_matches(F.lit(kind), F.lit(v))
        out = out + F.when(hit, 18).otherwise(-4)
    return out.cast("bigint")


def text_match_score(terms: list[str]) -> Column:
    """Per term: any field 4, summary 8, content 6, code references 3, tags 3, project, repo and module 2 each."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    fields = {"summary": low(F.col("summary")), "content": low(F.col("content")), "refs": low(F.array_join("code_refs", " ")), "tags": low(F.array_join("tags", " "))} | {c: low(F.col(c)) for c in ("project", "repo", "module")}
    weight = {"summary": 8, "content": 6, "refs": 3, "tags": 3, "project": 2, "repo": 2, "module": 2}
    out = F.lit(0)
    for t in terms:
        anywhere = F.lit(False)
        for name, field in fields.items():
            hit = F.contains(field, F.lit(t))
            anywhere = anywhere | hit
            out = out + F.when(hit, weight[name]).otherwise(0)
        out = out + F.when(anywhere, 4).otherwise(0)
    return out.cast("bigint")


def lifecycle_score(newest: Column, terms: list[str], filters: list[str], intent: str, graph_boost: Column) -> Column:
    unsettled = F.when(F.col("status").isin("provisional", "pending_confirmation"), -4).otherwise(0)
    return (
        text_match_score(terms) + scope_score(filters) + type_score(F.col("capsule_type"), intent) + confidence_score(F.col("confidence")) + validation_score(F.col("last_validated_at")) - staleness_penalty(F.col("decay_score"))
        + freshness_score(newest, freshness_anchor()) + F.coalesce(graph_boost, F.lit(0)) + unsettled
    ).cast("bigint")


def spread_decay(degree: Column) -> Column:
    return 1.0 / (1.0 + 0.001 * F.pow(degree - 1, F.lit(2.0)))


def decayed_strength(strength: Column, stability: Column, days: Column) -> Column:
    return F.greatest(F.lit(0.05), strength * F.exp(-days / stability))
