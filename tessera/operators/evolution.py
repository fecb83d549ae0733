"""What a sweep decides, carried out: each function takes tables and returns the rows that change or are added."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import overlap
from tessera.operators.set_match import best_match
from tessera.operators.storage import first_of_each, update_where
from tessera.schemas import FEEDBACK

# Fixed values of the sweeps.
DECAY_CAP, SKIP_DECAY, VETO_FLOOR, SIBLING_OVERLAP = 0.9, 0.8, 0.5, 0.2
COMPILE_OVERLAP = 0.5


def node(c: Column) -> Column:
    return F.concat(F.lit("capability_capsule:"), c)


def lineage(rows: DataFrame, from_id: str, to_id: str, relation: str, now: str) -> DataFrame:
    return rows.select(node(F.col(from_id)).alias("from_node"), node(F.col(to_id)).alias("to_node"), F.lit(relation).alias("relation"), F.lit(now).alias("valid_from"), F.lit(None).cast("string").alias("valid_to"), F.lit("evolution").alias("extractor"))


def survivors(members: DataFrame, capsules: DataFrame) -> DataFrame:
    """members (proposal_id, capsule_id) -> with survivor: the longest content, then the earliest."""
    rows = members.join(capsules.select("capsule_id", "content", "created_at"), "capsule_id")
    best = first_of_each(rows, ["proposal_id"], F.desc(F.octet_length("content")), F.asc("created_at"), F.asc("capsule_id")).select("proposal_id", F.col("capsule_id").alias("survivor"))
    return members.join(best, "proposal_id")


def execute_merge(capsules: DataFrame, members: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """Capsules with the losers archived, and the merged_into edges."""
    losers = survivors(members, capsules).where("capsule_id <> survivor")
    hit = losers.select("capsule_id", F.lit(True).alias("hit_")).distinct()
    out = update_where(capsules.join(hit, "capsule_id", "left"), F.col("hit_"), status=F.lit("archived"), updated_at=F.lit(now)).select(*capsules.columns)
    return out, lineage(losers, "capsule_id", "survivor", "merged_into", now)


def rollback_merge(capsules: DataFrame, edges: DataFrame, members: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """The losers are active again, their merged_into edges closed."""
    ids = members.select("capsule_id").distinct()
    mine = edges.where("relation = 'merged_into' and valid_to is null").join(ids.select(node(F.col("capsule_id")).alias("from_node")), "from_node", "left_semi").select("from_node", "to_node", "relation", F.lit(True).alias("hit_"))
    reopened = mine.select(F.regexp_replace("from_node", "^capability_capsule:", "").alias("capsule_id"), "hit_").distinct()
    c = update_where(capsules.join(reopened, "capsule_id", "left"), F.col("hit_") & (F.col("status") == "archived"), status=F.lit("active"), updated_at=F.lit(now)).select(*capsules.columns)
    e = update_where(edges.join(mine, ["from_node", "to_node", "relation"], "left"), F.col("hit_") & F.col("valid_to").isNull(), valid_to=F.lit(now)).select(*edges.columns)
    return c, e


PLACEHOLDER_KINDS = ("generalize", "workflow_generalize", "refine", "split")


def rollback(capsules: DataFrame, edges: DataFrame, candidates: DataFrame, now: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(verdicts, capsules, edges, candidates). candidates: candidate_id, op_kind, member_ids, result_ids, status; all of them are asked to roll back.

    A merge: losers are active again and their merged_into edges close. A proposal: it is archived and all its edges close. A link of rows recalled together: it
    closes. Only executed candidates roll back; moves of weight are undone by their feedback, not here."""
    result, kind = F.try_element_at("result_ids", F.lit(1)), F.col("op_kind")
    pair = F.size("member_ids") >= 2
    verdict = (
        F.when(F.col("status") != "executed", "not_executed").when(kind == "merge", F.when(result.isNotNull(), "rolled_back").otherwise("no_result")).when(kind.isin(*PLACEHOLDER_KINDS), F.when(result.isNotNull(), "rolled_back").otherwise("no_result"))
        .when(kind == "corecall", F.when(pair, "rolled_back").otherwise("no_pair")).when(kind.isin("reweight_up", "reweight_decay"), "recurring").otherwise("unknown_kind")
    )
    judged = candidates.withColumn("verdict", verdict)
    back = judged.where("verdict = 'rolled_back'").withColumn("result", result)
    losers = back.where("op_kind = 'merge'").select(F.explode("member_ids").alias("capsule_id"), "result").where("capsule_id <> result")
    proposals = back.where(kind.isin(*PLACEHOLDER_KINDS)).select(F.col("result").alias("capsule_id"))
    change = losers.select("capsule_id", F.lit("active").alias("s_")).unionAll(proposals.select("capsule_id", F.lit("archived").alias("s_"))).groupBy("capsule_id").agg(F.max("s_").alias("s_"))
    out = update_where(capsules.join(change, "capsule_id", "left"), F.col("s_").isNotNull(), status=F.col("s_"), updated_at=F.lit(now)).select(*capsules.columns)
    key = ["from_node", "to_node", "relation"]
    ends = lambda rows, a, b, relation: rows.select(node(F.col(a)).alias("from_node"), node(F.col(b)).alias("to_node"), F.lit(relation).alias("relation"))
    pairs = back.where(kind == "corecall").select(F.try_element_at("member_ids", F.lit(1)).alias("a"), F.try_element_at("member_ids", F.lit(2)).alias("b"))
    named = ends(losers, "capsule_id", "result", "merged_into").unionAll(ends(pairs, "a", "b", "co_recalled_with"))
    nodes = proposals.select(node(F.col("capsule_id")).alias("n")).distinct()
    live = edges.where("valid_to is null")
    touched = live.join(nodes, live["from_node"] == nodes["n"], "left_semi").select(*key).unionAll(live.join(nodes, live["to_node"] == nodes["n"], "left_semi").select(*key))
    hit = named.unionAll(touched).distinct().withColumn("hit_", F.lit(True))
    closed = update_where(edges.join(hit, key, "left"), F.col("hit_") & F.col("valid_to").isNull(), valid_to=F.lit(now)).select(*edges.columns)
    state = judged.withColumn("status", F.when(F.col("verdict") == "rolled_back", "rolled_back").otherwise(F.col("status"))).select(*candidates.columns)
    return judged.select("candidate_id", "verdict"), out, closed, state


def execute_reweight(capsules: DataFrame, moves: DataFrame) -> DataFrame:
    """moves (capsule_id, way): up raises confidence, decay raises decay (to .9 at most); far decayed rows stay."""
    up, down = FEEDBACK["system_reweight_up"][0], FEEDBACK["system_reweight_decay"][1]
    way = moves.groupBy("capsule_id").agg(F.max("way").alias("way_"))
    rows = capsules.join(way, "capsule_id", "left").withColumn("open_", F.col("way_").isNotNull() & (F.col("decay_score") <= SKIP_DECAY))
    confidence = F.when(F.col("open_") & (F.col("way_") == "up"), F.least(F.lit(1.0), F.col("confidence") + up)).otherwise(F.col("confidence"))
    decay = F.when(F.col("open_") & (F.col("way_") == "decay"), F.least(F.lit(DECAY_CAP), F.col("decay_score") + down)).otherwise(F.col("decay_score"))
    return rows.select(*(confidence.alias(c) if c == "confidence" else decay.alias(c) if c == "decay_score" else F.col(c) for c in capsules.columns))


def corecall_edges(pairs: DataFrame, now: str) -> DataFrame:
    return lineage(pairs, "a", "b", "co_recalled_with", now).withColumn("access_count", F.lit(1).cast("bigint"))


def prune_idle(edges: DataFrame, capsules: DataFrame, relation: str, cutoff: str, now: str) -> DataFrame:
    """Active edges of a relation whose latest activity is before the cutoff and of which an end is a known active capsule are closed."""
    known = capsules.where("status = 'active'").select(node(F.col("capsule_id")).alias("n")).distinct()
    activity = F.greatest(F.coalesce("last_activated", F.lit("")), "valid_from")
    idle = edges.where((F.col("relation") == relation) & F.col("valid_to").isNull() & (activity < cutoff))
    key = ["from_node", "to_node", "relation"]
    hit = idle.join(known, idle["from_node"] == known["n"], "left_semi").select(*key).unionByName(idle.join(known, idle["to_node"] == known["n"], "left_semi").select(*key)).distinct().withColumn("hit_", F.lit(True))
    return update_where(edges.join(hit, key, "left"), F.col("hit_") & F.col("valid_to").isNull() & (activity < cutoff), valid_to=F.lit(now)).select(*edges.columns)


def placeholders(members: DataFrame, capsules: DataFrame, op: str, relation: str, now: str) -> tuple[DataFrame, DataFrame]:
    """One pending proposal for each proposal's members, with edges to them. The id is made from the members, so a rerun makes the same one."""
    listed = members.groupBy("proposal_id").agg(F.array_sort(F.collect_set("capsule_id")).alias("sources")).withColumn("capsule_id", F.concat(F.lit("evo_"), F.substring(F.sha2(F.concat_ws("\x1f", F.lit(op), F.col("sources")), 256), 1, 16)))
    first = members.join(capsules.select("capsule_id", "tenant", "project"), "capsule_id").groupBy("proposal_id").agg(F.min("tenant").alias("tenant"), F.min("project").alias("project"))
    made = listed.join(first, "proposal_id").select("capsule_id", "tenant", "project", F.lit("pending_confirmation").alias("status"), F.format_string(f"{op} placeholder, pending review. Sources: %s", F.array_join("sources", ", ")).alias("content"), F.lit(now).alias("created_at"))
    edges = listed.select("capsule_id", F.explode("sources").alias("source"))
    return made, lineage(edges, "capsule_id", "source", relation, now)


def rerank_veto(pairs: DataFrame, floor: float = VETO_FLOOR) -> DataFrame:
    """pairs (proposal_id, forward, backward): proposals one of whose pairs scores under the floor both ways together (geometric mean)."""
    return pairs.groupBy("proposal_id").agg(F.min(F.sqrt(F.col("forward") * F.col("backward"))).alias("worst")).where(F.col("worst") < floor)


def procedural_siblings(members: DataFrame) -> DataFrame:
    """proposal_id of clusters whose members all have anchors and share next to none. Members meet on the anchors that they share, so a pair that shares none costs nothing.

    One anchor in common is too much where one of the two has few: such clusters are told by counting, and make no pairs."""
    anchored = members.groupBy("proposal_id").agg(F.min(F.size("anchors")).alias("least"), F.count("*").alias("n")).where("least > 0 and n > 1").select("proposal_id")
    a = members.join(anchored, "proposal_id").select("proposal_id", "capsule_id", F.size(F.array_distinct("anchors")).alias("size"), F.explode(F.array_distinct("anchors")).alias("anchor"))
    met = a.groupBy("proposal_id", "anchor").agg(F.min("size").alias("size"), F.min("capsule_id").alias("one"), F.max("capsule_id").alias("other")).where("one < other")
    alike = met.where(1 / F.col("size") > SIBLING_OVERLAP).select("proposal_id").distinct()
    shared = a.join(alike, "proposal_id", "left_anti").join(met.select("proposal_id", "anchor"), ["proposal_id", "anchor"], "left_semi")
    pairs = shared.join(shared.select("proposal_id", "anchor", F.col("capsule_id").alias("other"), F.col("size").alias("other_size")), ["proposal_id", "anchor"]).where("capsule_id < other")
    close = pairs.groupBy("proposal_id", "capsule_id", "other").agg(F.count("*").alias("common"), F.min(F.least("size", "other_size")).alias("least")).where(F.col("common") / F.col("least") > SIBLING_OVERLAP)
    return anchored.join(alike.unionByName(close.select("proposal_id")).distinct(), "proposal_id", "left_anti")


def supersede_target(proposals: DataFrame, existing: DataFrame, floor: float = COMPILE_OVERLAP) -> DataFrame:
    """The existing workflow whose members overlap a proposal's most (floor or more; the newest of equals). Equal sets of members meet once, others by their rarest members."""
    asks = proposals.select(F.col("proposal_id").alias("ask"), F.lit("").alias("kind"), "members")
    offers = existing.select(F.col("capsule_id").alias("offer"), F.lit("").alias("kind"), "members", F.col("created_at").alias("made"))
    return best_match(asks, offers, floor, overlap, by_smaller=True).select(F.col("ask").alias("proposal_id"), F.col("offer").alias("target"), "score")


def successor(original: DataFrame, content: Column, new_id: Column, now: str) -> DataFrame:
    """An edited row's next version: active, trusted, superseding the original."""
    return original.withColumns({"supersedes_id": F.col("capsule_id"), "capsule_id": new_id, "version": F.col("version") + 1, "status": F.lit("active"), "confidence": F.lit(0.9), "content": content, "created_at": F.lit(now), "updated_at": F.lit(now)})


def edit_and_accept(capsules: DataFrame, tenant: str, capsule_id: str, content: str, new_id: str, now: str) -> DataFrame:
    """The table with the pending row rejected and its successor added."""
    hit = (F.col("tenant") == tenant) & (F.col("capsule_id") == capsule_id) & (F.col("status") == "pending_confirmation")
    new = successor(capsules.where(hit), F.lit(content), F.lit(new_id), now)
    return update_where(capsules, hit, status=F.lit("rejected"), updated_at=F.lit(now)).unionByName(new.select(*capsules.columns))


# candidate jobs ----------------------------------------------------------------------------------------------------


def invalid_jobs(jobs: DataFrame, refs: DataFrame, evidence: DataFrame, version: int, now: str) -> DataFrame:
    """Open jobs without a live lease whose trigger version has passed or one of whose refs has no evidence."""
    lost = refs.join(evidence.select("evidence_key").distinct(), "evidence_key", "left_anti").select("job_id").distinct().withColumn("lost_", F.lit(True))
    open_ = ~F.col("status").isin("completed", "stale", "dead_letter") & ~F.coalesce(F.col("lease_expires_at") > now, F.lit(False))
    return jobs.where(open_).join(lost, "job_id", "left").where((F.col("trigger_version") != version) | F.coalesce("lost_", F.lit(False))).select("job_id")


def reactivatable_jobs(jobs: DataFrame, refs: DataFrame, evidence: DataFrame, version: int) -> DataFrame:
    """Stale jobs of the current version all of whose refs have evidence (a division, by counts)."""
    there = refs.join(evidence.select("evidence_key").distinct().withColumn("there", F.lit(1)), "evidence_key", "left").groupBy("job_id").agg(F.count("*").alias("n"), F.count("there").alias("k")).where("n = k")
    return jobs.where((F.col("status") == "stale") & (F.col("trigger_version") == version)).join(there, "job_id", "left_semi").select("job_id")


def renew_lease(jobs: DataFrame, job_id: str, token: str, now: str, until: str, most: int = 2) -> DataFrame:
    """Two renewals at most, by the holder of an unexpired lease."""
    hit = (F.col("job_id") == job_id) & (F.col("lease_token") == token) & (F.col("lease_expires_at") > now) & (F.col("renewals") < most)
    return update_where(jobs, hit, lease_expires_at=F.lit(until), renewals=F.col("renewals") + 1)


def complete_leased(jobs: DataFrame, job_id: str, token: str, now: str) -> DataFrame:
    hit = (F.col("job_id") == job_id) & (F.col("lease_token") == token) & (F.col("lease_expires_at") > now)
    return update_where(jobs, hit, status=F.lit("completed"), updated_at=F.lit(now))
