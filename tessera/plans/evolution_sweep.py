"""The evolution sweep: every detector over the living capsules of all tenants, and their proposals against the candidates that earlier sweeps have left.

State in, state out: a sweep reads capsules, first and further chunks of their vectors, edges, feedback and candidates, and gives the proposals of this sweep, what the gate says of each, and the candidates after it. A proposal that meets a pending
candidate of its kind with nearly its members (Jaccard .8) strengthens it; a candidate that none meets decays and goes once little is left; one that holds for `cycles` sweeps in a row is carried out. Candidates that were carried out or
accepted keep their proposal from coming back, apart from the recurring kinds. Members meet on shared members, siblings on shared anchors; no pairs are made within a cluster, apart from the batches of co-recall, of 12 at most.

Defined results: expired capsules and those that are not active take no part, nor do capsules without a vector in what is clustered. A tenant without capsules has no proposals, and its candidates decay. Two proposals that meet one candidate strengthen it once.
Ids of new candidates are made of their members and the sweep, so a sweep that is run again gives the same tables. Extra columns do no harm."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import fact_anchors
from tessera.functions.timefn import cutoff
from tessera.operators import mining as M
from tessera.operators.capsules import is_episodic, is_guidance, themes
from tessera.operators.evolution import procedural_siblings
from tessera.operators.graph import CAPSULE_NODE
from tessera.operators.storage import cut

# Fixed values of the detectors and of the gate.
ONE_SHOT = ("merge", "generalize", "refine", "split")
RECURRING = ("reweight_up", "reweight_decay")
DYING, ACTIVE_SHARE, MEAN_CONFIDENCE, SHARED_THEMES = 0.8, 0.5, 0.6, 2
REFINE_WINDOW_S, LEAST_OUTDATED = 30 * 86_400, 2
#: What the detectors of clusters read of a capsule; texts are not among it.
JUDGED = ("capsule_id", "tenant", "capsule_type", "topics", "tags", "confidence", "decay_score", "last_recalled_at")
CANDIDATES = "candidate_id string, tenant string, op_kind string, member_ids array<string>, params string, evidence double, cycles bigint, status string, first_proposed_at string, last_signal_at string, executed_at string"


@dataclass
class Sweep:
    now: str
    cluster_at: float = 0.82
    merge_at: float = 0.92
    split_at: float = 0.5
    generalize_from: int = 4
    interval_s: int = 24 * 3600
    cycles: int = 3
    decay: float = 0.7
    hysteresis: float = 0.5


def proposed(members: DataFrame, op: str | Column, params: Column | None = None, *keys: str) -> DataFrame:
    """tenant, op_kind, members, params: one proposal for each group of members (tenant, capsule_id)."""
    found = members.groupBy("tenant", *keys).agg(F.array_sort(F.collect_set("capsule_id")).alias("members"))
    return found.select("tenant", (F.lit(op) if isinstance(op, str) else op).alias("op_kind"), "members", (F.lit("{}") if params is None else params).alias("params"))


def merges(living: DataFrame, first: DataFrame, s: Sweep) -> DataFrame:
    """Capsules of one agent, project and repository that say nearly the same; where they are executions of one procedure (hardly an anchor in common), a workflow instead, if they are enough."""
    rows = living.where(~is_guidance())
    ids = rows.select("capsule_id", "tenant", "source_agent", "project", "repo", "supersedes_id")
    grouped = M.clusters(ids, first, s.merge_at, ("tenant", "source_agent", "project", "repo")).join(ids, "capsule_id")
    superseding = grouped.select("root", F.col("capsule_id").alias("supersedes_id"))
    free = grouped.join(superseding, ["root", "supersedes_id"], "left_anti")
    sizes = free.groupBy("root").agg(F.count("*").alias("size")).where("size >= 2")
    free = free.join(sizes, "root").select("tenant", F.col("root").alias("proposal_id"), "capsule_id", "size")
    # texts meet the members that are left, once, and stay behind
    texts = rows.select("capsule_id", "content", "code_refs", "topics", "tags")
    free = cut(free.join(texts, "capsule_id").select("tenant", "proposal_id", "capsule_id", "size", fact_anchors(F.col("content"), F.coalesce("code_refs", F.expr("CAST(array() AS array<string>)"))).alias("anchors"), themes().alias("themes")))
    kin = procedural_siblings(free).withColumn("kin", F.lit(True))
    told = free.join(kin, "proposal_id", "left").where(F.col("kin").isNull() | (F.col("size") >= s.generalize_from))
    return proposed(told, F.when(F.col("kin"), "workflow_generalize").otherwise("merge"), None, "proposal_id", "kin")


def generalizations(clustered: DataFrame, s: Sweep) -> DataFrame:
    """Episodes and experiences of one cluster that share themes, of good confidence on average."""
    roots = M.detect_generalize(clustered, s.generalize_from, SHARED_THEMES, MEAN_CONFIDENCE).select("root")
    return proposed(clustered.where(is_episodic()).join(roots, "root", "left_semi"), "generalize", None, "root")


def reweights(clustered: DataFrame, s: Sweep) -> DataFrame:
    """Up: clusters of two or more that are no guidance, more than half of which were recalled since the last sweep. Down: capsules alone in their cluster that were never recalled, unless guidance or dying."""
    recent = F.coalesce(F.col("last_recalled_at") >= cutoff(s.now, s.interval_s), F.lit(False))
    usual = clustered.where(~is_guidance())
    hot = usual.groupBy("root").agg(F.count("*").alias("n"), F.count_if(recent).alias("k")).where((F.col("n") >= 2) & (F.col("k") / F.col("n") > ACTIVE_SHARE)).select("root")
    alone = clustered.groupBy("root").agg(F.count("*").alias("n")).where("n = 1").select("root")
    idle = usual.where(F.col("last_recalled_at").isNull() & ~(F.col("decay_score") > DYING)).join(alone, "root", "left_semi")
    return proposed(usual.join(hot, "root", "left_semi"), "reweight_up", None, "root").unionByName(proposed(idle, "reweight_decay", None, "capsule_id"))


def splits(living: DataFrame, chunks: DataFrame, s: Sweep) -> DataFrame:
    """Capsules whose chunks lie in groups that are all far apart; no guidance, nothing dying."""
    rows = living.where(~is_guidance() & ~(F.col("decay_score") > DYING)).select("capsule_id", "tenant")
    apart = M.detect_split(chunks.join(rows.select("capsule_id"), "capsule_id", "left_semi"), s.cluster_at, s.split_at)
    return proposed(rows.join(apart.select("capsule_id"), "capsule_id", "left_semi"), "split", None, "capsule_id")


def refinements(living: DataFrame, edges: DataFrame, feedback: DataFrame, s: Sweep) -> DataFrame:
    """Capsules recalled lately that something speaks against: an open suspicion that another supersedes them, or `outdated` twice. No guidance, nothing dying."""
    valued = living.where(~is_guidance() & ~(F.col("decay_score") > DYING) & (F.col("last_recalled_at") >= cutoff(s.now, REFINE_WINDOW_S))).select("capsule_id", "tenant")
    suspected = edges.where("relation = 'suspected_supersede' and valid_to is null").select(F.regexp_replace("to_node", f"^{CAPSULE_NODE}", "").alias("capsule_id"), F.lit("suspected_supersede").alias("why"))
    outdated = feedback.where("kind = 'outdated'").groupBy("capsule_id").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_OUTDATED).select("capsule_id", F.format_string("%d outdated", "n").alias("why"))
    found = valued.join(suspected.unionByName(outdated).distinct(), "capsule_id").groupBy("tenant", "capsule_id").agg(F.array_sort(F.collect_set("why")).alias("why"))
    return found.select("tenant", F.lit("refine").alias("op_kind"), F.array("capsule_id").alias("members"), F.to_json(F.struct(F.col("why").alias("conflicts"))).alias("params"))


def corecalls(living: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs recalled in one batch that no active edge joins; params name the batch."""
    ends = [F.regexp_replace(c, f"^{CAPSULE_NODE}", "") for c in ("from_node", "to_node")]
    linked = edges.where("relation = 'co_recalled_with' and valid_to is null").select(ends[0].alias("a"), ends[1].alias("b"))
    pairs = M.corecall(living, linked)
    batch = living.select(F.col("capsule_id").alias("a"), "tenant", "last_recalled_at")
    return pairs.join(batch, "a").select("tenant", F.lit("corecall").alias("op_kind"), F.array("a", "b").alias("members"), F.to_json(F.struct(F.col("last_recalled_at").alias("batch_ts"))).alias("params"))


def proposals(capsules: DataFrame, vectors: DataFrame, edges: DataFrame, feedback: DataFrame, s: Sweep) -> DataFrame:
    """tenant, op_kind, members, params: what all detectors propose. vectors: capsule_id, chunk, embedding. Written, as every step after it reads it."""
    living = capsules.where((F.col("status") == "active") & ~F.coalesce(F.col("expires_at") <= s.now, F.lit(False)))
    mapped = vectors.join(living.select("capsule_id"), "capsule_id", "left_semi")
    first = mapped.where("chunk = 0").select("capsule_id", "embedding")
    clustered = cut(M.clusters(living, first, s.cluster_at, ("tenant",)).join(living.select(*JUDGED), "capsule_id"))
    found = merges(living, first, s)
    for more in (generalizations(clustered, s), reweights(clustered, s), splits(living, mapped, s), refinements(living, edges, feedback, s), corecalls(living, edges)):
        found = found.unionByName(more)
    return cut(found)


def keyed(found: DataFrame) -> DataFrame:
    """proposals with an id, and with the tenant in their kind: candidates of another tenant are never met."""
    name = F.sha2(F.concat_ws("\x1f", "tenant", "op_kind", F.array_join("members", "\x1e"), "params"), 256)
    return found.select("*", name.alias("proposal_id"), F.concat_ws("/", "tenant", "op_kind").alias("kind"))


def met(found: DataFrame, candidates: DataFrame) -> DataFrame:
    """proposal_id, candidate_id of the best match of each proposal."""
    p = found.select("proposal_id", F.col("kind").alias("op_kind"), "members")
    c = candidates.select("candidate_id", F.concat_ws("/", "tenant", "op_kind").alias("op_kind"), "member_ids")
    return M.match_candidates(p, c).select("proposal_id", "candidate_id")


def reconcile(found: DataFrame, candidates: DataFrame, s: Sweep) -> tuple[DataFrame, DataFrame]:
    """(decisions, candidates after the sweep). decisions: candidate_id, op_kind, members, decision (execute, hold, cancel)."""
    p = keyed(found)
    status = lambda *names: candidates.where(F.col("status").isin(*names))
    settled = met(p.where(F.col("op_kind").isin(*ONE_SHOT)), status("executed", "accepted"))
    spent = status("cancelled").where("op_kind = 'corecall'").select("tenant", "op_kind", F.col("member_ids").alias("members"), "params").distinct()
    p = p.join(settled.select("proposal_id"), "proposal_id", "left_anti").join(spent, ["tenant", "op_kind", "members", "params"], "left_anti")
    pending = status("pending")
    matched = met(p, pending).join(p.select("proposal_id", "op_kind", F.col("params").alias("new_params")), "proposal_id").join(pending.select("candidate_id", "params"), "candidate_id")
    stale = (F.col("op_kind") == "corecall") & F.col("params").eqNullSafe(F.col("new_params"))  # the same batch seen again is no news
    signals = matched.where(~stale).groupBy("candidate_id").agg(F.max("new_params").alias("new_params"))
    new = p.join(matched.select("proposal_id"), "proposal_id", "left_anti")

    heard = pending.join(signals, "candidate_id", "left").withColumn("heard", F.col("new_params").isNotNull())
    evidence = s.decay * F.col("evidence") + F.when(F.col("heard"), 1.0).otherwise(0.0)
    moved = heard.withColumns({
        "evidence": evidence, "cycles": F.when(F.col("heard"), F.col("cycles") + 1).otherwise(F.lit(0)), "last_signal_at": F.when(F.col("heard"), F.lit(s.now)).otherwise(F.col("last_signal_at")),
        "params": F.when(F.col("heard") & (F.col("op_kind") == "corecall"), F.col("new_params")).otherwise(F.col("params")),
    })
    made = new.select(
        F.concat(F.lit("evo_"), F.substring(F.sha2(F.concat_ws("\x1f", "proposal_id", F.lit(s.now)), 256), 1, 24)).alias("candidate_id"), "tenant", "op_kind", F.col("members").alias("member_ids"), "params", F.lit(1.0).alias("evidence"), F.lit(1).cast("bigint").alias("cycles"),
        F.lit("pending").alias("status"), F.lit(s.now).alias("first_proposed_at"), F.lit(s.now).alias("last_signal_at"), F.lit(None).cast("string").alias("executed_at"), F.lit(True).alias("heard"),
    )
    names = [c.split()[0] for c in CANDIDATES.split(", ")]
    judged = moved.select(*names, "heard").unionByName(made)
    decision = F.when(F.col("heard") & (F.col("cycles") >= s.cycles), "execute").when(~F.col("heard") & (F.col("evidence") < s.hysteresis), "cancel").otherwise("hold")
    judged = cut(judged.withColumn("decision", decision))
    after = judged.withColumns({
        "status": F.when((F.col("decision") == "execute") & ~F.col("op_kind").isin(*RECURRING), "executed").when(F.col("decision") == "cancel", "cancelled").otherwise(F.col("status")),
        "executed_at": F.when(F.col("decision") == "execute", F.lit(s.now)).otherwise(F.col("executed_at")),
    })
    rest = candidates.where(~F.col("status").eqNullSafe(F.lit("pending"))).select(*names)
    return judged.select("candidate_id", "tenant", "op_kind", F.col("member_ids").alias("members"), "decision"), cut(after.select(*names).unionByName(rest))


def sweep(capsules: DataFrame, vectors: DataFrame, edges: DataFrame, feedback: DataFrame, candidates: DataFrame, s: Sweep) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(proposals, decisions, candidates): one sweep. What is decided is carried out by operators.evolution; a dry run looks at the first two alone."""
    found = proposals(capsules, vectors, edges, feedback, s)
    return found, *reconcile(found, candidates, s)
