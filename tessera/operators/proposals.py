"""Skill proposals: the catalogue that a compiler sees, its replies read and settled, proposals published, reviewed, accepted and fetched.

Set-oriented: each function takes all replies, requests or jobs at once and returns one verdict a row; what a verdict lets land is in the tables returned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.text import SECRETS, collapse, normalize_alias, parameterize, redact, steps, trimmed
from tessera.operators import queue as Q
from tessera.operators.skills import draft_valid
from tessera.operators.storage import append_new, first_of_each, replace_by_key, update_where

# Bounds of replies and of the catalogue.
MOST_TITLE, MOST_STEP, MOST_STEPS, MOST_PARAMETERS = 160, 500, 32, 16
CATALOGUE, CATALOGUE_TITLE, CATALOGUE_STEP, CATALOGUE_STEPS = 32, 160, 240, 12
CLASSES = ("skill", "fact", "preference", "experience", "none")


def signature(title: Column, listed: Column) -> Column:
    """Equal for drafts that differ in case and white space alone."""
    return F.sha2(F.concat_ws("\x1e", normalize_alias(title), F.array_join(F.transform(listed, normalize_alias), "\x1f")), 256)


def catalogue(capsules: DataFrame, bundles: DataFrame, bounded: bool = True) -> DataFrame:
    """Active and pending workflows with their bundle, secrets masked, texts bounded for a prompt."""
    rows = capsules.where((F.col("capsule_type") == "workflow") & F.col("status").isin("active", "pending_confirmation"))
    title, listed = redact(F.col("summary")), F.transform(steps(F.col("content")), lambda x: redact(x))
    if bounded:
        title = F.substring(collapse(title), 1, CATALOGUE_TITLE)
        listed = F.transform(F.slice(listed, 1, CATALOGUE_STEPS), lambda x: F.substring(collapse(x), 1, CATALOGUE_STEP))
    held = bundles.groupBy("tenant", "capsule_id").agg(F.min_by(F.struct("skill_id", "version_id"), "version_id").alias("b"))
    out = rows.select("tenant", "capsule_id", "status", title.alias("title"), listed.alias("steps")).join(held, ["tenant", "capsule_id"], "left")
    return out.select("tenant", "capsule_id", "status", "title", "steps", F.col("b.skill_id").alias("skill_id"), F.col("b.version_id").alias("version_id"), signature(F.col("title"), F.col("steps")).alias("signature"))


def shortlist(entries: DataFrame, tenant: str, required: str | None = None, limit: int = CATALOGUE) -> DataFrame:
    """The first entries by id, the required one before all: a top-k."""
    first = F.when(F.col("capsule_id") == F.lit(required), 0).otherwise(1)
    return entries.where(F.col("tenant") == tenant).orderBy(first, "capsule_id").limit(limit)


def has_secret(text: Column) -> Column:
    out = F.lit(False)
    for pattern, _ in SECRETS:
        out = out | text.rlike(pattern)
    return out


REPLY = "struct<decision: string, reason: string, existing_id: string, artifact_class: string, title: string, steps: array<string>, parameters: array<struct<name: string>>>"


def compile_replies(replies: DataFrame, entries: DataFrame) -> DataFrame:
    """replies (job_id, tenant, reply) with `decision`: nothing, duplicate, update, classified, propose, or why not (unsafe, invalid); target and draft.

    Ids that a reply names must be in the tenant's catalogue; a draft equal to an entry is a duplicate of it."""
    parsed = replies.withColumn("r", F.from_json("reply", REPLY))
    line = lambda c, most: F.when((trimmed(c) != "") & (F.char_length(trimmed(c)) <= most) & ~c.contains("\n"), trimmed(c))
    rows = parsed.withColumn("title", line(parameterize(F.col("r.title")), MOST_TITLE)).withColumn("steps", F.transform("r.steps", lambda x: line(parameterize(x), MOST_STEP)))
    names = F.transform("r.parameters", lambda p: p["name"])
    declared = F.coalesce(names, F.expr("CAST(array() AS array<string>)"))
    bounded = F.col("title").isNotNull() & F.size("steps").between(1, MOST_STEPS) & (F.size(declared) <= MOST_PARAMETERS) & ~F.exists("steps", lambda x: x.isNull())
    unique = (F.size(F.array_distinct(declared)) == F.size(declared)) & ~F.exists(declared, lambda x: x.isNull() | ~x.rlike("^[a-z][a-z0-9_]*$"))
    rows = rows.withColumn("sound", F.coalesce(bounded & unique & draft_valid(F.col("steps"), declared), F.lit(False)))
    rows = rows.withColumn("signature", F.when(F.col("sound"), signature(F.col("title"), F.col("steps"))))
    named = entries.select("tenant", F.col("capsule_id").alias("named"), F.col("skill_id").alias("named_skill"), F.col("version_id").alias("named_version"), F.col("signature").alias("named_signature"))
    equal = entries.groupBy("tenant", "signature").agg(F.min("capsule_id").alias("equal"))
    joined = rows.join(named, (rows["tenant"] == named["tenant"]) & (F.col("r.existing_id") == F.col("named")), "left").drop(named["tenant"]).join(equal, ["tenant", "signature"], "left")
    said = F.col("r.decision")
    decision = (
        F.when(has_secret(F.col("reply")), "unsafe").when(F.col("r").isNull() | said.isNull(), "invalid")
        .when(said == "nothing_to_save", F.when(line(F.col("r.reason"), MOST_STEP).isNotNull(), "nothing").otherwise("invalid"))
        .when(said == "duplicate", F.when(F.col("named").isNotNull(), "duplicate").otherwise("invalid"))
        .when(said == "propose_update", F.when(F.col("named_skill").isNotNull() & F.col("sound"), "update").otherwise("invalid"))
        .when((said == "artifact") & (F.col("r.artifact_class") == "skill"), F.when(~F.col("sound"), "invalid").when(F.col("equal").isNotNull(), "duplicate").otherwise("propose"))
        .when((said == "artifact") & F.col("r.artifact_class").isin(*CLASSES), "classified").otherwise("invalid")
    )
    judged = joined.withColumn("decision", F.coalesce(decision, F.lit("invalid")))
    target = F.when(F.col("decision").isin("duplicate", "update"), F.coalesce("named", "equal"))
    draft = lambda c: F.when(F.col("decision").isin("propose", "update"), F.col(c))
    return judged.select(
        "job_id", "tenant", "decision", target.alias("target"), F.when(F.col("decision") == "update", F.col("named_skill")).alias("skill_id"), F.when(F.col("decision") == "update", F.col("named_version")).alias("base_version"),
        draft("title").alias("title"), draft("steps").alias("steps"), F.when(F.col("decision") == "duplicate", F.coalesce("named_signature", "signature")).when(F.col("decision").isin("propose", "update"), F.col("signature")).alias("signature"),
    )


def holds_lease(now: str) -> Column:
    """Whether a request's lease (lease) is the one its job (job_lease, lease_expires_at) still has."""
    return F.coalesce((F.col("status") == "processing") & (F.col("lease") == F.col("job_lease")) & (F.col("lease_expires_at") > now), F.lit(False))


def claim_compilations(jobs: DataFrame, evidence: DataFrame, entries: DataFrame, now: str, most_attempts: int, n: int) -> DataFrame:
    """The next n jobs with their evidence (refs in order) and how many entries of the catalogue their tenant offers."""
    picked = Q.claim(jobs, now, most_attempts, n).select("job_id", "tenant", "available_at")
    refs = evidence.join(picked.select("job_id"), "job_id", "left_semi").groupBy("job_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ref"))), lambda x: x["ref"]).alias("refs"))
    offered = entries.groupBy("tenant").agg(F.least(F.count("*"), F.lit(CATALOGUE)).alias("offered"))
    return picked.join(refs, "job_id", "left").join(offered, "tenant", "left").select("job_id", "tenant", "available_at", F.coalesce("refs", F.expr("CAST(array() AS array<string>)")).alias("refs"), F.coalesce("offered", F.lit(0)).alias("offered"))


def settle_decisions(requests: DataFrame, decisions: DataFrame, jobs: DataFrame, now: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(outcomes, decisions, jobs). requests: job_id, tenant, lease, decision, target. One terminal receipt a job: a request like the stored one is a replay, another one a
    conflict; without the job's lease it is refused."""
    first = first_of_each(requests, ["job_id"], F.asc("decision"), F.asc_nulls_first("target"))
    known = decisions.select("job_id", F.col("decision").alias("k_decision"), F.col("target").alias("k_target"))
    held = jobs.select("job_id", "status", "job_lease", "lease_expires_at")
    joined = first.join(known, "job_id", "left").join(held, "job_id", "left")
    same = (F.col("decision") == F.col("k_decision")) & F.col("target").eqNullSafe(F.col("k_target"))
    outcome = F.when(F.col("status").isNull(), "not_found").when(F.col("k_decision").isNotNull(), F.when(same, "replayed").otherwise("conflict")).when(holds_lease(now), "settled").otherwise("no_lease")
    out = joined.withColumn("outcome", outcome)
    stored = decisions.unionByName(out.where("outcome = 'settled'").select("job_id", "tenant", "decision", "target", F.lit(now).alias("decided_at")))
    done = out.where(F.col("outcome").isin("settled", "replayed") & holds_lease(now)).select("job_id", F.lit(True).alias("hit_"))
    return out.select("job_id", "outcome"), stored, update_where(jobs.join(done, "job_id", "left"), F.col("hit_"), status=F.lit("completed"), updated_at=F.lit(now)).select(*jobs.columns)


def publish(requests: DataFrame, proposals: DataFrame, jobs: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """(outcomes, proposals). requests: job_id, tenant, lease, signature, title, steps, skill_id, base_version. One proposal a job, under its lease; the same one again is a replay."""
    first = first_of_each(requests, ["job_id"], F.asc("signature"))
    known = proposals.select("job_id", F.col("signature").alias("k_signature"))
    joined = first.join(known, "job_id", "left").join(jobs.select("job_id", "status", "job_lease", "lease_expires_at"), "job_id", "left")
    outcome = F.when(F.col("status").isNull(), "not_found").when(F.col("k_signature").isNotNull(), F.when(F.col("k_signature") == F.col("signature"), "replayed").otherwise("conflict")).when(holds_lease(now), "published").otherwise("no_lease")
    out = joined.withColumn("outcome", outcome)
    new = out.where("outcome = 'published'").select(
        F.concat(F.lit("prop_"), F.col("job_id").cast("string")).alias("proposal_id"), "job_id", "tenant", "signature", "title", "steps", "skill_id", "base_version", F.lit("pending_confirmation").alias("status"), F.lit(now).alias("updated_at")
    )
    return out.select("job_id", "outcome"), proposals.unionByName(new)


def accept(requests: DataFrame, proposals: DataFrame, heads: DataFrame, versions: DataFrame, now: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(outcomes, proposals, heads, versions). requests: tenant, proposal_id, expected_head. A pending proposal whose base is both what the reviewer saw and the skill's head becomes a
    version, and the head moves to it; one whose base is no longer the head needs a rebase; an accepted one again is a replay."""
    asked = requests.dropDuplicates(["tenant", "proposal_id"])
    rows = asked.join(proposals, ["tenant", "proposal_id"], "left").withColumn("skill", F.coalesce("skill_id", F.concat(F.lit("skill_"), F.substring(F.sha2("proposal_id", 256), 1, 16))))
    now_at = heads.select("tenant", F.col("skill_id").alias("skill"), F.col("version_id").alias("head"))
    rows = rows.join(now_at, ["tenant", "skill"], "left")
    seen = F.col("expected_head").eqNullSafe(F.col("base_version"))
    outcome = (
        F.when(F.col("status").isNull(), "not_found").when(~F.col("status").isin("pending_confirmation", "accepted"), "not_reviewable").when(~seen, "other_base")
        .when(F.col("status") == "accepted", "replayed").when(~F.col("head").eqNullSafe(F.col("base_version")), "needs_rebase").otherwise("accepted")
    )
    judged = rows.withColumn("outcome", outcome)
    # of several proposals for one skill at one base the first lands, the others meet a moved head
    turn = F.row_number().over(Window.partitionBy("tenant", "skill", "outcome").orderBy("proposal_id"))
    judged = judged.withColumn("outcome", F.when((F.col("outcome") == "accepted") & (turn > 1), "needs_rebase").otherwise(F.col("outcome")))
    landed = judged.where("outcome = 'accepted'").withColumn("version_id", F.concat(F.lit("v_"), F.substring(F.sha2(F.concat_ws("\x1f", "proposal_id", "signature"), 256), 1, 16)))
    state = judged.where(F.col("outcome").isin("accepted", "needs_rebase")).select("tenant", "proposal_id", F.col("outcome").alias("o_"))
    changed = update_where(proposals.join(state, ["tenant", "proposal_id"], "left"), F.col("o_").isNotNull(), status=F.col("o_"), updated_at=F.lit(now)).select(*proposals.columns)
    new_heads = replace_by_key(heads.select("tenant", "skill_id", "version_id"), landed.select("tenant", F.col("skill").alias("skill_id"), "version_id"), ["tenant", "skill_id"])
    new_versions = append_new(versions.select("tenant", "skill_id", "version_id", "proposal_id", "steps"), landed.select("tenant", F.col("skill").alias("skill_id"), "version_id", "proposal_id", "steps"), ["tenant", "skill_id", "version_id"], F.asc("proposal_id"))
    return judged.select("tenant", "proposal_id", "outcome"), changed, new_heads, versions.select("tenant", "skill_id", "version_id", "proposal_id", "steps").unionByName(new_versions)


def revoke(revocations: DataFrame, incoming: DataFrame) -> DataFrame:
    """Revocations after it: one a version, the first stays."""
    return revocations.unionByName(append_new(revocations, incoming, ["tenant", "version_id"], F.asc("reason")))


def fetch_resources(asked: DataFrame, pins: DataFrame, revoked: DataFrame, files: DataFrame, now: str) -> DataFrame:
    """asked (tenant, agent_id, session_id, skill_id, version_id, sha256) with `outcome`: found and the path, or why not: no open pin of that version, revoked, not in its manifest."""
    open_ = pins.where(F.col("expires_at") > now).select("tenant", "agent_id", "session_id", "skill_id", "version_id").distinct().withColumn("pinned", F.lit(True))
    gone = revoked.select("tenant", "version_id").distinct().withColumn("gone", F.lit(True))
    listed = files.groupBy("tenant", "version_id", "sha256").agg(F.min("path").alias("path"))
    rows = asked.join(open_, ["tenant", "agent_id", "session_id", "skill_id", "version_id"], "left").join(gone, ["tenant", "version_id"], "left").join(listed, ["tenant", "version_id", "sha256"], "left")
    outcome = F.when(F.col("pinned").isNull(), "not_pinned").when(F.col("gone").isNotNull(), "revoked").when(F.col("path").isNull(), "not_in_manifest").otherwise("found")
    return rows.select(*asked.columns, outcome.alias("outcome"), F.when(outcome == "found", F.col("path")).alias("path"))


# texts for review ---------------------------------------------------------------------------------------------------


def synthesize(groups: DataFrame) -> DataFrame:
    """groups (proposal_id, op_kind, sources array<struct<capsule_id, summary>>, topics) with the content and summary of what a reviewer is to write."""
    listed = F.array_join(F.transform("sources", lambda s: F.concat(F.lit("- "), s["capsule_id"], F.lit(": "), F.coalesce(s["summary"], F.lit("")))), "\n")
    task = F.when(F.col("op_kind") == "generalize", "state the principle that these have in common; they stay").when(F.col("op_kind") == "workflow_generalize", "write the steps that these runs have in common; they stay").otherwise("review these")
    content = F.concat(F.lit("PLACEHOLDER, pending review: "), task, F.lit("\nTopics: "), F.array_join("topics", ", "), F.lit("\nSources:\n"), listed)
    summary = F.concat(F.lit("[evolution:"), F.col("op_kind"), F.lit("] "), F.size("sources").cast("string"), F.lit(" capsules ("), F.array_join("topics", "/"), F.lit(")"))
    return groups.withColumn("content", content).withColumn("summary", summary)


def crystallize(capsules: DataFrame, replies: DataFrame, now: str, dry_run: bool = True) -> tuple[DataFrame, DataFrame]:
    """(report, capsules). Pending placeholders and the replies for them (capsule_id, reply): those with a title and steps become the written workflow, unless it is a dry run."""
    from tessera.operators.sessions import reply_object
    from tessera.operators.skills import is_placeholder

    open_ = capsules.where((F.col("status") == "pending_confirmation") & is_placeholder(F.col("content"))).select("tenant", "capsule_id")
    rows = open_.join(replies, "capsule_id", "left").withColumn("w", reply_object(F.col("reply")))
    outcome = F.when(F.col("reply").isNull(), "no_reply").when(F.col("w").isNull(), "unreadable").when(F.lit(dry_run), "would_write").otherwise("written")
    told = rows.withColumn("outcome", outcome)
    body = F.concat(F.col("w.title"), F.lit("\n"), F.array_join(F.transform("w.steps", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n"))
    new = told.where("outcome = 'written'").select("capsule_id", body.alias("b_"), F.col("w.title").alias("t_"))
    out = update_where(capsules.join(new, "capsule_id", "left"), F.col("b_").isNotNull(), content=F.col("b_"), summary=F.col("t_"), updated_at=F.lit(now)).select(*capsules.columns)
    return told.select("capsule_id", "outcome"), out
