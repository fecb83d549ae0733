"""Explicit schemas and closed domains of the knowledge store."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, DoubleType, FloatType, LongType, StringType, StructField, StructType

_TYPES = {"string": StringType(), "bigint": LongType(), "float": FloatType(), "double": DoubleType(), "boolean": BooleanType(), "array<string>": ArrayType(StringType())}


def table(ddl: str) -> StructType:
    """Names and simple types; needs no session, as parsing by Spark would."""
    return StructType([StructField(name, _TYPES[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


# The closed domains of the data model.
STATUSES = ("pending_confirmation", "provisional", "active", "archived", "rejected")
CAPSULE_TYPES = ("implementation", "experience", "preference", "episode", "workflow", "diary")
SCOPES = ("global", "project", "repo", "workspace")
VISIBILITIES = ("private", "shared", "system")
WRITE_MODES = ("auto", "propose")
ROLES = ("user", "assistant", "system")
BLOCK_TYPES = ("text", "tool_use", "tool_result", "thinking")
ENTITY_KINDS = ("topic", "project", "repo", "module", "workflow", "tag", "file")
#: Feedback kind -> (change of confidence, change of decay, status that follows).
FEEDBACK = {
    "useful": (0.1, 0.0, None),
    "applies_here": (0.05, 0.0, None),
    "outdated": (0.0, 0.2, None),
    "does_not_apply_here": (0.0, 0.1, None),
    "incorrect": (0.0, 0.0, "archived"),
    "auto_promoted": (0.0, 0.0, "active"),
    "system_reweight_up": (0.02, 0.0, None),
    "system_reweight_decay": (0.0, 0.05, None),
}
SYSTEM_FEEDBACK = ("auto_promoted", "system_reweight_up", "system_reweight_decay")
VALIDATING_FEEDBACK = ("useful", "applies_here")

CAPSULE = table(
    "capsule_id string, tenant string, project string, repo string, module string, capsule_type string, status string, scope string, visibility string, version bigint, "
    "summary string, content string, evidence array<string>, code_refs array<string>, tags array<string>, topics array<string>, confidence float, decay_score float, "
    "created_at string, updated_at string, last_used_at string, last_recalled_at string, expires_at string, supersedes_id string, source_agent string, session_id string, idempotency_key string, content_hash string"
)
BLOCK = table(
    "block_id string, tenant string, caller_agent string, session_id string, transcript_path string, line_number bigint, block_index bigint, message_uuid string, role string, block_type string, "
    "content string, tool_name string, tool_use_id string, meta_json string, embed_eligible boolean, created_at string"
)
EDGE = table(
    "from_node string, to_node string, relation string, valid_from string, valid_to string, confidence float, extractor string, strength float, stability float, last_activated string, access_count bigint"
)
FEEDBACK_EVENT = table("feedback_id string, capsule_id string, kind string, note string, created_at string")
JOB = table(
    "job_id string, tenant string, capsule_id string, content_hash string, provider string, status string, attempts bigint, last_error string, available_at string, created_at string, updated_at string"
)
SESSION = table("session_id string, tenant string, caller_agent string, started_at string, last_seen_at string, ended_at string, memory_count bigint, goal string")
ENTITY = table("entity_id string, tenant string, canonical_name string, kind string, created_at string")
ALIAS = table("tenant string, alias_text string, entity_id string, created_at string")
EPISODE = table("episode_id string, tenant string, goal string, steps array<string>, outcome string, evidence array<string>, created_at string")
CANDIDATE = table("candidate_id string, tenant string, op_kind string, member_ids array<string>, evidence double, cycles bigint, status string, created_at string, updated_at string")
