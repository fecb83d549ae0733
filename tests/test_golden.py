"""A store of nine capsules, three messages and six edges whose results are known."""

import pytest
from pyspark.sql import functions as F

from tessera.functions.embedding import deterministic
from tessera.operators import capsules as C
from tessera.operators import graph as G
from tessera.operators import retrieval as R

# The store's rows.
ROWS = [
    ("cap_a", "t1", "implementation", "active", "repo", "duckdb attaches the lance dataset as a sql read engine", 1, None, None),
    ("cap_b", "t1", "experience", "active", "project", "transcript ragged batch fts scanner bug recurs", 1, None, None),
    ("cap_c", "t1", "preference", "active", "repo", "always run fmt and clippy before every commit", 1, None, None),
    ("cap_d_v1", "t1", "implementation", "active", "repo", "old decay formula uses updated_at only", 1, None, None),
    ("cap_d_v2", "t1", "implementation", "active", "repo", "new decay formula anchors on last_used_at", 2, "cap_d_v1", None),
    ("cap_e_pending", "t1", "experience", "pending_confirmation", "repo", "proposed experience capsule awaiting review", 1, None, None),
    ("cap_f_archived", "t1", "implementation", "archived", "repo", "archived incorrect fact", 1, None, None),
    ("cap_t2_x", "t2", "implementation", "active", "repo", "tenant two isolation capsule should never leak into t1", 1, None, None),
    ("cap_idem", "t1", "episode", "pending_confirmation", "repo", "episode capsule with an idempotency key for the find-by lookup", 1, None, "idem-key-1"),
]
MESSAGES = [("mb_1", "we discussed the rust storage layer design"), ("mb_2", "duckdb attaches the lance dataset for reads"), ("mb_3", "tantivy is a full text search alternative")]
ASKED = "new decay formula anchors on last_used_at"


@pytest.fixture(scope="module")
def capsules(spark):
    rows = [(*r, f"{i + 1:020}", f"{i + 1:020}", "p", "p", r[5]) for i, r in enumerate(ROWS)]
    names = "capsule_id string, tenant string, capsule_type string, status string, scope string, content string, version bigint, supersedes_id string, idempotency_key string, created_at string, updated_at string, project string, repo string, summary string"
    return spark.createDataFrame(rows, names).cache()


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame([(r[0], v) for r, v in zip(ROWS, deterministic([r[5] for r in ROWS]), strict=True)], "capsule_id string, embedding array<float>").cache()


def query_vector(text):
    return [float(x) for x in deterministic([text])[0]]


def test_vector_rank(capsules, vectors):
    """Five neighbours over all tenants, one of which is another tenant's."""
    near = R.nearest(vectors, query_vector(ASKED), 5).join(capsules.where("tenant = 't1'").select("capsule_id"), "capsule_id").orderBy("rank")
    assert [r["capsule_id"] for r in near.collect()] == ["cap_d_v2", "cap_a", "cap_e_pending", "cap_b"]


def test_lexical_rank(capsules):
    found = R.bm25(capsules, F.col("content"), "capsule_id", "decay formula", 5, F.col("tenant") == "t1")
    assert {r["capsule_id"] for r in found.collect()} == {"cap_d_v1", "cap_d_v2"}


def test_hybrid(capsules, vectors):
    """In millionths; the two lexical hits tie in all but length, so both orders of them are right."""
    found = {r["capsule_id"]: r["rrf_score"] for r in R.hybrid(capsules, vectors, "t1", "decay formula", query_vector(ASKED), 5).collect()}
    assert list(found)[:2] == ["cap_d_v2", "cap_d_v1"] and set(found) == {"cap_d_v2", "cap_d_v1", "cap_a", "cap_e_pending", "cap_b"}
    assert (found["cap_a"], found["cap_e_pending"], found["cap_b"]) == (16129, 15873, 15625)
    assert (found["cap_d_v2"], found["cap_d_v1"]) in {(32522, 31545), (32787, 31281)}


def test_roll_ups(capsules):
    row = C.status_histogram(capsules.where("tenant = 't1'")).first()
    assert (row["total"], row["active"], row["archived"], row["pending_confirmation"], row["provisional"], row["rejected"]) == (8, 5, 1, 2, 0, 0)
    assert [r["capsule_id"] for r in C.id_list(capsules, "t1").collect()] == ["cap_idem", "cap_f_archived", "cap_e_pending", "cap_d_v2", "cap_d_v1", "cap_c", "cap_b", "cap_a"]
    assert [r["capsule_id"] for r in C.recent_pool(capsules, "t1", 50).collect()] == ["cap_idem", "cap_e_pending", "cap_d_v2", "cap_d_v1", "cap_c", "cap_b", "cap_a"]
    assert [r["capsule_id"] for r in C.pending_review(capsules, "t1").collect()] == ["cap_idem", "cap_e_pending"]
    assert [(r["project"], r["repos"]) for r in C.taxonomy(capsules, "t1").collect()] == [("p", ["p"])]


def test_versions(capsules):
    assert {r["capsule_id"] for r in C.recall_pool(capsules, "t1").collect()} == {"cap_a", "cap_b", "cap_c", "cap_d_v2", "cap_e_pending", "cap_idem"}
    assert [r["capsule_id"] for r in C.version_chain(capsules, "t1", "cap_d_v1").collect()] == ["cap_d_v2", "cap_d_v1"]
    assert [r["capsule_id"] for r in C.version_chain(capsules, "t1", "cap_a").collect()] == ["cap_a"]


def test_a_long_version_chain_is_whole(spark):
    rows = [(f"c{i:03}", "t", i, f"c{i - 1:03}" if i else None, f"{i:020}") for i in range(150)]
    chain = spark.createDataFrame(rows, "capsule_id string, tenant string, version int, supersedes_id string, updated_at string")
    assert C.version_chain(chain, "t", "c075").count() == 150


def test_transcript_ranks(spark):
    vectors = spark.createDataFrame([(i, v) for (i, _), v in zip(MESSAGES, deterministic([m for _, m in MESSAGES]), strict=True)], "block_id string, embedding array<float>")
    assert [r["block_id"] for r in R.nearest(vectors, query_vector(MESSAGES[1][1]), 5, "block_id").orderBy("rank").collect()] == ["mb_2", "mb_3", "mb_1"]


def test_deleted_ends(spark):
    names = "from_node string, to_node string, relation string, valid_from string, valid_to string"
    edges = spark.createDataFrame([], names)
    new = spark.createDataFrame([("capability_capsule:x", "topic:a", "r", "1", None), ("capability_capsule:y", "capability_capsule:x", "r", "1", None), ("capability_capsule:y", "topic:a", "r", "1", None)], names)
    gone = spark.createDataFrame([("x",)], "capsule_id string")
    assert [r["from_node"] for r in G.add_edges(edges, new, gone).collect()] == ["capability_capsule:y"]
