"""One object for a store: tables by name, queries as methods that return lazy DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import capsules as C
from tessera.operators import graph as G
from tessera.operators import mining as M
from tessera.operators import queue as Q
from tessera.operators import evolution, maintenance, proposals, registry, rounds, sequences, workers
from tessera.operators import transcripts as X
from tessera.plans import capsule_search, ingest, packing, transcript_search


@dataclass
class KnowledgeStore:
    """capsules and whatever else there is; a table that is missing fails when it is asked for."""

    capsules: DataFrame
    blocks: DataFrame | None = None
    edges: DataFrame | None = None
    vectors: DataFrame | None = None
    feedback: DataFrame | None = None
    entities: DataFrame | None = None
    aliases: DataFrame | None = None
    jobs: DataFrame | None = None

    # capsules
    def search(self, request: capsule_search.Search, boosts: DataFrame | None = None) -> DataFrame:
        return capsule_search.search(self.capsules, self.vectors, request, boosts)

    def search_with_graph(self, request: capsule_search.Search, dynamic: bool = False) -> DataFrame:
        return capsule_search.search_with_graph(self.capsules, self.vectors, self.edges, request, dynamic)[0]

    def search_texts(self, request: capsule_search.Search) -> DataFrame:
        """What search shows: texts within the request's budget."""
        return packing.packed(self.search_with_graph(request) if self.edges is not None else self.search(request), request.budget)

    def search_sections(self, request: capsule_search.Search) -> DataFrame:
        return capsule_search.pack(self.search(request), request.budget)

    def wake_up(self, request: capsule_search.Search) -> DataFrame:
        return capsule_search.wake_up(self.capsules, request)

    def get(self, tenant: str, capsule_id: str) -> DataFrame:
        return C.by_id(self.capsules, capsule_id, tenant)

    def list(self, tenant: str, cursor: tuple[str, str] | None = None, limit: int = 50, **equal: str | None) -> DataFrame:
        return C.scope_page(self.capsules, tenant, cursor, limit, **equal)

    def stats(self) -> DataFrame:
        return C.status_histogram(self.capsules)

    def wings(self, tenant: str) -> DataFrame:
        return C.wings(self.capsules, tenant)

    def taxonomy(self, tenant: str) -> DataFrame:
        return C.taxonomy(self.capsules, tenant)

    def profile(self, tenant: str, limit: int = 10) -> DataFrame:
        return C.profile(self.capsules, self.entities, tenant, limit)

    def versions(self, tenant: str, capsule_id: str) -> DataFrame:
        return C.version_chain(self.capsules, tenant, capsule_id)

    def detail(self, tenant: str, capsule_id: str) -> dict[str, DataFrame]:
        """Row, versions, neighbours, feedback and embedding state."""
        return {
            "capsule": self.get(tenant, capsule_id), "versions": self.versions(tenant, capsule_id), "neighbors": G.neighbors(self.edges, f"capability_capsule:{capsule_id}"),
            "feedback": C.feedback_histogram(self.feedback.where(self.feedback["capsule_id"] == capsule_id)), "embedding": Q.embedding_state(self.get(tenant, capsule_id), self.vectors, self.jobs),
        }

    def ingest(self, requests: DataFrame) -> DataFrame:
        return ingest.outcomes(requests, self.capsules)

    def give_feedback(self, events: DataFrame) -> DataFrame:
        return Q.apply_feedback(self.capsules, events)

    # review
    def pending(self, tenant: str) -> DataFrame:
        return C.pending_review(self.capsules, tenant)

    def accept(self, tenant: str, capsule_id: str) -> DataFrame:
        return Q.transition(self.capsules, tenant, capsule_id, "active")

    def reject(self, tenant: str, capsule_id: str) -> DataFrame:
        return Q.transition(self.capsules, tenant, capsule_id, "rejected")

    def near_duplicates(self, threshold: float = 0.95) -> DataFrame:
        return M.near_duplicate_groups(self.capsules, self.vectors, threshold)

    # transcripts
    def sessions(self, tenant: str) -> DataFrame:
        return X.session_rollup(self.blocks, tenant)

    def range(self, tenant: str, cursor: tuple | None, limit: int, **filters: str | None) -> DataFrame:
        return X.page(self.blocks, tenant, cursor, limit, **filters)

    def search_transcripts(self, request: transcript_search.TranscriptSearch, vectors: DataFrame | None = None) -> DataFrame:
        return transcript_search.windows(self.blocks, transcript_search.search(self.blocks, vectors, request), request)

    def rounds(self) -> DataFrame:
        return sequences.completed_rounds(self.blocks)

    def rebuild_rounds(self, builds: DataFrame, now: str, dry_run: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
        return rounds.rebuild(self.blocks, builds, now, dry_run)

    # workers and upkeep
    def embed_capsules(self, settings: workers.Settings, now: str) -> workers.Tick:
        return workers.embed_capsules(self.jobs, self.capsules, self.vectors, settings, now)

    def embed_blocks(self, jobs: DataFrame, vectors: DataFrame, settings: workers.Settings, now: str) -> workers.Tick:
        return workers.embed_blocks(jobs, self.blocks, vectors, settings, now)

    def job_preview(self, now: str, most_attempts: int = 3, limit: int = 50) -> DataFrame:
        return workers.preview(self.jobs, now, most_attempts, limit)

    def postings(self) -> DataFrame:
        return maintenance.postings(C.live(self.capsules), F.concat_ws(" ", "summary", "content"), "capsule_id")

    def ingest_episodes(self, history: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
        return M.ingest_episodes(history, incoming)

    def rollback(self, candidates: DataFrame, now: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        return evolution.rollback(self.capsules, self.edges, candidates, now)

    # skill proposals
    def workflow_catalogue(self, bundles: DataFrame, bounded: bool = True) -> DataFrame:
        return proposals.catalogue(self.capsules, bundles, bounded)

    def compile_replies(self, replies: DataFrame, bundles: DataFrame) -> DataFrame:
        return proposals.compile_replies(replies, self.workflow_catalogue(bundles))

    def crystallize(self, replies: DataFrame, now: str, dry_run: bool = True) -> tuple[DataFrame, DataFrame]:
        return proposals.crystallize(self.capsules, replies, now, dry_run)

    # graph
    def neighbors(self, node: str, hops: int = 1, as_of: str | None = None) -> DataFrame:
        return G.within_hops(self.edges, node, hops, as_of)

    def timeline(self, node: str) -> DataFrame:
        return G.timeline(self.edges, node)

    def graph_stats(self) -> DataFrame:
        return G.stats(self.edges)

    def tunnels(self, limit: int = 50) -> DataFrame:
        return G.tunnels(self.edges, limit)

    def follow(self, node: str, hops: int = 2) -> DataFrame:
        return G.follow_tunnels(self.edges, node, hops)

    # entities and facts
    def entity_list(self, tenant: str, kind: str | None = None, part: str | None = None, limit: int = 50) -> DataFrame:
        return registry.list_entities(self.entities, tenant, kind, part, limit)

    def fact_check(self, words: DataFrame, claims: DataFrame) -> dict[str, DataFrame]:
        names = self.entities.selectExpr("canonical_name as name")
        return {"similar_names": M.similar_names(words, names), "conflicts": M.relation_conflicts(claims, self.edges)}
