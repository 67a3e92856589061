"""Explicit schemas of the memory tables."""

from loamstone.operators.concept_deltas import LOGS

MEMORIES = (
    "id string, kind string, content string, mode_id string, persona_id string, importance int, created_ts long, last_recall_ts long, recall_count int, emotional_tag double, novelty double, "
    "connection_density double, predictive_value double, meta string, token_count int, stability double, difficulty double, invalid_at long, superseded_by string, source_id string"
)
EDGES = "src string, dst string, weight double, kind string"
REVIEWS = "memory_id string, ef double, interval_days int, repetitions int, next_review_ts long, last_grade int"
COGNITIVE = (
    "memory_id string, memory_form string, lifecycle_stage string, status string, confidence double, sensitivity string, source_id string, source string, scope string, observed_at string, valid_from string, valid_to string, "
    "review_after string, classification_version string, memory_tier string, verification_status string, review_status string, owner_type string, owner_id string, visibility string, parent_memory_id string, "
    "supersedes_memory_id string, root_source_id string, activation_count int, adopted_count int, confirmed_count int, seen_count int, last_verified_ts long, governance_version string, updated_ts long, evidence_count int"
)
ACL = "memory_id string, principal_type string, principal_id string, permission string, expires_at long"
EVIDENCE = "memory_id string, evidence_type string, locator string, excerpt string, observed_at string"
CONFLICTS = "conflict_id string, left_memory_id string, right_memory_id string, reason string, status string, created_ts long"
ACTIVATIONS = "event_id string, memory_id string, activation_kind string, session_id string, occurred_date date, evidence_locator string, principal_type string, principal_id string, created_ts long"
DREAMS = "event_id string, memory_id string, dream_note_id string, occurred_date date, phase_count int, segment_count int, base_delta double, evidence_locator string, created_ts long"
FACETS = "memory_id string, facet_type string, facet_value string"
LINEAGE = "child string, parent string, relation_type string"
VECTORS = "memory_id string, vec array<float>"
CONCEPTS = "concept_id string, name string, kind string, mention_count long, doc_freq long, is_hub boolean"
MEM_CONCEPTS = "memory_id string, concept_id string, weight double"
CONCEPT_EDGES = "src string, dst string, weight double"
DANGLING = "name string, mention_count long, first_ts long, last_ts long, promoted boolean"
TYPED = "id string, src string, dst string, rel_type string, because string, weight double, embedding array<float>, created_ts long"
INBOX = (
    "episode_id string, idempotency_key string, source_id string, summary string, evidence string, memory_form string, domains array<string>, entities array<string>, importance int, confidence double, sensitivity string, "
    "observed_at string, status string, memory_id string, created_ts long, updated_ts long"
)
RUNS = "run_id string, session_id string, query_hash string, depth string, candidates int, results int, tokens int, latency_ms double, source_counts map<string,int>, created_ts long"
RUN_ITEMS = "run_id string, memory_id string, lexical_rank int, vector_rank int, graph_rank int, rrf_score double, permission_result string, filter_reason string, final_rank int, created_ts long"
SEEN = "memory_id string, batch string, n long, ts long"
PROMOTIONS = "promotion_id string, memory_id string, from_tier string, to_tier string, rule_version string, run_id string, reviewer string, created_ts long"
VERSIONS = "scope_id string, version long, content_hash string, updated_ts long"
TOUCHES = "id string, ts long"
DENSITIES = "id string, connection_density double, seq long"
POSTINGS = "bucket int, term string, id string, dl int, position int"
LENGTHS = "id string, dl int"
CONCEPT_SEEN = "id string, state string"
SHARDS = "memory_id string, copy int, pool string, payload binary, sha256 string, created_ts long, pending_upload boolean"

TABLES = {
    "memories": MEMORIES, "edges": EDGES, "review_state": REVIEWS, "memory_cognitive": COGNITIVE, "memory_acl": ACL, "memory_evidence": EVIDENCE, "memory_conflicts": CONFLICTS, "memory_activations": ACTIVATIONS,
    "dream_events": DREAMS, "memory_facets": FACETS, "memory_lineage": LINEAGE, "memories_vec": VECTORS, "concepts": CONCEPTS, "mem_concepts": MEM_CONCEPTS, "concept_edges": CONCEPT_EDGES, "dangling_refs": DANGLING,
    "typed_edges": TYPED, "inbox": INBOX, "retrieval_runs": RUNS, "run_items": RUN_ITEMS, "seen": SEEN, "promotions": PROMOTIONS, "versions": VERSIONS, "touches": TOUCHES, "densities": DENSITIES, "postings": POSTINGS, "lengths": LENGTHS,
    "shards": SHARDS, "concept_seen": CONCEPT_SEEN, **LOGS,
}
