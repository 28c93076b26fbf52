"""Explicit schemas; readers fail on rows that do not fit instead of inferring."""

from __future__ import annotations

SPAN = "struct<byte_start: bigint, byte_end: bigint, row_start: bigint, column_start: bigint, row_end: bigint, column_end: bigint>"
ORIGIN = "struct<relative_path: string, fact_kind: string, fact_id: bigint, item_index: bigint>"
LINKS = f"link_id string, repository_id string, link_kind string, rule_id string, language string, origin {ORIGIN}, written string, outcome string, targets array<struct<kind: string, relative_path: string, declaration_id: bigint, qualified_name: string, entity_id: string, structural_kind: string, entity_key: string>>, reason string, recorded_at timestamp"
CANDIDATES = f"record_id string, repository_id string, rule_id string, language string, origin {ORIGIN}, written string, outcome string, candidates array<struct<relative_path: string, declaration_id: bigint, qualified_name: string, decl_kind: string>>, reason string, recorded_at timestamp"
ENTITIES = "entity_id string, repository_id string, structural_kind string, language string, entity_key string, files array<string>, created_at timestamp, deleted_at timestamp"
NODES = "node_id string, repository_id string, node_key string, node_kind string, language string, relative_path string, label string, disposition string, disposition_kind string, disposition_reason string, created_at timestamp, deleted_at timestamp"
EDGES = "edge_id string, repository_id string, edge_kind string, evidence_class string, rule_id string, source string, target string, upstream_id string, candidate_set_id string, outcome string, recorded_at timestamp"
EVENTS = "schema_name string, event_id string, session_id string, investigation_id string, project_id string, repository_id string, repo_head string, sequence bigint, event_time string, origin struct<runtime: string, adapter: string, adapter_version: string>, event_type string, payload string, content_digest string"
#: Version of the fact tables; a table of another version is refused on load.
FACT_VERSION = 1
