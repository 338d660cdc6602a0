"""Schemas of the canonical tables, as DDL, which readers and from_json take."""

from __future__ import annotations

SCHEMAS: dict[str, str] = {
    "hot": "system_id string, conversation_id string not null, content string, embedding array<float>, timestamp timestamp, metadata string, content_hash string, uploaded_at timestamp",
    "warm": "system_id string, conversation_id string not null, embedding array<tinyint>, summary string, timestamp timestamp, metadata string",
    "cold": "system_id string, conversation_id string, fingerprint binary, ultra_summary string, timestamp timestamp, daily_metrics string",
    "code_graphs": "repo_path string, commit_hash string, nodes_count int, graph_data string, metadata string, ingested_at timestamp",
    "graph_data": "nodes map<string, struct<type: string, name: string, file_path: string, file: string, start_line: int, source: string, problems: array<struct<severity: string, message: string, category: string>>>>, edges array<struct<type: string, source: string, target: string>>",
    "metrics": "metric_name string, system_id string, timestamp timestamp, value double, metadata map<string, string>, seq bigint",
    "series": "metric_name string, entity_id string, ts string, value double",
    "entities": "entity_id string, entity_type string, properties map<string, string>, source_system string",
    "edges": "source_id string, target_id string, edge_type string, weight double, properties map<string, string>, timestamp timestamp, source_system string, seq bigint",
    "traces": "component_name string, task_class string, selector string, outcome string, duration_ms double, ts timestamp",
    "alerts": "alert_type string, severity string, message string, pattern_data string, metadata map<string, string>, timestamp timestamp",
    "manifest": "uploaded_at string, conversation_count bigint, total_size_bytes bigint, version string, system_type string, checksum string, compressed boolean, compression_format string, files array<string>, metadata map<string, string>",
    "memories": "conversations array<struct<id: string, content: string, embedding: array<float>, timestamp: string, source: string, metadata: map<string, string>>>",
    "event": "topic string, payload string, headers map<string, string>",
    "samples": "name string, labels map<string, string>, le double, value double, ts timestamp",
}
