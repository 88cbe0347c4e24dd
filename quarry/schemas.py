"""Declared schemas, as DDL, and their version. Tables are written with these and never inferred."""

from __future__ import annotations

#: 2: snapshots of the log.
SCHEMA_VERSION = 2

LOCATOR = "STRUCT<path: STRING, url: STRING, commit: STRING, page: INT, paragraph: INT, line_start: INT, line_end: INT, fragment: STRING>"

SOURCES = "source_id STRING, source_type STRING, display_name STRING, owner STRING, visibility STRING, refresh_policy STRING, rights_policy STRING, adapter_version STRING, configuration STRING"

RAW_DOCUMENTS = (
    "source_id STRING, item_id STRING, source_uri STRING, media_type STRING, status STRING, title STRING, size_bytes BIGINT, source_revision STRING, "
    "text STRING, parser_version STRING, fetched_at TIMESTAMP, published_at TIMESTAMP, language STRING, metadata_json STRING"
)

VERSIONS = (
    "document_id STRING, content_hash STRING, source_id STRING, item_id STRING, source_uri STRING, title STRING, media_type STRING, language STRING, "
    "source_revision STRING, fetched_at TIMESTAMP, published_at TIMESTAMP, parser_version STRING, normalizer_version STRING, visibility STRING, "
    "rights_policy STRING, status STRING, acl_labels ARRAY<STRING>, metadata_json STRING"
)

CHUNKS = (
    "index_run_id STRING, chunk_id STRING, document_id STRING, document_version_hash STRING, source_id STRING, ordinal INT, text STRING, token_count INT, "
    f"language STRING, chunker_version STRING, heading_path ARRAY<STRING>, locator {LOCATOR}, acl_labels ARRAY<STRING>, lexical_terms ARRAY<STRING>, "
    "dense_embedding ARRAY<DOUBLE>, embedding_model STRING, embedding_dimensions INT"
)

STAGINGS = "index_run_id STRING, document_id STRING, content_hash STRING, is_tombstone BOOLEAN"

RUN_EVENTS = "event_seq BIGINT, run_id STRING, source_id STRING, status STRING, activation_seq BIGINT"

REQUESTS = "request_id STRING, query STRING, grants ARRAY<STRING>, source_ids ARRAY<STRING>, top_k INT"

ALLOWED = {
    "visibility": ("private", "shared", "public"),
    "refresh_policy": ("manual", "scheduled", "on_commit", "event_driven"),
    "rights_policy": ("personal_reference", "owner_approved", "public_domain", "restricted"),
    "source_type": ("filesystem", "web", "git_tree", "repository_ci"),
    "item_status": ("available", "deleted", "unreadable", "unsupported", "quarantined"),
}
