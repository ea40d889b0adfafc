"""Schemas of the stored tables, and their version."""

from __future__ import annotations

#: Raised whenever a schema below changes; stored beside the tables.
VERSION = 3
#: What each version added, in order; a store of an older version is read with
#: the columns it lacks as null.
HISTORY = {1: "documents and chunks", 2: "access groups, source facts, query log and jobs", 3: "search tokens"}

PAIR = "struct<k:string,v:string>"
BLOCK = f"source_path string, pos int, kind string, text string, pairs array<{PAIR}>, page int, section_path string, grp string, unit string"
DOCUMENTS = (
    "id long, source_path string, title string, products array<string>, sha256 string, page_count int, status string, error string, "
    "meta struct<format:string,provider:string,model:string,chunk_chars:int,warnings:array<string>,needs_review:boolean>, "
    "acl_groups array<string>, source_kind string, byte_size long, source_mtime timestamp, ingested_at timestamp, updated_at timestamp"
)
CHUNKS = (
    "id long, document_id long, ordinal int, kind string, content string, section_path string, page_from int, page_to int, products array<string>, "
    "embedding array<float>, token_count int, content_hash string"
)
QUERY_LOG = (
    "id string, asked_at timestamp, principal string, question string, products array<string>, intent string, top_k int, answered boolean, grounded boolean, "
    "unsupported array<string>, chunk_ids array<long>, answer string, latency_ms map<string,double>, model string, request_id string, rating int, detail string"
)
JOBS = "id string, kind string, status string, detail string, stats map<string,long>, created_at timestamp, started_at timestamp, finished_at timestamp"
QUESTIONS = "id string, question string, answers array<struct<document:string,pages:array<int>>>, expect string, unanswerable boolean, tags array<string>"

STATUSES = ("pending", "indexing", "indexed", "failed", "quarantined")
JOB_STATUSES = ("queued", "running", "done", "failed")


def missing_versions(stored: int) -> list[int]:
    """The versions to apply to a store, in order."""
    if stored > VERSION:
        raise ValueError(f"store has version {stored}, newer than {VERSION}")
    return [v for v in sorted(HISTORY) if v > stored]
