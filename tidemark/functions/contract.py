"""The event contract: schemas, columns and fixed values."""

from __future__ import annotations

# Fixed values of the contract.
CONTRACT_VERSION = "1.0.0"
ALLOWED_LATENESS_MS = 1_800_000
INACTIVITY_GAP_MS = 1_800_000
DEDUPE_HORIZON_MS = 604_800_000
IDENTITY_TTL_MS = 691_200_000
MAX_ENCODED_BYTES = 16_384
MAX_FUTURE_MS = 60_000
MAX_AGE_MS = 604_800_000
MAX_VALUE_CENTS = 100_000_000
CLOSURE_PAGE = 20
EVENT_TYPES = ["view", "click", "purchase"]
PROHIBITED_KEYS = ["address", "credential", "email", "free_text", "name", "password", "phone", "secret", "token"]
REQUIRED_KEYS = ["event_id", "event_time_ms", "event_type", "ingest_time_ms", "partition_key", "payload", "schema_version", "source", "user_id"]
PAYLOAD_KEYS = ["campaign_id", "page_id", "value_cents"]
ID_PATTERN = r"^[A-Za-z0-9][A-Za-z0-9._:-]{0,127}\z"
PARTITION_PATTERN = r"^[A-Za-z0-9][A-Za-z0-9._:-]{0,255}\z"
SOURCE_PATTERN = r"^[a-z][a-z0-9_-]{0,63}\z"
LIVE = "live-v1"
#: Ingest times from the year 10000 on have no date of four digits; they are invalid here.
MAX_INGEST_MS = 253_402_300_799_999

BATCH = (
    "Records array<struct<eventID string, eventSourceARN string, eventSource string, awsRegion string, "
    "kinesis struct<partitionKey string, sequenceNumber string, data string>>>"
)
RECORD = "batch_id bigint, position bigint, event_source_arn string, shard_id string, sequence_number string, partition_key string, transport_text string"
#: The types of an envelope; what doesn't follow them is not decoded natively.
ENVELOPE = (
    "event_id string, event_time_ms bigint, event_type string, ingest_time_ms bigint, partition_key string, payload struct<campaign_id string, page_id string, value_cents bigint>, "
    "schema_version string, source string, user_id string"
)
#: What decoding a transport text gives; the native path fills the same columns.
DECODED = (
    "failure string, body binary, representation string, float boolean, canonical string, semantic string, root_keys array<string>, payload_keys array<string>, "
    "schema_version string, event_id string, source string, user_id string, event_type string, envelope_key string, event_time_ms bigint, ingest_time_ms bigint, "
    "campaign_id string, page_id string, value_cents bigint"
)

STATE = {
    "identity_ledger": "event_id string, digest string, first_ingest_ms bigint, expiry_ms bigint, generation_id string, disposition string",
    "shard_state": "shard_id string, generation_id string, max_event_time_ms bigint, version bigint",
    "open_event": "shard_id string, generation_id string, user_id string, event_id string, event_time_ms bigint, event_type string, value_cents bigint, digest string",
    "session_component": "component_id string, shard_id string, generation_id string, user_id string, start_ms bigint, end_ms bigint, version int",
    "session_output": "session_id string, generation_id string, user_id string, start_ms bigint, end_ms bigint, member_count bigint, member_ids_json string, views bigint, clicks bigint, purchases bigint, value_cents bigint, output_version int",
    "user_aggregate": "generation_id string, user_id string, views bigint, clicks bigint, purchases bigint, value_cents bigint",
    "quarantine": "quarantine_id string, disposition string, raw_key string, source_hash string, sequence_number string, payload_digest string",
    "outbox": "outbox_id string, quarantine_id string, body_json string, delivered int",
    "closure_work": "work_id string, shard_id string, generation_id string, watermark_ms bigint, status string",
    "metric": "name string, dimensions_json string, value bigint",
    "shard_metric": "generation_id string, shard_id string, disposition string, n bigint",
    "latency": "generation_id string, event_type string, latency_ms bigint, n bigint",
    "processing_commit": "commit_id string, generation_id string, event_id string, source_hash string, sequence_number string, raw_key string, disposition string, payload_digest string",
    "failure_destination": "invocation_id string, object_key string, body_sha256 string, earliest_sequence string, status string",
    "archive": "key string, body binary, sha256 string, metadata map<string,string>, event_source_arn string, shard_id string, sequence_number string, partition_key string, event_digest string",
}
