"""Admission: one CASE chain over decoded columns, in the contract's order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import rejected_raw_key, sha256, valid_raw_key
from ..functions.contract import (
    CONTRACT_VERSION, EVENT_TYPES, ID_PATTERN, MAX_AGE_MS, MAX_ENCODED_BYTES, MAX_FUTURE_MS, MAX_INGEST_MS, MAX_VALUE_CENTS,
    PARTITION_PATTERN, PAYLOAD_KEYS, PROHIBITED_KEYS, REQUIRED_KEYS, SOURCE_PATTERN,
)


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def prohibited(payload_keys: Column) -> Column:
    return F.arrays_overlap(payload_keys, _strings(PROHIBITED_KEYS))


def schema_holds() -> Column:
    """Whether the typed columns and key sets follow the schema; never null."""
    c, keys = F.col, F.col("payload_keys")
    has = lambda k: F.array_contains(keys, k)
    text = lambda k, most: ~has(k) | (c(k).isNotNull() & F.length(k).between(1, most))
    rules = [
        F.array_sort("root_keys") == _strings(REQUIRED_KEYS),
        F.size(F.array_except(keys, _strings(PAYLOAD_KEYS))) == 0,
        c("schema_version") == CONTRACT_VERSION,
        c("event_id").rlike(ID_PATTERN),
        c("user_id").rlike(ID_PATTERN),
        c("source").rlike(SOURCE_PATTERN),
        c("envelope_key").rlike(PARTITION_PATTERN),
        c("event_type").isin(EVENT_TYPES),
        c("event_time_ms") >= 0,
        c("ingest_time_ms").between(0, MAX_INGEST_MS),
        text("campaign_id", 128),
        text("page_id", 256),
        ~has("value_cents") | c("value_cents").between(0, MAX_VALUE_CENTS),
        has("value_cents") == (c("event_type") == "purchase"),
    ]
    out = F.lit(True)
    for rule in rules:
        out = out & F.coalesce(rule, F.lit(False))
    return out


def rejection() -> Column:
    """Why a record is rejected, null if it is admitted."""
    ahead = F.col("event_time_ms") - F.col("ingest_time_ms")
    return (
        F.when(F.col("failure").isNotNull(), F.col("failure"))
        .when(F.col("float"), "INVALID_SCHEMA")
        .when(F.octet_length("canonical") > MAX_ENCODED_BYTES, "EVENT_TOO_LARGE")
        .when(F.coalesce(prohibited(F.col("payload_keys")), F.lit(False)), "PRIVACY_VIOLATION")
        .when(~schema_holds(), "INVALID_SCHEMA")
        .when((F.col("envelope_key") != F.col("user_id")) | ~F.col("partition_key").eqNullSafe(F.col("envelope_key")), "PARTITION_MISMATCH")
        .when(ahead > MAX_FUTURE_MS, "FUTURE_CLOCK")
        .when(-ahead > MAX_AGE_MS, "TOO_OLD")
    )


#: Columns that hold a record's contents; `object` has what the archive keeps of them.
CONTENTS = ["body", "canonical", "semantic", "transport_text"]


def admit(decoded: DataFrame) -> DataFrame:
    """decoded with `rejected`, `digest` (of the event, or of a rejected body), `source_hash`, `raw_key` and `object`.

    object is what the archive keeps: the canonical event, or the exact body of a rejected record.
    """
    out = decoded.withColumn("rejected", rejection()).withColumn("source_hash", sha256(F.col("event_source_arn")))
    out = out.withColumn("digest", F.when(F.col("rejected").isNull(), sha256(F.col("semantic"))).otherwise(F.sha2("body", 256)))
    out = out.withColumn("raw_key", F.when(F.col("rejected").isNull(), valid_raw_key()).otherwise(rejected_raw_key()))
    return out.withColumn("object", F.when(F.col("rejected").isNull(), F.encode("canonical", "utf-8")).otherwise(F.col("body")))


def archived(rows: DataFrame) -> DataFrame:
    """The archive's columns of records that have theirs, `object`, `rejected` and `representation`.

    What follows from a body, its hash and metadata, is made here, so that only bodies are grouped and shuffled.
    """
    ok = F.col("rejected").isNull()
    meta = F.when(ok, F.create_map(F.lit("event-digest"), F.col("digest"), F.lit("schema-version"), F.lit(CONTRACT_VERSION))).otherwise(
        F.create_map(F.lit("disposition"), F.col("rejected"), F.lit("representation"), F.col("representation"))
    )
    return rows.select(
        "key", F.col("object").alias("body"), F.sha2("object", 256).alias("sha256"), meta.alias("metadata"), "event_source_arn", "shard_id", "sequence_number", "partition_key", F.when(ok, F.col("digest")).alias("event_digest")
    )
