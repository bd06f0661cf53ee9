"""Quarantine, outbox and commit rows, all under stable ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import json_string, stable_id


def first_rows(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of each of `keys` that comes first, insert-or-ignore in processing order."""
    rest = [c for c in rows.columns if c not in (*keys, order)]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("row")).select(*keys, "row.*")


def quarantine_rows(isolated: DataFrame) -> DataFrame:
    """From (turn, disposition, raw_key, source_hash, sequence_number, digest). The id is made of what is grouped by."""
    keys = ["disposition", "source_hash", "sequence_number", "digest"]
    rows = first_rows(isolated.select(*keys, "raw_key", "turn"), keys, "turn")
    quoted = [json_string(F.col(c)) for c in keys]
    return rows.select(stable_id("quarantine", *quoted).alias("quarantine_id"), "disposition", "raw_key", "source_hash", "sequence_number", F.col("digest").alias("payload_digest"))


def outbox_rows(quarantine: DataFrame) -> DataFrame:
    named = quarantine.withColumn("outbox_id", stable_id("outbox", json_string(F.col("quarantine_id"))))
    body = F.concat(F.lit('{"disposition":"'), "disposition", F.lit('","outbox_id":"'), "outbox_id", F.lit('","quarantine_id":"'), "quarantine_id", F.lit('"}'))
    return named.select("outbox_id", "quarantine_id", body.alias("body_json"), F.lit(0).alias("delivered"))


def transport_commits(rejected: DataFrame) -> DataFrame:
    keys = ["source_hash", "sequence_number", "digest"]
    rows = first_rows(rejected.select(*keys, "raw_key", "rejected", "turn"), keys, "turn")
    commit = stable_id("commit", "transport", *[json_string(F.col(c)) for c in keys])
    rows = rows.select("*", commit.alias("commit_id"), F.col("rejected").alias("disposition"), F.col("digest").alias("payload_digest"))
    return rows.select("commit_id", F.lit("transport").alias("generation_id"), F.col("commit_id").alias("event_id"), "source_hash", "sequence_number", "raw_key", "disposition", "payload_digest")


def event_commits(timed: DataFrame) -> DataFrame:
    quoted = [json_string(F.col(c)) for c in ("generation_id", "event_id", "digest")]
    return timed.select(stable_id("commit", *quoted).alias("commit_id"), "generation_id", "event_id", "source_hash", "sequence_number", "raw_key", "disposition", F.col("digest").alias("payload_digest"))


def outbox_page(outbox: DataFrame, limit: int = 20) -> DataFrame:
    """The undelivered rows with the smallest ids."""
    if not 1 <= limit <= 20:
        raise ValueError("an outbox page has 1 to 20 rows")
    return outbox.where("delivered = 0").select("outbox_id", "body_json").orderBy("outbox_id").limit(limit)
