"""Identity, event time and sessions over ordered, admitted events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import component_id, identity_disposition, is_closed, json_ids, session_id
from ..functions.contract import ALLOWED_LATENESS_MS, INACTIVITY_GAP_MS
from .ordering import islands, previous_max


def with_identity(events: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """Adds `identity`: NEW_IDENTITY for the first event of a generation and event_id, else how it relates to the first.

    The first is a grouped minimum, which combines before the shuffle, and not a window over the id's events. Turns have
    to be strict (engine.in_order), so that of a record that is delivered twice one copy alone is the first; they hold
    the digest and the ingest time.
    """
    keys = ["generation_id", "event_id"]
    first = events.groupBy(*keys).agg(F.min("turn").alias("first"))
    if ledger is not None:
        first = first.join(ledger.select(*keys, F.col("digest").alias("known_digest"), F.col("first_ingest_ms").alias("known_ingest")), keys, "left")
    else:
        first = first.withColumn("known_digest", F.lit(None).cast("string")).withColumn("known_ingest", F.lit(None).cast("long"))
    both = events.join(first, keys)
    relation = identity_disposition(F.col("turn.digest"), F.coalesce("known_digest", "first.digest"), F.col("turn.ingest_time_ms"), F.coalesce("known_ingest", "first.ingest_time_ms"))
    new = F.col("known_digest").isNull() & (F.col("turn") == F.col("first"))
    return both.withColumn("identity", F.when(new, "NEW_IDENTITY").otherwise(relation)).drop("first", "known_digest", "known_ingest")


def time_category(time: Column, previous: Column) -> Column:
    return (
        F.when(previous.isNull() | (time >= previous), "on_time")
        .when(time >= previous - ALLOWED_LATENESS_MS, "accepted_late")
        .otherwise("beyond_watermark")
    )


def with_time(new: DataFrame, shards: DataFrame | None = None) -> DataFrame:
    """Adds category, watermark_before_ms and watermark_after_ms to new identities.

    The running maximum may take in events beyond the watermark: they are below it. Events can be in ranges of
    generation, shard and turn already (ordering.in_ranges), then they have `block`.
    """
    keys = ["generation_id", "shard_id"]
    rows = previous_max(new, keys, ["turn"], "event_time_ms", "previous_max", "block" in new.columns)
    if shards is not None:
        rows = rows.join(shards.select(*keys, F.col("max_event_time_ms").alias("carried")), keys, "left").withColumn("previous_max", F.greatest("previous_max", "carried")).drop("carried")
    return (
        rows.withColumn("category", time_category(F.col("event_time_ms"), F.col("previous_max")))
        .withColumn("watermark_before_ms", F.col("previous_max") - ALLOWED_LATENESS_MS)
        .withColumn("watermark_after_ms", F.greatest("previous_max", "event_time_ms") - ALLOWED_LATENESS_MS)
    )


def with_islands(events: DataFrame) -> DataFrame:
    """Adds `island` within each generation, shard and user: sessions split by more than the inactivity gap."""
    return islands(events, ["generation_id", "shard_id", "user_id"], "event_time_ms", "event_id", INACTIVITY_GAP_MS)


def count_of(kind: str) -> Column:
    return F.count_if(F.col("event_type") == kind)


def totals() -> list[Column]:
    named = {"views": "view", "clicks": "click", "purchases": "purchase"}
    return [*[count_of(k).alias(n) for n, k in named.items()], F.sum(F.coalesce("value_cents", F.lit(0))).cast("bigint").alias("value_cents")]


def sessions(open_events: DataFrame, shards: DataFrame) -> DataFrame:
    """One row for each island of open events: bounds, members, totals, and whether its shard's watermark has closed it."""
    keys = ["generation_id", "shard_id", "user_id", "island"]
    found = with_islands(open_events.select(*keys[:3], "event_time_ms", "event_id", "event_type", "value_cents")).groupBy(*keys).agg(F.min("event_time_ms").alias("start_ms"), F.max("event_time_ms").alias("end_ms"), F.count("*").alias("member_count"), F.collect_list("event_id").alias("ids"), *totals())
    watermark = shards.select("generation_id", "shard_id", (F.col("max_event_time_ms") - ALLOWED_LATENESS_MS).alias("watermark_ms"))
    return found.join(watermark, ["generation_id", "shard_id"]).withColumn("closed", is_closed(F.col("watermark_ms"), F.col("end_ms")))


def session_rows(found: DataFrame) -> DataFrame:
    g, u = F.col("generation_id"), F.col("user_id")
    return found.where("closed").select(
        session_id(g, u, F.col("ids")).alias("session_id"), "generation_id", "user_id", "start_ms", "end_ms", "member_count", json_ids(F.col("ids")).alias("member_ids_json"), "views", "clicks", "purchases", "value_cents", F.lit(1).alias("output_version")
    )


def component_rows(found: DataFrame) -> DataFrame:
    identity = component_id(F.col("generation_id"), F.col("user_id"), F.col("ids")).alias("component_id")
    return found.where("NOT closed").select(identity, "shard_id", "generation_id", "user_id", "start_ms", "end_ms", F.lit(1).alias("version"))
