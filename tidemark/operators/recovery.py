"""Batches into a store, outbox delivery, exhausted failures and replay."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import json_string
from ..plans.engine import KEYS, SUMS
from .quarantine import outbox_page


def fresh_failures(known: DataFrame, failures: DataFrame) -> DataFrame:
    """The rows that failures (invocation_id, object_key, body_sha256, earliest_sequence) add to known ones, unresolved.

    A failure that is known stays as it is; one that comes with other contents fails.
    """
    told = ["object_key", "body_sha256", "earliest_sequence"]
    old = known.select("invocation_id", F.struct(*told).alias("old"))
    if failures.join(old, "invocation_id").where(F.struct(*told) != F.col("old")).limit(1).count():
        raise ValueError("a failure has other contents than before")
    fresh = failures.join(old, "invocation_id", "left_anti").withColumn("status", F.lit("UNRESOLVED")).dropDuplicates(["invocation_id"])
    return fresh.select(*known.columns)


def failure_rows(failed: DataFrame) -> DataFrame:
    """From (invocation_id, earliest_sequence, body): the object's key and hash."""
    digest = F.sha2("body", 256)
    key = F.concat(F.lit("failure/invocation_id="), "invocation_id", F.lit("/"), digest, F.lit(".json"))
    return failed.select("invocation_id", key.alias("object_key"), digest.alias("body_sha256"), "earliest_sequence", "body")


def unresolved(failures: DataFrame) -> int:
    return failures.where("status = 'UNRESOLVED'").count()


def require_no_unresolved(failures: DataFrame) -> None:
    if unresolved(failures):
        raise ValueError("unresolved failures block success")


def mark_delivered(store, ids: DataFrame, batch: int | None = None) -> None:
    """Marks outbox rows (outbox_id) of a batch, or of any, as delivered; an unknown id fails and nothing is marked."""
    outbox = store.rows("outbox", store.last()[0] + 1) if batch is None else store.rows_of("outbox", batch)
    found = ids.select("outbox_id").distinct().join(outbox.select("outbox_id", "batch"), "outbox_id", "left")
    if found.where("batch IS NULL").limit(1).count():
        raise ValueError("an outbox id is unknown")
    for row in found.select("batch").distinct().collect():
        store.append("delivery", found.where(F.col("batch") == row["batch"]), row["batch"])


def drain_outbox(store, limit: int = 20) -> int:
    """Publishes one page of undelivered rows and then marks them: at least once. Returns how many it marked.

    Batches are delivered one after the other, and one that is done is not read again, so a page costs what its batch's
    outbox holds whatever the history.
    """
    for batch in store.undrained():
        page = [(r["outbox_id"], r["body_json"]) for r in outbox_page(store.undelivered(batch), limit).collect()]
        if page:
            store.publish(page, batch)
            mark_delivered(store, store.spark.createDataFrame(page, "outbox_id string, body_json string"), batch)
            return len(page)
        store.drained(batch)
    return 0


def require_sound(store) -> None:
    """Before success is told: no unresolved failure, and no broken rule in the state."""
    tables = store.load()
    require_no_unresolved(tables["failure_destination"])
    faults = state_faults(tables).collect()
    if faults:
        raise ValueError(f"the state breaks {len(faults)} rules: {faults[0]['rule']}")


def replay_records(archive: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records to decode, failures) for requests (raw_key, expected_body_sha256, expected_event_digest, invocation_id).

    An object that is missing or has another hash can't be replayed. Records carry what their event digest should be.
    """
    both = requests.join(archive.withColumnRenamed("key", "raw_key"), "raw_key", "left")
    sound = F.coalesce(F.sha2("body", 256) == F.col("expected_body_sha256"), F.lit(False))
    records = both.where(sound).select(
        F.lit(0).cast("bigint").alias("batch_id"), F.lit(0).cast("bigint").alias("position"), "event_source_arn", "shard_id", "sequence_number", "partition_key",
        F.regexp_replace(F.base64("body"), "[\\r\\n]", "").alias("transport_text"), "expected_body_sha256", "expected_event_digest", "invocation_id", F.col("raw_key").alias("request_key"),
    )
    return records, both.where(~sound).select(F.col("raw_key").alias("request_key"), "expected_body_sha256", "expected_event_digest", "invocation_id", "sequence_number")


def unavailable(failed: DataFrame, generation: str) -> DataFrame:
    """Failure rows of requests that can't be replayed."""
    pairs = {
        "disposition": F.lit('"RAW_REPLAY_UNAVAILABLE"'), "expected_body_sha256": json_string(F.col("expected_body_sha256")), "expected_event_digest": json_string(F.col("expected_event_digest")),
        "generation_id": json_string(F.lit(generation)), "raw_key": json_string(F.col("request_key")), "sequence_number": json_string(F.coalesce("sequence_number", F.lit(""))),
    }
    body = F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{k}":'), v) for k, v in pairs.items()]), F.lit("}"))
    return failure_rows(failed.select("invocation_id", F.coalesce("sequence_number", F.lit("")).alias("earliest_sequence"), body.alias("body")))


def state_faults(tables: dict[str, DataFrame]) -> DataFrame:
    """(rule, n): how many keys or rows break a rule of the state; none if it is sound. All tables' keys are grouped at once.

    A key is grouped as two hashes, 128 bits, and not as its text.
    """
    hashed = lambda *k: [F.xxhash64(*k).alias("one"), F.xxhash64(F.lit("key"), *k).alias("two")]
    keys = {n: k for n, k in KEYS.items() if n != "archive"} | {n: k for n, (k, _) in SUMS.items()}
    each = [tables[t].select(F.lit(f"{t} has repeated keys").alias("rule"), *hashed(*k)) for t, k in keys.items()]
    repeated = functools.reduce(DataFrame.unionAll, each).groupBy("rule", "one", "two").agg(F.count("*").alias("n")).where("n > 1").select("rule")
    both = tables["quarantine"].select(*hashed("quarantine_id"), F.lit(0).alias("sent")).unionAll(tables["outbox"].select(*hashed("quarantine_id"), F.lit(1)))
    alone = both.groupBy("one", "two").agg(F.max("sent").alias("sent")).where("sent = 0").select(F.lit("quarantine without outbox").alias("rule"))
    return repeated.unionAll(alone).groupBy("rule").agg(F.count("*").alias("n"))


def added_faults(added: dict[str, DataFrame]) -> DataFrame:
    """state_faults of what a batch adds, and events that count in a user's total without an identity of their own."""
    new = added["identity_ledger"].where("disposition <> 'beyond_watermark'").agg(F.count("*").alias("n"))
    counted = added["user_aggregate"].agg((-F.coalesce(F.sum(F.col("views") + F.col("clicks") + F.col("purchases")), F.lit(0))).alias("n"))
    off = new.unionAll(counted).agg(F.abs(F.sum("n")).alias("n")).select(F.lit("totals differ from new identities").alias("rule"), "n")
    return state_faults(added).unionAll(off.where("n > 0"))
