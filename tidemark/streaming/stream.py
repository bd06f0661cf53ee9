"""The same plan as a stream: each micro-batch adds its rows to the state tables under its number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.admission import admit
from ..operators.decode import decode
from ..operators.ordering import with_order
from ..operators.recovery import added_faults, failure_rows, fresh_failures, replay_records, unavailable
from ..plans.engine import Outcome, batch_item_failures, before_failures, process_decoded
from ..sources.scratch import freed, staged


class Unsound(RuntimeError):
    """A batch's rows break a rule of the state, so they are not written as done."""


def require_sound_rows(added: dict[str, DataFrame]) -> None:
    """A row for each broken rule reaches the driver, and there are about a dozen rules."""
    faults = [f"{r['rule']}: {r['n']}" for r in added_faults(added).collect()]
    if faults:
        raise Unsound("; ".join(faults))


def apply_batch(store, records: DataFrame, batch: int | None = None, fails: str | None = None, conflicts: str = "fail") -> list[tuple]:
    """Adds a batch to the state tables. Returns the failed sequences, one row for each of its record batches that failed.

    A batch that is applied already changes nothing. `fails` names a column that is true for records whose processing
    failed: a shard's batch stops at the first one, the rest counts, and the batch isn't complete. When it is delivered
    again it is computed anew from the state before it and replaces its rows. Failed sequences are one for each shard of
    a batch at most, which is what a consumer has to send back.

    An archived object whose key comes again with another body fails the batch before anything is written; with
    conflicts="keep" the first body stays, and a stream goes on. What the batch writes for itself on the way is deleted.
    """
    batch = store.last()[0] + 1 if batch is None else batch
    if store.applied(batch):
        return []
    with freed(store.spark):
        failed: list[tuple] = []
        if fails:
            records, failures = before_failures(with_order(records), fails)
            records = records.drop("turn", fails)
            failed = [(r["batch_id"], list(r["sequence_numbers"])) for r in batch_item_failures(failures).orderBy("batch_id").collect()]
        add_decoded(store, decode(records), batch, not failed, conflicts)
    return failed


def add_decoded(store, decoded: DataFrame, batch: int, complete: bool = True, conflicts: str = "fail") -> None:
    """Applies decoded records to what they can touch of the state and writes what they add as a batch."""
    outcome = process_decoded(decoded, store.carried(batch), store.generation)
    store.write(batch, outcome.added | {"archive": new_objects(store, outcome, batch, conflicts)}, complete, check=require_sound_rows)


def new_objects(store, outcome: Outcome, batch: int, conflicts: str) -> DataFrame:
    """The archive rows that a batch adds. Two bodies under one key, in the batch or over batches, are a conflict."""
    if conflicts not in ("fail", "keep"):
        raise ValueError("conflicts are to fail or to be kept out")
    objects = outcome.added["archive"]
    told = staged(outcome.objects, "told")
    known = store.known_objects(told, batch)
    if conflicts == "fail":
        differing = known.where("sha256 <> known_sha256").select("key").unionByName(told.where("bodies > 1").select("key")).limit(1).collect()
        if differing:
            raise Unsound(f"the archive has another body under the key {differing[0]['key']}")
    return objects.join(known.select("key"), "key", "left_anti")


def run_stream(records: DataFrame, store, checkpoint: str, trigger: dict | None = None, conflicts: str = "fail") -> StreamingQuery:
    """Starts the stream over records without batch_id; the micro-batch's number is their batch.

    The checkpoint is the only lock: Spark lets one query write to it, and delivers a batch that was not finished again.
    """

    def each(rows: DataFrame, number: int) -> None:
        apply_batch(store, rows.withColumn("batch_id", F.lit(number).cast("bigint")), number, conflicts=conflicts)

    return records.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def record_failure(store, invocation_id: str, earliest_sequence: str, body: bytes) -> str:
    """Keeps an exhausted invocation: its body, and an unresolved row that blocks success. Returns the body's key."""
    rows = failure_rows(store.spark.createDataFrame([(invocation_id, earliest_sequence, bytearray(body))], "invocation_id string, earliest_sequence string, body binary"))
    _register(store, rows)
    return rows.first()["object_key"]


def _register(store, rows: DataFrame) -> None:
    store.append("failure_destination", fresh_failures(store.failures(), rows))
    store.probe("failure_recorded")


def replay(store, requests: DataFrame, generation: str) -> Outcome:
    """Applies archived events to a generation: requests (raw_key, expected_body_sha256, expected_event_digest, invocation_id).

    Another generation than the store's own gets state tables of its own. In the store's own generation all events are
    known, so nothing is written and the outcome only says what they are. A request that comes twice is applied once. If
    any object is missing, changed, no longer admitted or of another digest, those failures are recorded and nothing else.
    Of the archive only the folders of the requested dates are read.
    """
    archive = store.archived(requests.select(F.col("raw_key").alias("key")))
    records, broken = replay_records(archive, requests)
    # Written, as what is wrong with records and their effects are read from it in turn.
    decoded = staged(decode(staged(records, "requests")), "replayed")
    checked = staged(admit(decoded), "checked")
    held = F.coalesce(F.col("rejected").isNull() & (F.col("digest") == F.col("expected_event_digest")), F.lit(False))
    broken = broken.unionByName(checked.where(~held).select(*broken.columns))
    failures = staged(unavailable(broken, generation), "unavailable")
    if failures.limit(1).count():
        _register(store, failures)
        raise ValueError("raw objects can't be replayed; the failures are recorded")
    target = store.of(generation)
    batch = target.last()[0] + 1
    outcome = process_decoded(decoded.drop("expected_body_sha256", "expected_event_digest", "invocation_id", "request_key"), target.carried(batch), generation)
    if generation != store.generation:
        target.write(batch, {n: t for n, t in outcome.added.items() if n != "archive"}, check=require_sound_rows)
    return outcome
