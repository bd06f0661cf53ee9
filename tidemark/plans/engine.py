"""The whole plan: ordered records and the state before them to the state after them.

The state after any records is a function of the ordered records alone, so batches are computed set at a time, and the
same plan over carried state and a new batch gives what all records at once give.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.canonical import json_string, sha256, stable_id, valid_raw_key
from ..functions.contract import ALLOWED_LATENESS_MS, IDENTITY_TTL_MS, LIVE, STATE
from ..operators.admission import admit, archived
from ..operators.decode import decode
from ..operators.ordering import in_ranges, strictly, with_order
from ..operators.quarantine import event_commits, first_rows, outbox_rows, quarantine_rows, transport_commits
from ..operators.timeline import component_rows, session_rows, sessions, totals, with_identity, with_time
from ..sources.scratch import empty, staged


#: Tables whose rows are unique by these columns; of several rows the first stays.
KEYS = {
    "identity_ledger": ["generation_id", "event_id"], "shard_state": ["shard_id", "generation_id"], "open_event": ["generation_id", "event_id"], "session_output": ["session_id"],
    "closure_work": ["work_id"], "quarantine": ["quarantine_id"], "outbox": ["outbox_id"], "processing_commit": ["commit_id"], "archive": ["key"],
}
#: Tables whose rows add up: (keys, sums).
SUMS = {
    "user_aggregate": (["generation_id", "user_id"], ["views", "clicks", "purchases", "value_cents"]), "metric": (["name", "dimensions_json"], ["value"]),
    "shard_metric": (["generation_id", "shard_id", "disposition"], ["n"]), "latency": (["generation_id", "event_type", "latency_ms"], ["n"]),
}
#: What an open session is known by. Its bounds only grow, so it has the same ones once.
SESSION = ["generation_id", "shard_id", "user_id", "start_ms", "end_ms"]


@dataclass
class Outcome:
    """added: what the records add to each table, for shard_state all of it; open_session tells which ones begin or end.

    tables: the state after the records, if they were applied to whole tables. dispositions: one row for each record that
    was processed. objects: one row (key, sha256, bodies) for each archived key, bodies being 2 if it came with several.
    """

    added: dict[str, DataFrame]
    tables: dict[str, DataFrame]
    dispositions: DataFrame
    objects: DataFrame


class WholeState:
    """A state of whole tables, as a batch is applied to it; sources.store has one that reads what a batch can touch."""

    def __init__(self, tables: dict[str, DataFrame]):
        self.tables, self.shards = tables, tables["shard_state"]

    def identities(self, events: DataFrame) -> DataFrame:
        """The ledger's rows that events can meet."""
        return self.tables["identity_ledger"]

    def opened(self, accepted: DataFrame, shards: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(open events, sessions they make up) of the sessions that accepted events extend or that `shards` closes."""
        return self.tables["open_event"], self.tables["session_component"].select(*SESSION)

    def held(self, rows: DataFrame, name: str) -> DataFrame:
        """Rows that several tables are made of: here each query asks for one or two, so they are not written."""
        return rows


def empty_state(spark: SparkSession) -> dict[str, DataFrame]:
    return {name: empty(spark, ddl) for name, ddl in STATE.items()}


def before_failures(ordered: DataFrame, fails: str) -> tuple[DataFrame, DataFrame]:
    """(records to process, failures): a shard's batch stops at its first record for which the column `fails` holds."""
    keys = ["batch_id", "shard_id"]
    first = ordered.where(F.col(fails)).groupBy(*keys).agg(F.min(F.struct("turn", "sequence_number")).alias("stop"))
    kept = ordered.join(first, keys, "left").where(F.col("stop").isNull() | (F.col("turn") < F.col("stop.turn"))).drop("stop")
    return kept, first.select(*keys, F.col("stop.turn").alias("turn"), F.col("stop.sequence_number").alias("sequence_number"))


def batch_item_failures(failures: DataFrame) -> DataFrame:
    """One row (batch_id, sequence_numbers) for each batch with failures: one for each failed shard, in order, no repeats."""
    listed = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("turn", "sequence_number"))), lambda x: x["sequence_number"]))
    return failures.groupBy("batch_id").agg(listed.alias("sequence_numbers"))


#: What of an event its tables are made of, besides its turn, which holds its batch, digest and ingest time.
EVENT = ["turn", "generation_id", "shard_id", "event_source_arn", "sequence_number", "event_id", "user_id", "event_type", "event_time_ms", "value_cents"]


def in_order(admitted: DataFrame, generation: str = LIVE, objects: bool = False) -> DataFrame:
    """Admitted records in their strict order, written. Of equal turns the smaller digest, then the earlier ingest time, is first.

    Only what tables are made of is written, and nothing twice: told() adds what follows from it. `objects` keeps bodies.
    """
    rows = with_order(admitted).withColumn("generation_id", F.lit(generation)).withColumn("rejected_key", F.when(F.col("rejected").isNotNull(), F.col("raw_key")))
    rows = rows.select(*EVENT, "rejected", "rejected_key", "partition_key", "representation", "digest", "ingest_time_ms", *(["object"] if objects else []))
    # The turn gets the digest and the ingest time as its ties.
    rows = rows.withColumn("turn", F.struct("turn.*", "digest", "ingest_time_ms")).drop("digest", "ingest_time_ms")
    return strictly(rows, name="admitted")


def told(rows: DataFrame) -> DataFrame:
    """Rows of in_order(), or of steps that follow it, with the columns that follow from theirs."""
    turn, key = F.col("turn"), F.col("rejected_key") if "rejected_key" in rows.columns else F.lit(None).cast("string")
    rows = rows.withColumns({"batch_id": turn["batch_id"], "digest": turn["digest"], "ingest_time_ms": turn["ingest_time_ms"], "source_hash": sha256(F.col("event_source_arn"))})
    return rows.withColumn("raw_key", F.coalesce(key, valid_raw_key()))


def ordered_strictly(admitted: DataFrame, generation: str = LIVE) -> DataFrame:
    return told(in_order(admitted, generation))


def in_turn(admitted: DataFrame) -> DataFrame:
    """Admitted records with a turn that tells apart all that differ in what is archived; nothing is written."""
    return with_order(admitted).withColumn("turn", F.struct("turn.*", "digest", "ingest_time_ms", "partition_key", "rejected"))


def archive_rows(rows: DataFrame) -> DataFrame:
    """The archive's rows of records that have `object` and a turn: of those with one key the first one's."""
    kept = rows.select(F.col("raw_key").alias("key"), "object", "rejected", "representation", "event_source_arn", "shard_id", "sequence_number", "partition_key", "digest", "turn")
    return archived(first_rows(kept, ["key"], "turn"))


def object_rows(rows: DataFrame) -> DataFrame:
    """(key, sha256, bodies) of the same, from hashes alone."""
    sha = rows.select(F.col("raw_key").alias("key"), F.sha2("object", 256).alias("sha256"), "turn")
    return sha.groupBy("key").agg(F.min_by("sha256", "turn").alias("sha256"), F.when(F.min("sha256") == F.max("sha256"), 1).otherwise(2).alias("bodies"))


def process_decoded(decoded: DataFrame, state=None, generation: str = LIVE) -> Outcome:
    """Applies decoded records to a state: a dict of whole tables, or what has the methods of WholeState."""
    spark = decoded.sparkSession
    old = WholeState(state or empty_state(spark)) if state is None or isinstance(state, dict) else state
    whole = isinstance(old, WholeState)
    # Every table below reads these, so they are written once. Bodies are, where a batch's archive is to be written too.
    ordered = in_order(admit(decoded), generation, objects=not whole)
    rejected = told(ordered.where(F.col("rejected").isNotNull()))
    valid = ordered.where(F.col("rejected").isNull()).select(*EVENT)
    known = with_identity(valid, old.identities(told(valid)))
    known = in_ranges(known, ["generation_id", "shard_id"], ["turn"], name="known")
    timed = with_time(known.where("identity = 'NEW_IDENTITY'").drop("identity"), old.shards)
    timed = timed.withColumn("disposition", F.when(F.col("category") == "beyond_watermark", "LATE_BEYOND_WATERMARK").otherwise(F.col("category")))
    timed = told(old.held(timed, "timed"))
    accepted = timed.where("category <> 'beyond_watermark'")
    repeated = told(known.where("identity <> 'NEW_IDENTITY'")).withColumn("disposition", F.col("identity"))

    shown = ["turn", "batch_id", "event_source_arn", "shard_id", "sequence_number", "source_hash", "raw_key", "digest", "disposition"]
    marks = [F.lit(None).cast("long").alias(c) for c in ("watermark_before_ms", "watermark_after_ms")]
    every = (
        rejected.withColumn("disposition", F.col("rejected")).select(*shown, F.lit(False).alias("mutated"), *marks)
        .unionAll(repeated.select(*shown, F.lit(False).alias("mutated"), *marks))
        .unionAll(timed.select(*shown, (F.col("category") != "beyond_watermark").alias("mutated"), "watermark_before_ms", "watermark_after_ms"))
    )

    new: dict[str, DataFrame] = {}
    new["identity_ledger"] = timed.select("event_id", "digest", F.col("ingest_time_ms").alias("first_ingest_ms"), (F.col("ingest_time_ms") + IDENTITY_TTL_MS).alias("expiry_ms"), "generation_id", F.col("category").alias("disposition"))
    shard = accepted.groupBy("shard_id", "generation_id").agg(F.max("event_time_ms").alias("max_event_time_ms"), F.count("*").alias("version"))
    new["shard_state"] = old.held(old.shards.unionByName(shard).groupBy("shard_id", "generation_id").agg(F.max("max_event_time_ms").alias("max_event_time_ms"), F.sum("version").alias("version")), "shards")
    columns = [c.split()[0] for c in STATE["open_event"].split(", ")]
    new["open_event"] = accepted.select(*columns, F.col("ingest_time_ms").alias("first_ingest_ms"))
    opened, before = old.opened(accepted, new["shard_state"])
    opened = opened.select(*columns).unionByName(accepted.select(*columns))
    found = old.held(sessions(opened, new["shard_state"]), "found")
    after = found.where("NOT closed").select(*SESSION)
    new["open_session"] = after.join(before, SESSION, "left_anti").withColumn("gone", F.lit(False)).unionByName(before.join(after, SESSION, "left_anti").withColumn("gone", F.lit(True)))
    new["session_output"] = session_rows(found)
    new["user_aggregate"] = accepted.groupBy("generation_id", "user_id").agg(*totals())
    work = accepted.select("shard_id", "generation_id", F.col("watermark_after_ms").alias("watermark_ms")).distinct()
    work_id = stable_id("closure-work", json_string(F.col("shard_id")), json_string(F.col("generation_id")), F.col("watermark_ms").cast("string"))
    new["closure_work"] = work.select(work_id.alias("work_id"), "shard_id", "generation_id", "watermark_ms", F.lit("DONE").alias("status"))
    isolated = every.where("disposition IN ('IDENTITY_CONFLICT', 'EXPIRED_IDENTITY', 'LATE_BEYOND_WATERMARK')").select(*shown).unionAll(rejected.withColumn("disposition", F.col("rejected")).select(*shown))
    new["quarantine"] = old.held(quarantine_rows(isolated), "quarantine")
    new["outbox"] = outbox_rows(new["quarantine"])
    new["processing_commit"] = event_commits(timed).unionByName(transport_commits(rejected))
    new["metric"] = metric_rows(every)
    new["shard_metric"] = every.groupBy(F.lit(generation).alias("generation_id"), "shard_id", "disposition").agg(F.count("*").alias("n"))
    new["latency"] = accepted.groupBy("generation_id", "event_type", (F.col("ingest_time_ms") - F.col("event_time_ms")).alias("latency_ms")).agg(F.count("*").alias("n"))
    stored = told(ordered) if not whole else in_turn(admit(decoded))
    new["archive"], objects = archive_rows(stored), object_rows(stored)
    if not whole:
        return Outcome(new, {}, every, objects)
    closed = found.where("closed").select("generation_id", F.explode("ids").alias("event_id"))
    still = opened.join(closed, ["generation_id", "event_id"], "left_anti").select(*columns)
    return Outcome(new, merged(old.tables, new | {"open_event": still, "session_component": component_rows(found)}), every, objects)


def merged(old: dict[str, DataFrame], new: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The state that follows `old` when `new` is added."""
    out = dict(old)
    for name in old.keys() & new.keys():
        rows = new[name]
        if name in SUMS:
            keys, sums = SUMS[name]
            out[name] = old[name].unionByName(rows).groupBy(*keys).agg(*[F.sum(c).cast("bigint").alias(c) for c in sums])
        elif name in ("shard_state", "open_event", "session_component"):
            out[name] = rows
        else:
            fresh = rows.join(old[name].select(*KEYS[name]), KEYS[name], "left_anti")
            out[name] = old[name].unionByName(fresh.select(*old[name].columns))
    return out


def process(records: DataFrame, state=None, generation: str = LIVE) -> Outcome:
    """Applies transport records to a state."""
    return process_decoded(decode(records), state, generation)


def metric_rows(dispositions: DataFrame) -> DataFrame:
    dimension = F.concat(F.lit('{"disposition":'), json_string(F.col("disposition")), F.lit("}"))
    return dispositions.groupBy("disposition").agg(F.count("*").alias("value")).select(F.lit("EventDisposition").alias("name"), dimension.alias("dimensions_json"), "value")


def log_rows(dispositions: DataFrame) -> DataFrame:
    """Structured log rows; a shard shows only as the first 16 digits of its hash."""
    return dispositions.select("turn", "disposition", F.col("mutated").alias("mutated_live_state"), "sequence_number", F.substring(sha256(F.col("shard_id")), 1, 16).alias("shard_hash"))


def watermarks(shard_state: DataFrame) -> DataFrame:
    return shard_state.select("generation_id", "shard_id", (F.col("max_event_time_ms") - ALLOWED_LATENESS_MS).alias("watermark_ms"))
