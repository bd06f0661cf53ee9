"""Queries over the table `events`, and DuckDB SQL for the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.canonical import json_string, sortable, stable_id, token
from ..functions.contract import CLOSURE_PAGE, INACTIVITY_GAP_MS
from ..operators import quality, rules, timeline
from ..operators.admission import admit, prohibited
from ..operators.decode import decode
from ..operators.ordering import with_order
from ..operators.quarantine import outbox_page as page
from ..sources.scratch import shared_folder, staged
from ..sources.store import StateTables
from ..streaming.stream import add_decoded
from . import engine
from .events import FAR_SQL, FAULT_SQL, RARE_FAULT_SQL, RECORDS_SQL, decoded, in_increments, redelivered, transported

IDENT_SQL = RECORDS_SQL + """,
seen AS (SELECT *, row_number() OVER w AS nth, first_value(digest) OVER w AS first_digest, first_value(ingest_time_ms) OVER w AS first_ingest FROM keyed WHERE rejected IS NULL WINDOW w AS (PARTITION BY event_id ORDER BY seq)),
ident AS (SELECT *, CASE WHEN nth = 1 THEN 'NEW_IDENTITY' WHEN ingest_time_ms - first_ingest > 604800000 THEN 'EXPIRED_IDENTITY' WHEN digest = first_digest THEN 'IDENTICAL_DUPLICATE' ELSE 'IDENTITY_CONFLICT' END AS identity FROM seen),
prev AS (SELECT *, max(event_time_ms) OVER (PARTITION BY shard_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM ident WHERE identity = 'NEW_IDENTITY'),
timed AS (SELECT *, CASE WHEN pm IS NULL OR event_time_ms >= pm THEN 'on_time' WHEN event_time_ms >= pm - 1800000 THEN 'accepted_late' ELSE 'beyond_watermark' END AS category,
  pm - 1800000 AS watermark_before_ms, greatest(coalesce(pm, event_time_ms), event_time_ms) - 1800000 AS watermark_after_ms FROM prev),
acc AS (SELECT * FROM timed WHERE category <> 'beyond_watermark'),
wm AS (SELECT shard_id, max(event_time_ms) AS max_event_time_ms, count(*) AS version FROM acc GROUP BY shard_id),
gap AS (SELECT *, CASE WHEN event_time_ms - lag(event_time_ms) OVER w > 1800000 THEN 1 ELSE 0 END AS starts FROM acc WINDOW w AS (PARTITION BY shard_id, user_id ORDER BY event_time_ms, event_id)),
isl AS (SELECT *, sum(starts) OVER (PARTITION BY shard_id, user_id ORDER BY event_time_ms, event_id ROWS UNBOUNDED PRECEDING) AS island FROM gap),
ses AS (
  SELECT shard_id, user_id, island, min(event_time_ms) AS start_ms, max(event_time_ms) AS end_ms, count(*) AS member_count, '["' || string_agg(event_id, '","' ORDER BY event_id) || '"]' AS member_ids_json,
    count(*) FILTER (WHERE event_type = 'view') AS views, count(*) FILTER (WHERE event_type = 'click') AS clicks, count(*) FILTER (WHERE event_type = 'purchase') AS purchases, CAST(sum(coalesce(value_cents, 0)) AS BIGINT) AS value_cents
  FROM isl GROUP BY shard_id, user_id, island),
clo AS (SELECT ses.*, max_event_time_ms - 1800000 > end_ms + 1800000 AS closed FROM ses JOIN wm USING (shard_id)),
disp AS (
  SELECT seq, shard_id, sequence_number, source_hash, raw_key, digest, rejected AS disposition, false AS mutated, CAST(NULL AS BIGINT) AS watermark_before_ms, CAST(NULL AS BIGINT) AS watermark_after_ms FROM keyed WHERE rejected IS NOT NULL
  UNION ALL SELECT seq, shard_id, sequence_number, source_hash, raw_key, digest, identity, false, NULL, NULL FROM ident WHERE identity <> 'NEW_IDENTITY'
  UNION ALL SELECT seq, shard_id, sequence_number, source_hash, raw_key, digest, CASE WHEN category = 'beyond_watermark' THEN 'LATE_BEYOND_WATERMARK' ELSE category END, category <> 'beyond_watermark', watermark_before_ms, watermark_after_ms FROM timed),
quar AS (
  SELECT sha256('["1.0.0","quarantine","' || disposition || '","' || source_hash || '","' || sequence_number || '","' || digest || '"]') AS quarantine_id, disposition, raw_key, source_hash, sequence_number, digest AS payload_digest
  FROM disp WHERE disposition NOT IN ('on_time', 'accepted_late', 'IDENTICAL_DUPLICATE')),
obox AS (SELECT sha256('["1.0.0","outbox","' || quarantine_id || '"]') AS outbox_id, * FROM quar)"""


def _admitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_order(admit(decoded(spark, sf_dir))).withColumn("generation_id", F.lit("live-v1"))


def _identified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.with_identity(engine.in_order(admit(decoded(spark, sf_dir)).where("rejected IS NULL")).select(*engine.EVENT))


def _timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.with_time(_identified(spark, sf_dir).where("identity = 'NEW_IDENTITY'").drop("identity"))


def _accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written once: sessions and shard maxima both read it."""
    rows = _timed(spark, sf_dir).where("category <> 'beyond_watermark'").withColumn("ingest_time_ms", F.col("turn.ingest_time_ms"))
    return staged(rows.select("generation_id", "shard_id", "user_id", "event_id", "event_type", "event_time_ms", "ingest_time_ms", "value_cents", "category"), "accepted")


def _shards(accepted: DataFrame) -> DataFrame:
    return accepted.groupBy("shard_id", "generation_id").agg(F.max("event_time_ms").alias("max_event_time_ms"), F.count("*").alias("version"))


def _state(table: str, *columns: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = engine.process_decoded(decoded(spark, sf_dir)).tables[table]
        return found.select(*columns) if columns else found

    run.__name__ = table
    return run


def _archived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive's rows, which follow from admission alone: no identity or time is worked out for them."""
    return engine.archive_rows(engine.in_turn(admit(decoded(spark, sf_dir))))


def archive(spark, sf_dir):
    return _archived(spark, sf_dir).select("key", "sha256", "shard_id", "sequence_number")


def _decoded_dispositions(records):
    rows = admit(decode(records))
    return rows.select("sequence_number", F.coalesce("rejected", F.lit("ADMITTED")).alias("disposition"), "representation", F.sha2("body", 256).alias("body_sha256"), "digest")


def decode_dispositions(spark, sf_dir):
    """Transport texts, most of them broken in eight ways, decoded and admitted: what each record is, and its digest."""
    return _decoded_dispositions(transported(spark, sf_dir))


def decode_stream_dispositions(spark, sf_dir):
    """The same of a stream as producers send it, in which one text in a hundred is broken."""
    return _decoded_dispositions(transported(spark, sf_dir, one_in=73))


def redelivered_in_batch(spark, sf_dir):
    """Dispositions where every third record comes twice in its batch under the same coordinates."""
    every = engine.process_decoded(redelivered(spark, sf_dir)).dispositions
    return every.groupBy("sequence_number", "disposition").agg(F.count("*").alias("n"))


def redelivered_aggregate(spark, sf_dir):
    """User aggregates of the same records: a purchase that comes twice counts once."""
    return engine.process_decoded(redelivered(spark, sf_dir)).tables["user_aggregate"].drop("generation_id")


def admission_dispositions(spark, sf_dir):
    return _admitted(spark, sf_dir).select("sequence_number", F.coalesce("rejected", F.lit("ADMITTED")).alias("disposition"), "digest", "raw_key")


def admission_counts(spark, sf_dir):
    return _admitted(spark, sf_dir).groupBy(F.coalesce("rejected", F.lit("ADMITTED")).alias("disposition")).agg(F.count("*").alias("n"))


def identity_dispositions(spark, sf_dir):
    return _identified(spark, sf_dir).select("sequence_number", "event_id", "identity")


def event_time_classification(spark, sf_dir):
    return _timed(spark, sf_dir).select("event_id", "shard_id", "category", "watermark_before_ms", "watermark_after_ms")


def shard_watermarks(spark, sf_dir):
    return engine.watermarks(_shards(_accepted(spark, sf_dir))).select("shard_id", "watermark_ms")


def session_islands(spark, sf_dir):
    return timeline.with_islands(_accepted(spark, sf_dir)).select("event_id", "user_id", "island")


def dense_sessions(spark, sf_dir):
    """Sessions of users folded to ten, which gives long islands and many bridges."""
    rows = _accepted(spark, sf_dir).withColumn("user_id", F.right("user_id", F.lit(1)))
    found = timeline.sessions(rows, _shards(rows))
    return found.select("shard_id", "user_id", "start_ms", "end_ms", "member_count", "views", "clicks", "purchases", "value_cents", "closed")


def component_match_range_join(spark, sf_dir):
    """For each late event, the sessions of its user that it touches: a range join, cut into spans for an equi-join."""
    accepted = _accepted(spark, sf_dir)
    found = timeline.sessions(accepted, _shards(accepted))
    span = 86_400_000
    cut = lambda c: F.expr(f"{c} div {span}")
    reach = found.select("shard_id", "user_id", "start_ms", "end_ms", F.explode(F.sequence(cut(f"(start_ms - {INACTIVITY_GAP_MS})"), cut(f"(end_ms + {INACTIVITY_GAP_MS})"))).alias("span"))
    late = accepted.where("category = 'accepted_late'").select("event_id", "shard_id", "user_id", "event_time_ms", cut("event_time_ms").alias("span"))
    near = F.col("event_time_ms").between(F.col("start_ms") - INACTIVITY_GAP_MS, F.col("end_ms") + INACTIVITY_GAP_MS)
    return late.join(reach, ["shard_id", "user_id", "span"]).where(near).select("event_id", "start_ms", "end_ms")


def member_containment_join(spark, sf_dir):
    """Members counted by containment in their session's bounds."""
    rows = timeline.with_islands(_accepted(spark, sf_dir))
    keys = ["generation_id", "shard_id", "user_id", "island"]
    bounds = rows.groupBy(*keys).agg(F.min("event_time_ms").alias("start_ms"), F.max("event_time_ms").alias("end_ms"))
    inside = rows.join(bounds, keys).where(F.col("event_time_ms").between(F.col("start_ms"), F.col("end_ms")))
    return inside.groupBy("shard_id", "user_id", "start_ms", "end_ms").agg(F.count("*").alias("members"))


def closure_page(spark, sf_dir):
    """The first page of due components: twenty, by end and id."""
    accepted = _accepted(spark, sf_dir)
    due = timeline.component_rows(timeline.sessions(accepted, _shards(accepted)).where("closed").withColumn("closed", F.lit(False)))
    return due.select("component_id", "shard_id", "user_id", "end_ms").orderBy("end_ms", "component_id").limit(CLOSURE_PAGE)


def due_components_remain(spark, sf_dir):
    """Shards with a component that is still due: none after draining, all with closed sessions before it."""
    accepted = _accepted(spark, sf_dir)
    shards = _shards(accepted)
    due = timeline.sessions(accepted, shards).where("closed")
    return shards.join(due, ["generation_id", "shard_id"], "left_semi").select("shard_id")


def outbox_page(spark, sf_dir):
    return page(engine.process_decoded(decoded(spark, sf_dir)).tables["outbox"])


def event_digest(spark, sf_dir):
    return _admitted(spark, sf_dir).where("rejected IS NULL").select("sequence_number", "canonical", "digest")


def raw_key(spark, sf_dir):
    return _admitted(spark, sf_dir).select("sequence_number", "raw_key")


def stable_ids(spark, sf_dir):
    rows = decoded(spark, sf_dir)
    parts = [json_string(F.col("shard_id")), json_string(F.col("event_id")), F.col("event_time_ms").cast("string")]
    return rows.select("sequence_number", stable_id("probe", *parts).alias("stable_id"), token("probe", *parts).alias("token"), sortable(F.col("event_time_ms")).alias("sortable"))


def disposition_log(spark, sf_dir):
    return engine.log_rows(engine.process_decoded(decoded(spark, sf_dir)).dispositions).drop("turn")


def event_rates(spark, sf_dir):
    """Counts behind the duplicate, conflict, late and quarantine rates, by shard."""
    every = engine.process_decoded(decoded(spark, sf_dir)).dispositions
    names = {"duplicates": "IDENTICAL_DUPLICATE", "conflicts": "IDENTITY_CONFLICT", "accepted_late": "accepted_late", "late": "LATE_BEYOND_WATERMARK", "expired": "EXPIRED_IDENTITY"}
    return every.groupBy("shard_id").agg(F.count("*").alias("records"), *[F.count_if(F.col("disposition") == v).alias(k) for k, v in names.items()])


def latency_percentiles(spark, sf_dir):
    """Nearest-rank percentiles of how long accepted events took to arrive, by event type."""
    rows = _accepted(spark, sf_dir).withColumn("latency_ms", F.col("ingest_time_ms") - F.col("event_time_ms"))
    return quality.nearest_rank(rows, ["event_type"], "latency_ms", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


def key_skew(spark, sf_dir):
    return quality.key_skew(decoded(spark, sf_dir), "user_id")


def hot_key_pressure(spark, sf_dir):
    rows = decoded(spark, sf_dir)
    each = [quality.key_skew(rows, k).select(F.lit(k).alias("dimension"), "hottest_count", "total", "hottest_ratio") for k in ("user_id", "shard_id")]
    return each[0].unionAll(each[1])


def _failing(spark, sf_dir):
    return with_order(decoded(spark, sf_dir)).withColumn("sequence", F.col("sequence_number").cast("bigint")).withColumn("fails", F.col("sequence") % 997 == 5)


def checkpoint_after_batch(spark, sf_dir):
    return quality.checkpoint(_failing(spark, sf_dir), ["batch_id", "shard_id"], "sequence", "fails")


def batch_item_failures(spark, sf_dir):
    _, failures = engine.before_failures(_failing(spark, sf_dir), "fails")
    return engine.batch_item_failures(failures).select("batch_id", F.concat_ws(",", "sequence_numbers").alias("sequence_numbers"))


def processed_before_failure(spark, sf_dir):
    kept, _ = engine.before_failures(_failing(spark, sf_dir), "fails")
    return kept.groupBy("batch_id", "shard_id").agg(F.count("*").alias("n"))


def replay_keys(spark, sf_dir):
    return quality.replay_keys("replay-1", _admitted(spark, sf_dir).where("rejected IS NULL"), True)


def archive_reconciliation(spark, sf_dir):
    """Objects that the records call for, against the archive."""
    rows = _admitted(spark, sf_dir).select(F.col("raw_key").alias("key")).distinct()
    return quality.reconcile(rows, _archived(spark, sf_dir), "key", ["key"]).groupBy("status").agg(F.count("*").alias("n"))


def coverage_orphans(spark, sf_dir):
    """Users with events and no aggregate, or the other way round."""
    rows = decoded(spark, sf_dir)
    return quality.orphans(rows, engine.process_decoded(rows).tables["user_aggregate"], "user_id")


def order_line_reconciliation(spark, sf_dir):
    """Orders against lines: how many keys each side has alone, and how many both have."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("key"))
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("key")).distinct()
    return quality.reconcile(orders, lines, "key", ["key"]).groupBy("status").agg(F.count("*").alias("n"))


def hash_chain_check(spark, sf_dir):
    """Events chained by hash within a user, every hundredth predecessor broken; the breaks that the check finds."""
    from pyspark.sql import Window

    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", F.concat_ws("|", F.col("event_id").cast("string"), "event_type").alias("content"))
    along = Window.partitionBy("user_id").orderBy("event_id")
    own = rows.withColumn("own", F.sha2("content", 256)).withColumn("ordinal", F.row_number().over(along))
    linked = own.withColumn("previous", F.when(F.col("event_id") % 100 == 0, "broken").otherwise(F.lag("own", 1, "GENESIS").over(along)))
    return quality.chain_faults(linked, ["user_id"], "ordinal", "previous", "own", F.col("content")).select("event_id", "previous_ok", "own_ok", "turn_ok")


def state_comparison(spark, sf_dir):
    """User aggregates against a copy in which some users are lost and others have a view more; what the digests lead to."""
    rows = staged(engine.process_decoded(decoded(spark, sf_dir)).tables["user_aggregate"], "aggregate")
    number = F.regexp_extract("user_id", "[0-9]+", 0).cast("bigint")
    changed = rows.where(number % 97 != 5).withColumn("views", F.col("views") + F.when(number % 97 == 6, 1).otherwise(0))
    return quality.differing(rows, changed, ["generation_id", "user_id"]).select("user_id", "status")


def shared_processes(spark, sf_dir):
    """Hours of the day, as processes, that served views and clicks of one user, as phases of one run."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type IN ('view', 'click')")
    return quality.shared_processes(rows.withColumn("process_id", F.hour("ts")), ["user_id"], "event_type", "process_id").select("user_id", "process_id", "phases")


def prefixed_pages(spark, sf_dir):
    """How many records' pages begin with P-1, in any case."""
    return quality.prefixed(decoded(spark, sf_dir), "page_id", "P-1")


RULES = [
    rules.Rule("$.k", "below", 90, "k is too large"), rules.Rule("$.kind", "one_of", ["view", "click", "purchase"], "kind is unknown"),
    rules.Rule("$.only", "only", "web", "source is not web alone"), rules.Rule("$.at", "fresh", 240, "event is old"),
]


def document_decisions(spark, sf_dir):
    """Events as JSON documents, judged by a table of rules: how many have which decision and findings."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    fields = F.struct(F.get_json_object("props", "$.k").cast("int").alias("k"), F.when(F.col("user_id") % 9 != 0, F.col("event_type")).alias("kind"), F.when(F.col("user_id") % 5 == 0, F.array(F.lit("web"), F.lit("app"))).otherwise(F.array(F.lit("web"))).alias("only"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"))
    documents = rows.select(F.try_parse_json(F.to_json(fields)).alias("document"), F.when(F.col("event_id") % 1000 == 3, "INVALID_JSON").alias("error"))
    judged = rules.decided(documents, RULES, F.lit("2024-01-31T00:00:00Z").cast("timestamp"))
    return judged.groupBy("decision", F.concat_ws(";", "findings").alias("findings")).agg(F.count("*").alias("n"))


def prohibited_key_scan(spark, sf_dir):
    """How often payload keys are prohibited, in the events' properties and in the records."""
    rows = _admitted(spark, sf_dir)
    return rows.groupBy(F.coalesce(prohibited(F.col("payload_keys")), F.lit(False)).alias("prohibited")).agg(F.count("*").alias("n"))


def exactly_one_resolution(spark, sf_dir):
    """Records by how many dispositions they have; one each."""
    every = engine.process_decoded(decoded(spark, sf_dir)).dispositions
    return every.groupBy("sequence_number").agg(F.count("*").alias("resolutions")).groupBy("resolutions").agg(F.count("*").alias("records"))


def dense_retry(spark, sf_dir):
    """Batches with failures, cut at them and applied: what the state holds then, by shard."""
    kept, _ = engine.before_failures(_failing(spark, sf_dir), "fails")
    return engine.process_decoded(kept.drop("turn", "sequence", "fails")).tables["shard_state"].select("shard_id", "max_event_time_ms", "version")


def incremental_state(spark, sf_dir):
    """User aggregates from two increments, the second one over the state that the first one left."""
    rows = decoded(spark, sf_dir)
    middle = 1
    first = engine.process_decoded(rows.where(F.col("batch_id") < middle))
    return engine.process_decoded(rows.where(F.col("batch_id") >= middle), first.tables).tables["user_aggregate"].drop("generation_id")


def _store(spark, sf_dir) -> StateTables:
    """State tables to which the records of in_increments() were added as three batches."""
    store = StateTables(spark, f"{shared_folder(spark)}/tidemark/state-{uuid.uuid4().hex}")
    for n, rows in enumerate(in_increments(spark, sf_dir)):
        add_decoded(store, rows, n)
    return store


def redelivered_over_batches(spark, sf_dir):
    """What three batches with an idle shard and a wrong clock make of each record: its commit, its quarantine row, and counts."""
    tables = _store(spark, sf_dir).load()
    commits = tables["processing_commit"].select(F.lit("commit").alias("kind"), F.col("commit_id").alias("id"), "disposition")
    isolated = tables["quarantine"].select(F.lit("quarantine").alias("kind"), F.col("quarantine_id").alias("id"), "disposition")
    counts = tables["shard_metric"].select(F.lit("count").alias("kind"), F.concat_ws(":", "shard_id", "disposition").alias("id"), F.col("n").cast("string").alias("disposition"))
    return commits.unionAll(isolated).unionAll(counts)


def open_sessions_over_batches(spark, sf_dir):
    """Sessions that are open after three batches, from the rows by which they began and ended."""
    store = _store(spark, sf_dir)
    return store.table("open_session").select("shard_id", "user_id", "start_ms", "end_ms")


def sessions_over_batches(spark, sf_dir):
    """Sessions that three batches closed: totals and members, from open events that lie by the hour."""
    return _store(spark, sf_dir).table("session_output").drop("generation_id", "output_version")


def latency_over_batches(spark, sf_dir):
    """latency_percentiles from the sums of three batches, with no event read again."""
    return quality.nearest_rank_of_counts(_store(spark, sf_dir).table("latency"), ["event_type"], "latency_ms", "n", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


def component_prefix_scan(spark, sf_dir):
    """Sortable range keys by prefix and upper bound, ascending: the ordered index scan."""
    accepted = _accepted(spark, sf_dir)
    found = timeline.sessions(accepted, _shards(accepted))
    keys = found.select(F.concat(F.lit("CLOSE#"), sortable(F.col("end_ms") + INACTIVITY_GAP_MS), F.lit("#"), "user_id").alias("sort_key"), "shard_id")
    low = found.agg(F.min("end_ms")).scalar()
    bounded = keys.where(F.col("sort_key").startswith("CLOSE#") & (F.col("sort_key") < F.concat(F.lit("CLOSE#"), sortable(low + 864_000_000))))
    return bounded.select("shard_id", "sort_key").orderBy("sort_key", "shard_id").limit(100)


def queries() -> dict:
    own = [
        decode_dispositions, decode_stream_dispositions, redelivered_in_batch, redelivered_aggregate, admission_dispositions, admission_counts, identity_dispositions, event_time_classification, shard_watermarks, session_islands, dense_sessions, component_match_range_join, member_containment_join,
        closure_page, due_components_remain, outbox_page, event_digest, raw_key, stable_ids, disposition_log, event_rates, latency_percentiles, key_skew, hot_key_pressure, checkpoint_after_batch,
        batch_item_failures, processed_before_failure, replay_keys, archive_reconciliation, coverage_orphans, order_line_reconciliation, hash_chain_check, prohibited_key_scan, exactly_one_resolution,
        dense_retry, incremental_state, component_prefix_scan, redelivered_over_batches, open_sessions_over_batches, sessions_over_batches, latency_over_batches,
        state_comparison, shared_processes, prefixed_pages, document_decisions,
    ]
    state = {
        "identity_ledger": _state("identity_ledger"), "shard_state": _state("shard_state"), "open_event": _state("open_event"), "open_sessions": _state("session_component"),
        "session_output": _state("session_output"), "user_aggregate": _state("user_aggregate"), "closure_work": _state("closure_work"), "quarantine": _state("quarantine"), "outbox": _state("outbox"),
        "processing_commit": _state("processing_commit"), "disposition_metrics": _state("metric"), "archive": archive,
    }
    return {f.__name__: f for f in own} | state


def _sql(rest: str, base: str = IDENT_SQL) -> str:
    return f"WITH {base.strip()} {rest}"


GEN = "'live-v1' AS generation_id"
SKEW = "SELECT {d} max(n) AS hottest_count, CAST(sum(n) AS BIGINT) AS total, CASE WHEN max(n) = sum(n) THEN '1' ELSE CAST(max(n) // gcd(max(n), CAST(sum(n) AS BIGINT)) AS VARCHAR) || '/' || CAST(CAST(sum(n) AS BIGINT) // gcd(max(n), CAST(sum(n) AS BIGINT)) AS VARCHAR) END AS hottest_ratio FROM (SELECT count(*) AS n FROM rec GROUP BY {k})"
FAIL_SQL = """, fl AS (SELECT *, seq % 997 = 5 AS fails FROM rec),
st AS (SELECT batch_id, shard_id, min(seq) FILTER (WHERE fails) AS stop FROM fl GROUP BY batch_id, shard_id)"""
CLOSURE_ID = """sha256('["1.0.0","component","live-v1","' || user_id || '",' || member_ids_json || ']')"""


def oracle_sql() -> dict[str, str]:
    q = {
        "admission_dispositions": "SELECT sequence_number, coalesce(rejected, 'ADMITTED') AS disposition, digest, raw_key FROM keyed",
        "admission_counts": "SELECT coalesce(rejected, 'ADMITTED') AS disposition, count(*) AS n FROM keyed GROUP BY 1",
        "identity_dispositions": "SELECT sequence_number, event_id, identity FROM ident",
        "event_time_classification": "SELECT event_id, shard_id, category, watermark_before_ms, watermark_after_ms FROM timed",
        "shard_watermarks": "SELECT shard_id, max_event_time_ms - 1800000 AS watermark_ms FROM wm",
        "session_islands": "SELECT event_id, user_id, CAST(island AS BIGINT) AS island FROM isl",
        "component_match_range_join": "SELECT a.event_id, s.start_ms, s.end_ms FROM acc a JOIN ses s ON a.shard_id = s.shard_id AND a.user_id = s.user_id AND a.event_time_ms BETWEEN s.start_ms - 1800000 AND s.end_ms + 1800000 WHERE a.category = 'accepted_late'",
        "member_containment_join": "SELECT shard_id, user_id, start_ms, end_ms, member_count AS members FROM ses",
        "closure_page": f"SELECT {CLOSURE_ID} AS component_id, shard_id, user_id, end_ms FROM clo WHERE closed ORDER BY end_ms, component_id LIMIT 20",
        "due_components_remain": "SELECT DISTINCT shard_id FROM clo WHERE closed",
        "event_digest": "SELECT sequence_number, canonical, digest FROM keyed WHERE rejected IS NULL",
        "raw_key": "SELECT sequence_number, raw_key FROM keyed",
        "stable_ids": """SELECT sequence_number, sha256(j) AS stable_id, left(sha256(j), 36) AS token, lpad(CAST(event_time_ms AS VARCHAR), 20, '0') AS sortable FROM (SELECT *, '["1.0.0","probe","' || shard_id || '","' || event_id || '",' || event_time_ms || ']' AS j FROM rec)""",
        "disposition_log": "SELECT disposition, mutated AS mutated_live_state, sequence_number, left(sha256(shard_id), 16) AS shard_hash FROM disp",
        "event_rates": "SELECT shard_id, count(*) AS records, count(*) FILTER (WHERE disposition = 'IDENTICAL_DUPLICATE') AS duplicates, count(*) FILTER (WHERE disposition = 'IDENTITY_CONFLICT') AS conflicts, count(*) FILTER (WHERE disposition = 'accepted_late') AS accepted_late, count(*) FILTER (WHERE disposition = 'LATE_BEYOND_WATERMARK') AS late, count(*) FILTER (WHERE disposition = 'EXPIRED_IDENTITY') AS expired FROM disp GROUP BY shard_id",
        "latency_percentiles": "SELECT event_type, CAST(quantile_disc(l, 0.5) AS BIGINT) AS p50, CAST(quantile_disc(l, 0.95) AS BIGINT) AS p95, CAST(quantile_disc(l, 0.99) AS BIGINT) AS p99, max(l) AS max FROM (SELECT event_type, ingest_time_ms - event_time_ms AS l FROM acc) GROUP BY event_type",
        "key_skew": SKEW.format(d="", k="user_id"),
        "hot_key_pressure": SKEW.format(d="'user_id' AS dimension,", k="user_id") + " UNION ALL " + SKEW.format(d="'shard_id' AS dimension,", k="shard_id"),
        "replay_keys": "SELECT DISTINCT 'replay-1:' || event_id AS replay_key FROM keyed WHERE rejected IS NULL",
        "archive_reconciliation": "SELECT 'MATCH' AS status, count(DISTINCT raw_key) AS n FROM keyed",
        "coverage_orphans": "SELECT user_id, 'left' AS side FROM (SELECT DISTINCT user_id FROM rec EXCEPT SELECT user_id FROM acc)",
        "prohibited_key_scan": "SELECT has_email AS prohibited, count(*) AS n FROM rec GROUP BY 1",
        "exactly_one_resolution": "SELECT r AS resolutions, count(*) AS records FROM (SELECT count(*) AS r FROM disp GROUP BY seq) GROUP BY 1",
        "identity_ledger": f"SELECT event_id, digest, ingest_time_ms AS first_ingest_ms, ingest_time_ms + 691200000 AS expiry_ms, {GEN}, category AS disposition FROM timed",
        "shard_state": f"SELECT shard_id, {GEN}, max_event_time_ms, version FROM wm",
        "open_event": f"SELECT i.shard_id, {GEN}, i.user_id, event_id, event_time_ms, event_type, i.value_cents, digest FROM isl i JOIN clo c USING (shard_id, user_id, island) WHERE NOT closed",
        "open_sessions": f"SELECT {CLOSURE_ID} AS component_id, shard_id, {GEN}, user_id, start_ms, end_ms, 1 AS version FROM clo WHERE NOT closed",
        "session_output": f"""SELECT sha256('["1.0.0","live-v1","' || user_id || '",' || member_ids_json || ']') AS session_id, {GEN}, user_id, start_ms, end_ms, member_count, member_ids_json, views, clicks, purchases, value_cents, 1 AS output_version FROM clo WHERE closed""",
        "user_aggregate": f"SELECT {GEN}, user_id, count(*) FILTER (WHERE event_type = 'view') AS views, count(*) FILTER (WHERE event_type = 'click') AS clicks, count(*) FILTER (WHERE event_type = 'purchase') AS purchases, CAST(sum(coalesce(value_cents, 0)) AS BIGINT) AS value_cents FROM acc GROUP BY user_id",
        "closure_work": f"""SELECT DISTINCT sha256('["1.0.0","closure-work","' || shard_id || '","live-v1",' || watermark_after_ms || ']') AS work_id, shard_id, {GEN}, watermark_after_ms AS watermark_ms, 'DONE' AS status FROM acc""",
        "quarantine": "SELECT * FROM quar",
        "outbox": """SELECT outbox_id, quarantine_id, '{"disposition":"' || disposition || '","outbox_id":"' || outbox_id || '","quarantine_id":"' || quarantine_id || '"}' AS body_json, 0 AS delivered FROM obox""",
        "outbox_page": """SELECT outbox_id, '{"disposition":"' || disposition || '","outbox_id":"' || outbox_id || '","quarantine_id":"' || quarantine_id || '"}' AS body_json FROM obox ORDER BY outbox_id LIMIT 20""",
        "processing_commit": f"""SELECT sha256('["1.0.0","commit","live-v1","' || event_id || '","' || digest || '"]') AS commit_id, {GEN}, event_id, source_hash, sequence_number, raw_key, CASE WHEN category = 'beyond_watermark' THEN 'LATE_BEYOND_WATERMARK' ELSE category END AS disposition, digest AS payload_digest FROM timed
          UNION ALL SELECT c, 'transport', c, source_hash, sequence_number, raw_key, rejected, digest FROM (SELECT *, sha256('["1.0.0","commit","transport","' || source_hash || '","' || sequence_number || '","' || digest || '"]') AS c FROM keyed WHERE rejected IS NOT NULL)""",
        "disposition_metrics": """SELECT 'EventDisposition' AS name, '{"disposition":"' || disposition || '"}' AS dimensions_json, count(*) AS value FROM disp GROUP BY disposition""",
        "archive": "SELECT raw_key AS key, sha256(min(canonical)) AS sha256, arg_min(shard_id, seq) AS shard_id, arg_min(sequence_number, seq) AS sequence_number FROM keyed GROUP BY raw_key",
        "incremental_state": "SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS views, count(*) FILTER (WHERE event_type = 'click') AS clicks, count(*) FILTER (WHERE event_type = 'purchase') AS purchases, CAST(sum(coalesce(value_cents, 0)) AS BIGINT) AS value_cents FROM acc GROUP BY user_id",
        "component_prefix_scan": "SELECT shard_id, k AS sort_key FROM (SELECT shard_id, 'CLOSE#' || lpad(CAST(end_ms + 1800000 AS VARCHAR), 20, '0') || '#' || user_id AS k FROM clo) WHERE k < (SELECT 'CLOSE#' || lpad(CAST(min(end_ms) + 864000000 AS VARCHAR), 20, '0') FROM clo) ORDER BY k, shard_id LIMIT 100",
    }
    out = {k: _sql(v) for k, v in q.items()}
    twice = IDENT_SQL.replace("\nmoved AS (SELECT *,", "\nmoved AS (SELECT copies.*,", 1).replace("FROM copies),", "FROM copies, range(CASE WHEN id % 3 = 0 THEN 2 ELSE 1 END) AS t(again)),", 1)
    far = IDENT_SQL.replace(RECORDS_SQL, FAR_SQL)
    out["redelivered_over_batches"] = _sql(
        f"SELECT 'commit' AS kind, commit_id AS id, disposition FROM ({q['processing_commit']}) UNION ALL SELECT 'quarantine', quarantine_id, disposition FROM quar UNION ALL SELECT 'count', shard_id || ':' || disposition, CAST(count(*) AS VARCHAR) FROM disp GROUP BY shard_id, disposition", far
    )
    out["open_sessions_over_batches"] = _sql("SELECT shard_id, user_id, start_ms, end_ms FROM clo WHERE NOT closed", far)
    out["sessions_over_batches"] = _sql(f"SELECT * EXCLUDE (generation_id, output_version) FROM ({q['session_output']})", far)
    out["latency_over_batches"] = _sql(q["latency_percentiles"], far)
    out["redelivered_in_batch"] = _sql("SELECT sequence_number, disposition, count(*) AS n FROM disp GROUP BY ALL", twice)
    out["redelivered_aggregate"] = _sql(q["incremental_state"], twice)
    out["decode_dispositions"] = _sql(FAULT_SQL)
    out["decode_stream_dispositions"] = _sql(RARE_FAULT_SQL)
    out["checkpoint_after_batch"] = _sql(FAIL_SQL + " SELECT f.batch_id, f.shard_id, max(seq) FILTER (WHERE stop IS NULL OR seq < stop) AS checkpoint FROM fl f JOIN st USING (batch_id, shard_id) GROUP BY 1, 2", RECORDS_SQL)
    out["batch_item_failures"] = _sql(FAIL_SQL + " SELECT batch_id, string_agg(CAST(stop AS VARCHAR), ',' ORDER BY shard_id) AS sequence_numbers FROM st WHERE stop IS NOT NULL GROUP BY batch_id", RECORDS_SQL)
    out["processed_before_failure"] = _sql(FAIL_SQL + " SELECT f.batch_id, f.shard_id, count(*) AS n FROM fl f JOIN st USING (batch_id, shard_id) WHERE stop IS NULL OR seq < stop GROUP BY 1, 2", RECORDS_SQL)
    cut = RECORDS_SQL.replace("rec AS (", "whole AS (", 1).replace("texts AS (", "rec AS (SELECT w.* FROM whole w WHERE NOT EXISTS (SELECT 1 FROM whole f WHERE f.seq % 997 = 5 AND f.batch_id = w.batch_id AND f.shard_id = w.shard_id AND f.seq <= w.seq)),\ntexts AS (", 1)
    out["dense_retry"] = _sql("SELECT shard_id, max_event_time_ms, version FROM wm", IDENT_SQL.replace(RECORDS_SQL, cut))
    dense = IDENT_SQL.replace("acc AS (SELECT * FROM timed", "acc AS (SELECT * REPLACE (right(user_id, 1) AS user_id) FROM timed")
    out["dense_sessions"] = _sql("SELECT shard_id, user_id, start_ms, end_ms, member_count, views, clicks, purchases, value_cents, closed FROM clo", dense)
    out["order_line_reconciliation"] = "SELECT CASE WHEN l.key IS NULL THEN 'MISSING' WHEN o.key IS NULL THEN 'EXTRA' ELSE 'MATCH' END AS status, count(*) AS n FROM (SELECT o_orderkey AS key FROM orders) o FULL JOIN (SELECT DISTINCT l_orderkey AS key FROM lineitem) l ON o.key = l.key GROUP BY 1"
    out["state_comparison"] = _sql("SELECT user_id, CASE WHEN n % 97 = 5 THEN 'MISSING' ELSE 'MISMATCH' END AS status FROM (SELECT DISTINCT user_id, CAST(substr(user_id, 3) AS BIGINT) AS n FROM acc) WHERE n % 97 IN (5, 6)")
    out["shared_processes"] = "SELECT user_id, CAST(hour(ts) AS INTEGER) AS process_id, count(DISTINCT event_type) AS phases FROM events WHERE event_type IN ('view', 'click') GROUP BY 1, 2 HAVING count(DISTINCT event_type) > 1"
    out["document_decisions"] = """WITH d AS (
      SELECT event_id % 1000 = 3 AS bad, user_id % 9 = 0 AS lacks, CAST(json_extract(props, '$.k') AS INTEGER) >= 90 AS large, event_type NOT IN ('view', 'click', 'purchase') AS unknown, user_id % 5 = 0 AS other, date_trunc('second', ts) < TIMESTAMP '2024-01-21 00:00:00' OR date_trunc('second', ts) > TIMESTAMP '2024-01-31 00:00:00' AS old FROM events),
    f AS (SELECT CASE WHEN bad OR lacks THEN 'INDETERMINATE' WHEN large OR unknown OR other OR old THEN 'NO_GO' ELSE 'ADMITTED' END AS decision,
      CASE WHEN bad THEN 'unreadable: INVALID_JSON' ELSE concat_ws(';', CASE WHEN old THEN 'event is old' END, CASE WHEN large THEN 'k is too large' END, CASE WHEN lacks THEN 'kind is unknown: nothing to judge' WHEN unknown THEN 'kind is unknown' END, CASE WHEN other THEN 'source is not web alone' END) END AS findings FROM d)
    SELECT decision, findings, count(*) AS n FROM f GROUP BY ALL"""
    out["prefixed_pages"] = _sql("SELECT count(*) FILTER (WHERE page_id LIKE 'p-1%') AS n FROM rec", RECORDS_SQL)
    out["hash_chain_check"] = "SELECT event_id, false AS previous_ok, true AS own_ok, true AS turn_ok FROM events WHERE event_id % 100 = 0"
    return out
