"""State tables by micro-batch, crash boundaries, the stream, replay, the outbox and failures."""

import hashlib
import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests.model import Model, dumps, event, record
from tests.test_engine import check, collected, frame, stream
from tidemark.functions.contract import IDENTITY_TTL_MS, LIVE, RECORD
from tidemark.operators import quality, recovery
from tidemark.operators.admission import admit
from tidemark.operators.decode import decode
from tidemark.plans import engine
from tidemark.sources.records import inventory, read_batches, read_documents, read_journal, records_of
from tidemark.sources.scratch import shared_folder
from tidemark.sources.store import StateTables, no_probe
from tidemark.streaming.run import export, journal_faults, run_batches
from tidemark.streaming.stream import Unsound, apply_batch, record_failure, replay, require_sound_rows, run_stream


class Crash(Exception):
    pass


def crash_at(name):
    def probe(boundary):
        no_probe(boundary)
        if boundary == name:
            raise Crash(name)

    return probe


EVENTS = [event("a", 10_000_000, "u"), event("b", 11_860_000, "u"), event("a", 10_000_001, "u"), event("c", 15_460_001, "v")]


def rows_of(events):
    return [record(e, i, position=i) for i, e in enumerate(events)]


def modelled(events):
    model = Model()
    for i, e in enumerate(events):
        model.apply(e, "s1", str(i))
    return model


def test_a_batch_survives_a_crash_at_each_boundary(spark, tmp_path):
    """One batch that crashes at each boundary in turn, and is delivered again each time."""
    root, rows = f"file://{tmp_path}/s", frame(spark, rows_of(EVENTS))
    for boundary in ("before_archive", "archived", "quarantined", "staged", "committed"):
        with pytest.raises(Crash):
            apply_batch(StateTables(spark, root, probe=crash_at(boundary)), rows, 0)
        assert StateTables(spark, root).last()[0] == (0 if boundary == "committed" else -1)
    again = StateTables(spark, root)
    apply_batch(again, rows, 0)
    check(again.load(), modelled(EVENTS))
    assert again.archive().count() == 4


def test_failed_records_come_again_after_a_crash(spark, tmp_path):
    rows = frame(spark, rows_of(EVENTS))
    root = f"file://{tmp_path}/s"
    with pytest.raises(Crash):
        apply_batch(StateTables(spark, root, probe=crash_at("partial_failure")), rows.withColumn("fails", F.col("sequence_number") == "1"), 0, "fails")
    store = StateTables(spark, root)
    # What came before the failure counts until the batch is delivered again.
    assert store.last() == (0, False) and store.load()["identity_ledger"].count() == 1
    assert apply_batch(store, rows.withColumn("fails", F.col("sequence_number") == "1"), 0, "fails") == [(0, ["1"])]
    assert apply_batch(store, rows, 0) == []
    check(store.load(), modelled(EVENTS))
    recovery.require_sound(store)


def written(root, batch):
    return sum(f.stat().st_size for f in Path(root).rglob(f"batch={batch}/*.parquet"))


def test_a_batch_writes_no_more_than_its_own_rows(spark, tmp_path):
    """Ten times the history, the same batch: the same bytes."""
    sizes = []
    for days in (1, 10):
        root = tmp_path / str(days)
        store = StateTables(spark, f"file://{root}")
        past = [event(f"p{i}", 10_000_000 + i * 7_200_000, f"u{i % 5}") for i in range(days * 12)]
        apply_batch(store, frame(spark, [record(e, i, position=i) for i, e in enumerate(past)]), 0)
        late = 10_000_000 + 200 * 7_200_000
        apply_batch(store, frame(spark, [record(event(f"n{i}", late + i, "v"), 1000 + i, batch=1, position=i) for i in range(5)]), 1)
        sizes.append(written(root, 1))
        assert store.load()["user_aggregate"].agg(F.sum("views")).first()[0] == days * 12 + 5
    assert sizes[1] < sizes[0] * 1.05


def by_batches(spark, root, batches, **more):
    store = StateTables(spark, f"file://{root}")
    for n, rows in enumerate(batches):
        apply_batch(store, frame(spark, rows), n, **more)
    return store


def test_redelivery_beside_a_wrong_clock(spark, tmp_path):
    """An event of another shard in the year 8307 between an event and its copy: the copy is one, and nothing stops."""
    a, far = event("a", 10_000_000, "u"), event("far", 200_000_000_000_000, "v")
    again = event("far", 11_000_000, "u")
    batches = [[record(a, 1, "s1", 0)], [record(far, 2, "s2", 1)], [record(a, 3, "s1", 2)], [record(again, 4, "s1", 3)]]
    store = by_batches(spark, tmp_path / "s", batches)
    model = Model()
    for rows, e, shard, seq in zip(batches, (a, far, a, again), ("s1", "s2", "s1", "s1"), "1234", strict=True):
        model.apply(e, shard, seq)
    check(store.load(), model)
    # An id whose open event lies in the far future is known, too, and only expired by its own time.
    assert model.told == ["on_time", "on_time", "IDENTICAL_DUPLICATE", "IDENTITY_CONFLICT"]


def test_redelivery_to_an_idle_shard(spark, tmp_path):
    """Shard A has an open event, C a closed session; B goes on for nine days. Copies of both are copies, and A's id stays taken."""
    day, first = 86_400_000, 700_000_000
    a, c, c2 = event("a", first, "u"), event("c", first, "v"), event("c2", first + day, "w")
    batches = [[record(a, 1, "A", 0), record(c, 2, "C", 0, 1), record(c2, 3, "C", 0, 2)]]
    batches += [[record(event(f"b{d}", first + d * day, "x"), 10 + d, "B", 1, d) for d in range(1, 10)]]
    batches += [[record(c, 30, "C", 2), record(a, 31, "A", 2, 1), record(event("a", first + 9 * day, "u"), 32, "B", 2, 2)]]
    store = by_batches(spark, tmp_path / "s", batches)
    metric = {r["dimensions_json"]: r["value"] for r in store.load()["metric"].collect()}
    assert metric == {'{"disposition":"on_time"}': 12, '{"disposition":"IDENTICAL_DUPLICATE"}': 2, '{"disposition":"EXPIRED_IDENTITY"}': 1}
    assert [r["disposition"] for r in store.load()["quarantine"].collect()] == ["EXPIRED_IDENTITY"]


def test_an_identity_stays_while_a_long_session_is_open(spark, tmp_path):
    """A session of ten days without a gap: its first event's id is taken all the time, though its shard's clock goes on."""
    gap, first = 1_800_000, 700_000_000
    steps = 10 * 86_400_000 // gap
    one = [record(event(f"e{i}", first + i * gap, "u"), i, "s1", 0, i) for i in range(steps)]
    store = by_batches(spark, tmp_path / "s", [one, [record(event("e0", first + steps * gap, "u"), steps, "s1", 1)]])
    tables = store.load()
    assert tables["open_event"].count() == steps and tables["session_component"].count() == 1
    assert [r["disposition"] for r in tables["quarantine"].collect()] == ["EXPIRED_IDENTITY"]


def test_an_identity_ends_by_its_own_time(spark, tmp_path):
    """Eight days after its first event an id of a closed session is free again; until then it is known."""
    first = 700_000_000
    close = event("z", first + 86_400_000, "u")
    again = [event("a", first + IDENTITY_TTL_MS - 1, "u"), event("a", first + IDENTITY_TTL_MS + 1, "u")]
    for late, want in zip(again, ("EXPIRED_IDENTITY", "on_time"), strict=True):
        store = by_batches(spark, tmp_path / want, [[record(event("a", first, "u"), 1, "s1", 0), record(close, 2, "s1", 0, 1)], [record(late, 3, "s1", 1)]])
        made = {r["dimensions_json"]: r["value"] for r in store.load()["metric"].collect()}
        assert made == ({'{"disposition":"on_time"}': 2, '{"disposition":"EXPIRED_IDENTITY"}': 1} if want != "on_time" else {'{"disposition":"on_time"}': 3})
    ledger = collected(store.load()["identity_ledger"], "event_id", "first_ingest_ms")
    assert ledger == [("a", first + IDENTITY_TTL_MS + 1), ("z", first + 86_400_000)]
    smaller = store.rebase(f"file://{tmp_path}/r", first + 2 * IDENTITY_TTL_MS)
    assert smaller.last() == (1, True) and [r["event_id"] for r in smaller.load()["identity_ledger"].collect()] == ["a"]
    for name in ("session_output", "open_event", "session_component", "user_aggregate"):
        assert collected(smaller.load()[name], *smaller.load()[name].columns) == collected(store.load()[name], *smaller.load()[name].columns)


def wild(seed, n=48):
    """Random events of three shards, of which one falls idle for days and one has a clock in the far future now and then."""
    rng, out, t = random.Random(seed), [], 700_000_000
    for i in range(n):
        t += rng.choice([60_000, 900_000, 1_800_001, 40_000_000])
        shard = rng.choice(["s1", "s2"]) if 8 < i < n - 8 else rng.choice(["s1", "s2", "idle"])
        at = t + (50_000_000_000_000 if rng.random() < 0.08 else 0)
        ev = event(f"e{i}", max(0, at - rng.choice([0, 0, 1_700_000, 9_000_000])), rng.choice("ab"), rng.choice(["view", "purchase"]))
        out.append((ev, "far" if at > t else shard, i))
        if rng.random() < 0.35:
            again, shard, _ = rng.choice(out)
            kind = rng.random()
            if kind < 0.2:
                again = again | {"payload": again["payload"] | {"campaign_id": "x"}}
            out.append((dict(again), shard if kind < 0.9 else rng.choice(["s1", "s2"]), i))
    return out


@pytest.mark.parametrize("seed", [3, 4])
def test_batches_equal_all_at_once(spark, tmp_path, seed):
    """Whatever idle shards and wrong clocks there are, batches give what the row-at-a-time model gives."""
    events, model, batches = wild(seed), Model(), []
    cuts = sorted(random.Random(seed).sample(range(1, len(events)), 2))
    for b, (i, j) in enumerate(zip([0, *cuts], [*cuts, len(events)], strict=True)):
        rows = sorted(((ev, s, seq, p) for p, (ev, s, seq) in enumerate(events[i:j])), key=lambda x: (x[1], x[2], x[3]))
        for ev, s, seq, _ in rows:
            model.apply(ev, s, str(seq))
        batches.append([record(ev, seq, s, b, p) for ev, s, seq, p in rows])
    store = by_batches(spark, tmp_path / "s", batches, conflicts="keep")
    check(store.load(), model)
    assert {r["dimensions_json"]: r["value"] for r in store.load()["metric"].collect()} == {dumps({"disposition": d}): model.told.count(d) for d in set(model.told)}


def folders(df, level):
    """The folders of a level (hour=..., day=..., part=...) that a frame's files lie in."""
    return sorted({x for f in df.inputFiles() for x in f.split("/") if x.startswith(f"{level}=")})


def test_a_batch_reads_what_its_time_can_meet(spark, tmp_path):
    """After thirty days of history a batch reads the ledger's days around it, the last hour's sessions and its date's objects."""
    day, first = 86_400_000, 700_000_000
    store = StateTables(spark, f"file://{tmp_path}/s")
    past = [event(f"p{d}-{u}", first + d * day + u, f"u{u}") for d in range(30) for u in range(3)]
    apply_batch(store, frame(spark, [record(e, i, position=i) for i, e in enumerate(past)]), 0)
    now = event("n", first + 29 * day + 10, "u1")
    valid = engine.ordered_strictly(admit(decode(frame(spark, [record(now, 1000, batch=1)]))))
    carried = store.carried(1)
    assert len(folders(store.rows("identity_ledger", 1), "day")) == 30
    known = carried.identities(valid)
    assert folders(known, "day") == sorted(f"day={d}" for d in range((first + 21 * day) // day, (first + 29 * day) // day + 1))
    shards = store.table("shard_state").withColumn("max_event_time_ms", F.col("max_event_time_ms") + 5)
    opened, changed = carried.opened(valid, shards)
    assert collected(opened, "event_id") == [("p29-1",)] and collected(changed, "user_id") == [("u1",)]
    assert len(folders(opened, "hour")) == 1 and len(folders(store.rows("open_event", 1), "hour")) == 30
    assert len(folders(store.open_sessions(1, [(first + 29 * day) // 3_600_000]), "hour")) == 1
    keys = spark.createDataFrame([(r["key"],) for r in store.archive().where(F.col("key").contains("p7-")).collect()], "key string")
    asked = store.archived(keys)
    assert len(folders(asked, "part")) == 1 and len(folders(store.archive(), "part")) == 30 and asked.count() == 3


def test_filters_of_open_events_are_as_large_as_their_ids_need(spark, tmp_path):
    """Events of thirty hours make thirty files, each with a Bloom filter of 64 KB at least; one of fixed size takes a megabyte."""
    many = [event(f"e{i}", 700_000_000 + i * 3_600_000, "u") for i in range(30)]
    by_batches(spark, tmp_path / "s", [[record(e, i, position=i) for i, e in enumerate(many)]])
    sizes = [p.stat().st_size for p in (tmp_path / "s").rglob("*.parquet") if "open_event" in str(p)]
    assert len(sizes) >= 30 and max(sizes) < 100_000


def test_a_session_that_closes_is_found_by_its_hour(spark, tmp_path):
    """Closing reads the sessions of the hour before the watermark alone, and tells which ended."""
    first, hour = 700_000_000, 3_600_000
    one = [event("a", first, "u"), event("b", first + 900_000, "v")]
    two = [event("c", first + 2 * hour, "w")]
    store = by_batches(spark, tmp_path / "s", [[record(e, i, position=i) for i, e in enumerate(one)], [record(two[0], 9, batch=1)]])
    assert collected(store.rows_of("open_session", 1), "user_id", "gone") == [("u", True), ("v", True), ("w", False)]
    assert collected(store.load()["session_component"], "user_id") == [("w",)] and store.load()["session_output"].count() == 2


def test_another_body_under_a_known_key_fails(spark, tmp_path):
    """Nothing of the batch is written; the same body again is no conflict and isn't written again."""
    one = event("a", 10_000_000, "u")
    other = dict(one, ingest_time_ms=one["ingest_time_ms"] + 5)
    store = by_batches(spark, tmp_path / "s", [[record(one, 1)], [record(one, 2, batch=1)]])
    assert store.rows("archive", 9).count() == 1
    with pytest.raises(Unsound, match="another body"):
        apply_batch(store, frame(spark, [record(other, 3, batch=2)]), 2)
    assert store.last() == (1, True) and store.load()["metric"].agg(F.sum("value")).first()[0] == 2
    with pytest.raises(Unsound, match="another body"):
        by_batches(spark, tmp_path / "t", [[record(one, 1), record(other, 2, position=1)]])
    apply_batch(store, frame(spark, [record(other, 3, batch=2)]), 2, conflicts="keep")
    assert store.archive().count() == 1 and store.load()["user_aggregate"].first()["views"] == 1


def test_a_batch_that_was_cut_off_leaves_nothing(spark, tmp_path):
    """The first attempt's rows lie in an hour that the second doesn't write; they don't count."""
    one, two = event("a", 10_000_000, "u"), event("b", 10_000_000 + 1_800_000, "u")
    store = StateTables(spark, f"file://{tmp_path}/s")
    rows = frame(spark, [record(one, 1), record(two, 2, position=1)])
    assert apply_batch(store, rows.withColumn("fails", F.col("sequence_number") == "2"), 0, "fails") == [(0, ["2"])]
    apply_batch(store, rows, 0)
    assert collected(store.load()["session_component"], "start_ms", "end_ms") == [(10_000_000, 11_800_000)]
    assert store.rows("open_session", 9).count() == 1


def test_a_batch_frees_its_scratch(spark, tmp_path):
    kept = shared_folder(spark).removeprefix("file://")
    before = set(Path(kept).rglob("*.parquet"))
    by_batches(spark, tmp_path / "s", [rows_of(EVENTS)])
    assert set(Path(kept).rglob("*.parquet")) <= before


def test_rates_and_percentiles_come_from_sums(spark, tmp_path):
    """Any split into batches gives the percentiles and rates of all events at once."""
    events = [e for e, _, _ in wild(7, 30)]
    rows = [record(e, i, "s1", 0, i) for i, e in enumerate(events)]
    whole = engine.process(frame(spark, rows))
    store = by_batches(spark, tmp_path / "s", [[(b, *r[1:]) for r in rows[i:j]] for b, (i, j) in enumerate(((0, 7), (7, 8), (8, len(rows))))], conflicts="keep")
    ranks = {"p50": 0.5, "p95": 0.95}
    got = quality.nearest_rank_of_counts(store.load()["latency"], ["event_type"], "latency_ms", "n", ranks)
    latency = whole.dispositions.where("mutated").count()
    assert store.load()["latency"].agg(F.sum("n")).first()[0] == latency
    assert collected(got, *got.columns) == collected(quality.nearest_rank_of_counts(whole.tables["latency"], ["event_type"], "latency_ms", "n", ranks), *got.columns)
    assert collected(store.load()["shard_metric"], "disposition", "n") == sorted(tuple(r) for r in whole.dispositions.groupBy("disposition").count().collect())


def test_unsound_rows_are_not_written_as_done(spark, tmp_path):
    store = StateTables(spark, f"file://{tmp_path}/s")
    added = engine.process(frame(spark, rows_of(EVENTS)), store.carried(0)).added
    with pytest.raises(Unsound):
        store.write(0, added | {"identity_ledger": added["identity_ledger"].unionAll(added["identity_ledger"])}, check=require_sound_rows)
    assert store.last()[0] == -1
    apply_batch(store, frame(spark, rows_of(EVENTS)), 0)
    check(store.load(), modelled(EVENTS))


def test_archived_bodies_are_read_by_key(spark, tmp_path):
    store = by_batches(spark, tmp_path / "s", [rows_of(EVENTS[:1])])
    key = store.archive().first()["key"]
    assert json.loads(store.read(key)) == EVENTS[0]
    with pytest.raises(KeyError):
        store.read("../../etc/passwd")


def test_stream_equals_batch_and_redelivery_is_harmless(spark, tmp_path):
    events = [e for e, _, _ in stream(5, 12)]
    source = tmp_path / "in"
    source.mkdir()
    for i, e in enumerate(events):
        row = dict(zip([c.split()[0] for c in RECORD.split(", ")], record(e, i, position=i), strict=True))
        row.pop("batch_id")
        (source / f"{i // 8}.json").open("a").write(json.dumps(row) + "\n")
    ddl = RECORD.replace("batch_id bigint, ", "")
    store = StateTables(spark, f"file://{tmp_path}/s")
    run_stream(spark.readStream.schema(ddl).json(str(source)), store, f"file://{tmp_path}/c").awaitTermination()
    check(store.load(), modelled(events))
    last = store.last()
    run_stream(spark.readStream.schema(ddl).json(str(source)), store, f"file://{tmp_path}/c2").awaitTermination()
    assert store.last() == last


def test_outbox_is_delivered_at_least_once(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    apply_batch(StateTables(spark, root), frame(spark, rows_of(EVENTS)), 0)
    with pytest.raises(Crash):
        recovery.drain_outbox(StateTables(spark, root, probe=crash_at("published")))
    store = StateTables(spark, root)
    assert recovery.drain_outbox(store) == 1
    assert recovery.drain_outbox(store) == 0
    assert sorted(r["attempt"] for r in store.published().collect()) == [1, 2]
    assert [r["delivered"] for r in store.load()["outbox"].collect()] == [1]
    for batch in (None, 0):
        with pytest.raises(ValueError, match="unknown"):
            recovery.mark_delivered(store, spark.createDataFrame([("none",)], "outbox_id string"), batch)


def test_delivery_goes_on_where_it_was(spark, tmp_path):
    """Three batches of poison, pages of two: a page reads its own batch's outbox, and a batch that is done no more."""
    bad = lambda b, i: record(event(f"x{b}-{i}", 10_000_000, "u") | {"payload": {"email": "e"}}, b * 10 + i, batch=b, position=i)
    store = by_batches(spark, tmp_path / "s", [[bad(b, i) for i in range(3)] for b in range(3)])
    counts, left = [], []
    while n := recovery.drain_outbox(store, 2):
        counts.append(n)
        left.append(store.undrained())
    assert counts == [2, 1, 2, 1, 2, 1] and left == [[0, 1, 2], [0, 1, 2], [1, 2], [1, 2], [2], [2]] and store.undrained() == []
    assert store.published().count() == 9 == store.load()["outbox"].where("delivered = 1").count()
    assert all("/batch=1/" in f for f in store.undelivered(1).inputFiles())
    one = store.load()["outbox"].select("outbox_id").limit(1)
    recovery.mark_delivered(store, one)
    assert store.load()["outbox"].count() == 9


def test_failures_block_success_until_they_are_adjudicated(spark, tmp_path):
    store = StateTables(spark, f"file://{tmp_path}/s")
    recovery.require_no_unresolved(store.load()["failure_destination"])
    with pytest.raises(Crash):
        record_failure(StateTables(spark, store.root, probe=crash_at("failure_recorded")), "inv-1", "7", b"{}")
    key = record_failure(store, "inv-1", "7", b"{}")
    assert key.startswith("failure/invocation_id=inv-1/") and key.endswith(".json")
    record_failure(store, "inv-1", "7", b"{}")
    assert recovery.unresolved(store.load()["failure_destination"]) == 1
    with pytest.raises(ValueError):
        recovery.require_no_unresolved(store.load()["failure_destination"])
    with pytest.raises(ValueError):
        record_failure(store, "inv-1", "8", b"{}")


def requests(store, spark, **change):
    rows = store.archive().where("event_digest IS NOT NULL").select(F.col("key").alias("raw_key"), F.col("sha256").alias("expected_body_sha256"), F.col("event_digest").alias("expected_event_digest"), F.lit("inv-9").alias("invocation_id"))
    return rows.withColumns({k: F.lit(v) for k, v in change.items()})


def test_replay(spark, tmp_path):
    store = StateTables(spark, f"file://{tmp_path}/s")
    apply_batch(store, frame(spark, rows_of(EVENTS)), 0)
    same = replay(store, requests(store, spark), LIVE)
    assert {r["disposition"] for r in same.dispositions.select("disposition").distinct().collect()} == {"IDENTICAL_DUPLICATE", "IDENTITY_CONFLICT"}
    # Every request twice: what comes twice is applied once.
    replay(store, requests(store, spark).union(requests(store, spark)), "replay-1")
    live, other = store.load(), store.of("replay-1").load()
    for table in ("session_output", "user_aggregate", "open_event"):
        plain = [c for c in live[table].columns if c not in ("generation_id", "session_id")]
        assert collected(live[table], *plain) == collected(other[table], *plain)
    assert {r["generation_id"] for r in other["session_output"].collect()} == {"replay-1"}
    with pytest.raises(ValueError):
        replay(store, requests(store, spark, expected_body_sha256="x").limit(1), "replay-2")
    assert recovery.unresolved(store.load()["failure_destination"]) == 1
    assert store.of("replay-2").load()["identity_ledger"].count() == 0
    assert recovery.state_faults(store.load()).count() == 0 == recovery.state_faults(store.of("replay-1").load()).count()
    with pytest.raises(ValueError):
        recovery.require_sound(store)


def test_batch_files_and_other_sources(spark, tmp_path):
    one = {"Records": [{"eventID": "shard:a:7", "eventSourceARN": "arn:x", "kinesis": {"partitionKey": "u", "sequenceNumber": "7", "data": record(EVENTS[0], 7)[6]}}]}
    (tmp_path / "b").mkdir()
    (tmp_path / "b/1.json").write_text(json.dumps(one, indent=1))
    (tmp_path / "b/2.json").write_text(json.dumps(one))
    got = records_of(read_batches(spark, f"{tmp_path}/b")).collect()
    assert sorted((r["batch_id"], r["shard_id"], r["sequence_number"]) for r in got) == [(0, "shard:a", "7"), (1, "shard:a", "7")]
    (tmp_path / "c").mkdir()
    one["Records"][0]["eventID"] = ""
    (tmp_path / "c/1.json").write_text(json.dumps(one))
    with pytest.raises(Exception, match="eventID"):
        records_of(read_batches(spark, f"{tmp_path}/c")).collect()
    (tmp_path / "b/3.json").write_text('{"a": {"b": 1, "b": 2}}')
    (tmp_path / "b/4.json").write_text('{"a": 1} trailing')
    (tmp_path / "b/5.json").write_bytes(b'"\xff"')
    found = {r["path"][-6:]: (r["error"], r["got"]) for r in read_documents(spark, f"{tmp_path}/b").select("path", "error", F.col("document").isNotNull().alias("got")).collect()}
    assert found == {"1.json": (None, True), "2.json": (None, True), "3.json": ("DUPLICATE_JSON_KEY", False), "4.json": ("INVALID_JSON", False), "5.json": ("INVALID_UTF8", False)}
    listed = inventory(spark, f"{tmp_path}/b").orderBy("path").collect()
    assert [r["path"] for r in listed] == ["1.json", "2.json", "3.json", "4.json", "5.json"] and listed[2]["size_bytes"] == 23


def test_batch_runner_and_export(spark, tmp_path):
    (tmp_path / "b").mkdir()
    for i, e in enumerate(EVENTS):
        one = {"Records": [{"eventID": f"s1:{i}", "eventSourceARN": "arn:x", "kinesis": {"partitionKey": e["partition_key"], "sequenceNumber": str(i), "data": record(e, i)[6]}}]}
        (tmp_path / f"b/{i}.json").write_text(json.dumps(one))
    store = run_batches(spark, f"{tmp_path}/b", f"file://{tmp_path}/s")
    check(store.load(), modelled(EVENTS))
    export(store, f"{tmp_path}/out")
    lines = [json.loads(x) for f in sorted((tmp_path / "out/session_output").glob("*.json")) for x in f.read_text().splitlines()]
    assert [x["session_id"] for x in lines] == sorted(modelled(EVENTS).sessions)
    assert {p.name for p in (tmp_path / "out").iterdir()} >= {"archive", "channel", "failure_destination", "identity_ledger"}


def test_journal_rows_are_chained(spark, tmp_path):
    steps = [("r", i, f"step {i}", "crash" if i < 3 else "restart", 7 if i < 3 else 8) for i in range(1, 6)] + [("q", 1, "x", "crash", 7), ("q", 2, "y", "restart", 7)]
    rows = spark.createDataFrame(steps, "run_id string, ordinal bigint, boundary string, phase string, process_id bigint")
    chain = quality.chained(rows, ["run_id"], "ordinal", "boundary").join(rows.select("run_id", "ordinal", "phase", "process_id"), ["run_id", "ordinal"])
    chain.write.json(f"{tmp_path}/j")
    read = read_journal(spark, f"{tmp_path}/j")
    content = F.concat("previous_sha256", F.lit("\n"), "boundary")
    faults = lambda x: quality.chain_faults(x, ["run_id"], "ordinal", "previous_sha256", "entry_sha256", content)
    assert read.count() == 7 and faults(read).count() == 0
    changed = read.withColumn("boundary", F.when(F.col("ordinal") == 3, "else").otherwise(F.col("boundary")))
    assert [r["ordinal"] for r in faults(changed).collect()] == [3]
    assert [r["ordinal"] for r in faults(read.where("ordinal <> 2")).collect()] == [3, 4, 5]
    # A restart by the process that crashed is found, and goes with the export.
    assert collected(journal_faults(read), "run_id", "fault") == [("q", "process")]
    store = by_batches(spark, tmp_path / "s", [rows_of(EVENTS[:1])])
    export(store, f"{tmp_path}/out", f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/out/journal").count() == 7 and spark.read.json(f"{tmp_path}/out/journal_faults").first()["fault"] == "process"


def test_a_long_chain_is_one_fold(spark):
    """A run of 200,000 entries: each hash follows the one before, over the borders of Arrow batches too."""
    n = 200_000
    chain = quality.chained(spark.range(1, n + 1).select(F.lit("r").alias("run"), F.col("id").alias("ordinal"), F.col("id").cast("string").alias("content")), ["run"], "ordinal", "content")
    rows = {r["ordinal"]: r for r in chain.where("ordinal % 9999 < 2 OR ordinal > 199990").collect()}
    last = "GENESIS"
    for i in range(1, n + 1):
        if i in rows:
            assert rows[i]["previous_sha256"] == last
        last = hashlib.sha256(f"{last}\n{i}".encode()).hexdigest()
        assert i not in rows or rows[i]["entry_sha256"] == last


