"""The plans against a row-at-a-time model, fixed values and the contract's boundaries."""

import base64
import json
import random

import pytest
from pyspark.sql import functions as F

from tests.model import Model, dumps, event, record, sha, sid
from tidemark.functions.contract import RECORD
from tidemark.operators.decode import decoded
from tidemark.plans import engine


def frame(spark, records):
    return spark.createDataFrame(records, RECORD)


def stream(seed, n=60):
    """Random events: disorder, duplicates, conflicts, expiry, three shards and a few users."""
    rng, out = random.Random(seed), []
    t = 700_000_000
    for i in range(n):
        t += rng.choice([0, 60_000, 900_000, 1_800_000, 1_800_001, 4_000_000])
        ev = event(f"e{rng.randrange(n * 2 // 3)}", max(0, t - rng.choice([0, 0, 0, 1_700_000, 1_800_000, 1_800_001, 9_000_000])), rng.choice("abc"), rng.choice(["view", "click", "purchase"]))
        if rng.random() < 0.1:
            ev["ingest_time_ms"] += rng.choice([1, 604_000_000])
        out.append((ev, rng.choice(["s1", "s2"]), i))
        if rng.random() < 0.15:
            again = dict(rng.choice(out)[0])
            if rng.random() < 0.3:
                again |= {"ingest_time_ms": again["ingest_time_ms"] + 604_800_001, "event_time_ms": again["event_time_ms"] + 604_800_001}
            out.append((again, rng.choice(["s1", "s2"]), i))
        if rng.random() < 0.2:
            out.append(out[-1])  # delivered again under the same coordinates
    return out


def collected(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def check(tables, model):
    assert collected(tables["shard_state"], "shard_id", "max_event_time_ms", "version") == sorted((s, m, model.version[s]) for s, m in model.top.items())
    assert collected(tables["open_event"], "event_id", "shard_id", "user_id", "event_time_ms") == sorted((e, *r[:3]) for e, r in model.open.items())
    assert collected(tables["session_output"], "session_id", "user_id", "start_ms", "end_ms", "member_count", "member_ids_json", "views", "clicks", "purchases", "value_cents") == sorted((k, *v) for k, v in model.sessions.items())
    assert collected(tables["user_aggregate"], "user_id", "views", "clicks", "purchases", "value_cents") == sorted((u, *v) for u, v in model.users.items())
    assert collected(tables["quarantine"], "quarantine_id", "disposition", "sequence_number", "payload_digest") == sorted((k, *v) for k, v in model.quarantine.items())
    assert collected(tables["closure_work"], "shard_id", "watermark_ms") == sorted(model.work)
    assert collected(tables["processing_commit"], "commit_id", "disposition") == sorted(model.commits.items())
    assert collected(tables["identity_ledger"], "event_id", "digest", "first_ingest_ms") == sorted((k, *v) for k, v in model.ledger.items())
    assert collected(tables["outbox"], "quarantine_id", "delivered") == sorted((k, 0) for k in model.quarantine)


@pytest.mark.parametrize("seed", [1, 2])
def test_model_whole_and_by_increments(spark, seed):
    events = stream(seed)
    batches = [events[:25], events[25:26], events[26:]] if seed % 2 else [events[:40], events[40:]]
    model, rows = Model(), []
    for b, batch in enumerate(batches):
        # Positions restart in each file of a batch, so they repeat, too; equal coordinates go by digest.
        own = [(ev, s, i, p // 9) for p, (ev, s, i) in enumerate(batch)]
        own = [(ev, s, i, next(q for e2, s2, i2, q in own if (s2, i2) == (s, i) and e2 == ev)) for ev, s, i, _ in own]
        for ev, s, i, p in sorted(own, key=lambda x: (x[1], x[2], x[3], sha(dumps({k: v for k, v in x[0].items() if k != "ingest_time_ms"})), x[0]["ingest_time_ms"])):
            model.apply(ev, s, str(i))
        rows.append([record(ev, i, s, b, p) for ev, s, i, p in own])
    whole = engine.process(frame(spark, sum(rows, [])))
    check(whole.tables, model)
    assert sorted(r[0] for r in whole.dispositions.select("disposition").collect()) == sorted(model.told)
    state = None
    for batch in rows:
        state = engine.process(frame(spark, batch), state).tables
    check(state, model)
    metric = {r["dimensions_json"]: r["value"] for r in state["metric"].collect()}
    assert metric == {dumps({"disposition": d}): model.told.count(d) for d in set(model.told)}


def test_fixed_ids():
    # Fixed values of the contract's example.
    assert sid("live-v1", "user-v", ["vertical-view"]) == "5c8ecb7b1c44638ed766629423a14b256082478671f9ceb417faa7bb74055e89"
    assert sid("closure-work", "shard-a", "live-v1", 12200001) == "043834d40f3481dac56df48dfd92527f3fc337c126de2c30e4c799b19fbc623c"
    assert sid("component", "live-v1", "user-w", ["vertical-advance"]) == "ddbd426fda282bc9255bdaf1956c12845b78eaf9c764d1c4ded55d5ef2a1131a"


def test_example_batch_matches_fixed_values(spark):
    view = event("vertical-view", 10_000_000, "user-v")
    advance = event("vertical-advance", 14_000_001, "user-w", "purchase", value_cents=2500)
    poison = event("vertical-poison", 10_001_000, "user-q")
    poison["payload"] = {"email": "blocked@example.invalid"}
    rows = [record(e, n, "shard-a", 0, i) for i, (e, n) in enumerate([(view, 100), (poison, 101), (advance, 102)])]
    out = engine.process(frame(spark, rows))
    assert collected(out.tables["session_output"], "session_id", "user_id", "views") == [("5c8ecb7b1c44638ed766629423a14b256082478671f9ceb417faa7bb74055e89", "user-v", 1)]
    assert collected(out.tables["identity_ledger"], "digest")[0][0] == "280db592e2033ee83cbb25201192a7b3792780f04f3652049343e8731e833dd9"
    assert collected(out.tables["closure_work"], "watermark_ms", "status") == [(8_200_000, "DONE"), (12_200_001, "DONE")]
    assert [r[0] for r in out.dispositions.orderBy("turn").select("disposition").collect()] == ["on_time", "PRIVACY_VIOLATION", "on_time"]


@pytest.mark.parametrize(
    ("text", "failure"),
    [
        ("@@", "CORRUPT_BASE64"), ("YWJj\n", "CORRUPT_BASE64"), ("YWI", "CORRUPT_BASE64"), (None, "CORRUPT_BASE64"), ("/w==", "INVALID_UTF8"),
        ('{"a":1,"a":2}', "DUPLICATE_JSON_KEY"), ('{"a":{"b":1,"b":2}', "DUPLICATE_JSON_KEY"), ("{", "INVALID_JSON"), ("{} x", "INVALID_JSON"), ("{'a':1}", "INVALID_JSON"), ("[1]", "NON_OBJECT_JSON"),
    ],
)
def test_decode_failures(text, failure):
    encoded = text if failure in ("CORRUPT_BASE64", "INVALID_UTF8") else base64.b64encode(text.encode()).decode()
    got = decoded(encoded)
    assert got["failure"] == failure
    assert got["body"] == ((text or "").encode() if failure == "CORRUPT_BASE64" else base64.b64decode(encoded))


def dispositions(spark, records):
    out = engine.process(frame(spark, records)).dispositions
    return [r[0] for r in out.orderBy("turn").select("disposition").collect()]


def test_admission_in_the_contracts_order(spark):
    base = event("evt-base", 1_000_000, "user-1")

    def case(**patch):
        return base | patch

    cases = [
        (case(event_id="ok1"), "on_time"),
        (case(event_id="ok2", event_type="click"), "on_time"),
        (case(event_id="ok3", event_type="purchase", payload={"campaign_id": "fall", "value_cents": 2599}), "on_time"),
        (case(schema_version="2.0.0"), "INVALID_SCHEMA"),
        ({k: v for k, v in base.items() if k != "event_id"}, "INVALID_SCHEMA"),
        (case(unexpected="x"), "INVALID_SCHEMA"),
        (case(event_type="purchase"), "INVALID_SCHEMA"),
        (case(payload={"page_id": "home", "value_cents": 1}), "INVALID_SCHEMA"),
        (case(event_id="evt\n"), "INVALID_SCHEMA"),
        (case(event_time_ms=True), "INVALID_SCHEMA"),
        (case(event_time_ms=2**63), "INVALID_SCHEMA"),
        (case(event_time_ms=1.0), "INVALID_SCHEMA"),
        (case(payload={"page_id": 1.5, "email": "x"}), "INVALID_SCHEMA"),
        (case(payload={"email": "x"}), "PRIVACY_VIOLATION"),
        (case(source="a" * 17_000), "EVENT_TOO_LARGE"),
        (case(source="a" * 17_000, payload={"email": "x"}), "EVENT_TOO_LARGE"),
        (case(partition_key="other"), "PARTITION_MISMATCH"),
        (case(event_id="ok4", event_time_ms=1_060_000), "on_time"),
        (case(event_time_ms=1_060_001), "FUTURE_CLOCK"),
        (case(event_id="ok5", event_time_ms=0, ingest_time_ms=604_800_000), "on_time"),
        (case(event_time_ms=0, ingest_time_ms=604_800_001), "TOO_OLD"),
        (case(payload={"page_id": ""}), "INVALID_SCHEMA"),
        (case(event_id="ok6", payload={"page_id": "é\u000b\u001f\"\\ü"}), "on_time"),
    ]
    # One shard for each, so that none is late.
    rows = [record(ev, i, f"s{i:02d}", 0, i, key=ev["partition_key"]) for i, (ev, _) in enumerate(cases)]
    rows.append(record(base, 99, "s99", 0, 99, key="someone-else"))
    assert dispositions(spark, rows) == [d for _, d in cases] + ["PARTITION_MISMATCH"]


def test_native_canonical_form_equals_decoded(spark):
    from tidemark.functions.canonical import canonical_event, json_string
    from tidemark.operators.decode import decode

    texts = ['q"\\/', "\u0000\u0001\u0008\u000b\u000c\u001f\n\r\t", "é ü 日本 🙂   \x7f", "\\u000B", "\\\\u001F\u001f"]
    rows = [record(event(f"e{i}", 5, "u", "view", page_id=x), i) for i, x in enumerate(texts)]
    got = decode(frame(spark, rows)).select(canonical_event(True).alias("a"), "canonical", canonical_event(False).alias("b"), "semantic", json_string(F.col("page_id")).alias("c"), "page_id").collect()
    for r in got:
        assert (r["a"], r["b"], r["c"]) == (r["canonical"], r["semantic"], dumps(r["page_id"]))


def test_sequences_order_by_number_and_failures_stop_their_shard(spark):
    ids = ["10", "9", "0009", "x", "12345678901234567890123456789012345678901234567890"]
    rows = [record(event(f"e{i}", 1_000_000 + i), s, "s1" if i else "s2", 0, i) for i, s in enumerate(ids)]
    ordered = engine.with_order(frame(spark, rows)).orderBy("turn").select("sequence_number").collect()
    assert [r[0] for r in ordered] == ["9", "0009", "12345678901234567890123456789012345678901234567890", "x", "10"]
    kept, failures = engine.before_failures(engine.with_order(frame(spark, rows)).withColumn("fails", F.col("sequence_number").isin("0009", "x", "10")), "fails")
    assert collected(kept, "sequence_number") == [("9",)]
    assert [list(r["sequence_numbers"]) for r in engine.batch_item_failures(failures).collect()] == [["0009", "10"]]


def test_rejected_keys_encode_their_coordinates(spark):
    rows = [record(event("e", 5), "a b*~/1", "sh ard:x", text="@@")]
    got = engine.process(frame(spark, rows)).tables["archive"].first()
    assert got["key"] == f"rejected/source={sha('arn:x')}/shard=sh%20ard%3Ax/sequence=a%20b%2A~%2F1/transport={sha('@@')}.bin"
    assert bytes(got["body"]) == b"@@" and got["metadata"] == {"disposition": "CORRUPT_BASE64", "representation": "transport_text"}


def test_a_record_delivered_twice_in_a_batch_counts_once(spark):
    rows = [record(event("e1", 10_000_000, "u", "purchase"), 5)] * 2
    out = engine.process(frame(spark, rows).repartition(2))
    assert collected(out.tables["user_aggregate"], "purchases", "value_cents") == [(1, 5)]
    assert out.tables["identity_ledger"].count() == out.tables["open_event"].count() == 1
    assert sorted(r[0] for r in out.dispositions.select("disposition").collect()) == ["IDENTICAL_DUPLICATE", "on_time"]


def test_a_hot_shard_of_one_batch_spans_ranges(spark):
    from tidemark.operators.ordering import in_ranges, previous_max

    rows = spark.range(4000).select(F.lit("g").alias("k"), F.col("id").alias("at"), (F.col("id") * 7919 % 4001).alias("v"))
    sizes = [r["count"] for r in in_ranges(rows, ["k"], ["at"]).groupBy("block").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2000
    top, want = None, {}
    for i in range(4000):
        want[i] = top
        top = max(top or 0, i * 7919 % 4001)
    assert {r["at"]: r["m"] for r in previous_max(rows, ["k"], ["at"], "v", "m").collect()} == want


def test_written_records_hold_nothing_twice(spark):
    """What follows from a record's turn is added after it is read, and only a batch that archives writes bodies."""
    from tidemark.operators.admission import admit
    from tidemark.operators.decode import decode

    rows = admit(decode(frame(spark, [record(event("a", 700_000_000, "u"), 1), record(event("b", 700_000_001, "v") | {"source": "?"}, 2, position=1)])))
    written = engine.in_order(rows)
    assert not {"raw_key", "digest", "source_hash", "batch_id", "object", "root_keys", "canonical"} & set(written.columns)
    assert "object" in engine.in_order(rows, objects=True).columns
    columns = ["batch_id", "digest", "ingest_time_ms", "source_hash", "raw_key", "rejected"]
    assert sorted(engine.told(written).select(*columns).collect()) == sorted(rows.select(*columns).collect())
    assert "Aggregate" not in engine.empty_state(spark)["archive"].join(rows.select(F.col("raw_key").alias("key")).distinct(), "key")._jdf.queryExecution().optimizedPlan().toString()
    kept = rows.unionAll(rows.withColumn("object", F.encode(F.lit("other"), "utf-8")).where("rejected IS NULL"))
    assert sorted(r["bodies"] for r in engine.object_rows(engine.in_turn(kept)).collect()) == [1, 2]


def test_decode_natively_and_strictly_agree(spark):
    from tidemark.functions.contract import DECODED
    from tidemark.operators import decode as d

    base = event("e1", 5, "u", "purchase", campaign_id="é \"q\" \u000b\\")
    texts = [dumps(base), dumps(base | {"payload": {}}), json.dumps(base), dumps(base | {"user_id": 5}), dumps(base | {"payload": None}), dumps(base | {"extra": 1}), dumps(base).replace("5", "5.0", 1), dumps(base | {"event_time_ms": 2**70}), dumps(base) + " ", "{}", "[]", '{"a":"\\ud800"}']
    plain = [base64.b64encode(x.encode()).decode() for x in texts]
    plain += [plain[0] + "\n", plain[0][:-1], "*" + plain[0], None, "", base64.b64encode(b"\xff{}").decode()]
    rows = frame(spark, [(0, i, "arn:x", "s", str(i), "u", x) for i, x in enumerate(plain)])
    names = [x.split()[0] for x in DECODED.split(", ")]
    native = [r["native"] for r in d._natively(rows)[0].orderBy("r.position").collect()]
    assert native == [True, True] + [False] * (len(plain) - 2)
    for r in d.decode(rows).collect():
        want = d.decoded(r["transport_text"])
        assert {n: r[n] for n in names} == {n: want.get(n) for n in names}, r["transport_text"]


@pytest.mark.parametrize("native", [[], [True, True], [False], [True, False, True, False, False]])
def test_decoded_texts_stand_at_their_places_among_native_ones(native):
    import pyarrow as pa

    from tidemark.operators import decode as d

    texts = [None if done else base64.b64encode(dumps(event(f"e{i}", i, "u", "view")).encode()).decode() if i % 2 else "*" for i, done in enumerate(native)]
    got = d._column(pa.array(texts, pa.string()), pa.array(native, pa.bool_())).to_pylist()
    assert got == [{n: None if done else d.decoded(x).get(n) for n, _ in d.FIELDS} for x, done in zip(texts, native, strict=True)]


def test_long_runs_of_backslashes(spark):
    from tidemark.functions.canonical import json_string

    texts = ["\\" * n + "\u000b\u001fz" for n in (1, 999, 1000, 1001, 2001)]
    got = spark.createDataFrame([(x,) for x in texts], "x string").select("x", json_string(F.col("x")).alias("j")).collect()
    assert all(r["j"] == dumps(r["x"]) for r in got)


def test_no_records(spark):
    out = engine.process(frame(spark, []))
    assert all(t.count() == 0 for t in out.tables.values())
