"""Reconciliation, coverage, skew, checkpoints, percentiles, chains, and the ordering helpers against brute force."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from tests.test_engine import collected
from tidemark.operators import quality
from tidemark.operators.ordering import islands, previous_max, running_total


def test_reconcile_and_orphans(spark):
    a = spark.createDataFrame([("a", 1), ("b", 2), ("c", None)], "k string, n int")
    b = spark.createDataFrame([("a", 1), ("b", 3), ("c", None), ("d", 4)], "k string, n int")
    assert collected(quality.reconcile(a, b, "k", ["n"]), "k", "status") == [("a", "MATCH"), ("b", "MISMATCH"), ("c", "MATCH"), ("d", "EXTRA")]
    assert collected(quality.reconcile(b, a, "k", ["n"]).where("status = 'MISSING'"), "k") == [("d",)]
    assert collected(quality.orphans(a, b, "k"), "k", "side") == [("d", "right")]


def test_digests_lead_to_the_rows_that_differ(spark):
    """Rows that are lost, added or changed, nulls and maps included; equal tables in another order have equal digests."""
    ddl = "k string, n int, m map<string,string>"
    rows = [(f"k{i}", None if i % 7 == 0 else i, {"a": str(i)} if i % 3 else None) for i in range(200)]
    other = [(k, 5 if k == "k9" else n, {"a": "z"} if k == "k10" else m) for k, n, m in rows if k != "k3"] + [("new", None, None)]
    a, b, again = spark.createDataFrame(rows, ddl), spark.createDataFrame(other, ddl), spark.createDataFrame(rows[::-1], ddl).repartition(3)
    assert collected(quality.table_digests(a, ["k"], 16), "range", "n", "digest") == collected(quality.table_digests(again, ["k"], 16), "range", "n", "digest")
    found = lambda x, y: sorted((r["k"], r["status"]) for r in quality.differing(x, y, ["k"], 16).collect())
    assert found(a, again) == [] and found(a.limit(0), b.limit(0)) == []
    assert found(a, b) == [("k10", "MISMATCH"), ("k3", "MISSING"), ("k9", "MISMATCH"), ("new", "EXTRA")]


@pytest.mark.parametrize(("keys", "want"), [("aab", (2, 3, "2/3")), ("aabb", (2, 4, "1/2")), ("aaa", (3, 3, "1")), ("abcdef", (1, 6, "1/6"))])
def test_skew(spark, keys, want):
    rows = spark.createDataFrame([(k,) for k in keys], "k string")
    assert tuple(quality.key_skew(rows, "k").first()) == want


def test_skew_of_nothing_fails(spark):
    with pytest.raises(Exception, match="skew of no keys"):
        quality.key_skew(spark.createDataFrame([], "k string"), "k").collect()


@pytest.mark.parametrize(("failed", "want"), [((), 103), ((100,), None), ((102,), 101), ((103, 101), 100)])
def test_checkpoint(spark, failed, want):
    rows = spark.createDataFrame([("s", n, n in failed) for n in range(100, 104)], "shard string, n bigint, failed boolean")
    assert [r["checkpoint"] for r in quality.checkpoint(rows, ["shard"], "n", "failed").collect()] == [want]


def test_replay_keys(spark):
    ids = spark.createDataFrame([("e1",), ("e2",), ("e1",)], "event_id string")
    assert collected(quality.replay_keys("live-v1", ids, True), "replay_key") == [("live-v1:e1",), ("live-v1:e2",)]
    with pytest.raises(ValueError):
        quality.replay_keys("live-v1", ids, False)


def test_nearest_rank(spark):
    rng = random.Random(3)
    values = [("k", rng.randrange(50)) for _ in range(137)] + [("one", 9)]
    got = {r["key"]: tuple(r)[1:] for r in quality.nearest_rank(spark.createDataFrame(values, "key string, v bigint"), ["key"], "v", {"p50": 0.5, "p95": 0.95, "p99": 0.99}).collect()}
    for key in ("k", "one"):
        own = sorted(v for k, v in values if k == key)
        assert got[key] == (*(own[math.ceil(p * len(own)) - 1] for p in (0.5, 0.95, 0.99)), own[-1])


def test_chain_faults(spark):
    rows, last = [], "GENESIS"
    for i in range(1, 6):
        own = hashlib.sha256(f"row{i}".encode()).hexdigest()
        rows.append(("r", i, last, own, f"row{i}"))
        last = own
    check = lambda r: [x["ordinal"] for x in quality.chain_faults(spark.createDataFrame(r, "run string, ordinal int, previous string, own string, content string"), ["run"], "ordinal", "previous", "own", F.col("content")).orderBy("ordinal").collect()]
    assert check(rows) == []
    rows[2] = (*rows[2][:4], "changed")
    assert check(rows) == [3]
    assert check(rows[:1] + rows[3:]) == [4, 5]


def test_decision_and_findings(spark):
    rows = spark.createDataFrame([(["e"], []), ([], ["b", "a", "b"]), ([], [])], "errors array<string>, gaps array<string>")
    got = rows.select(quality.decision(F.col("errors"), F.col("gaps")), quality.findings(F.col("errors"), F.col("gaps"))).collect()
    assert [tuple(r) for r in got] == [("INDETERMINATE", ["e"]), ("NO_GO", ["a", "b"]), ("ADMITTED", [])]


@pytest.fixture()
def many_ranges(spark):
    """More ranges than keys, so that one key's rows lie in several."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("seed", range(3))
def test_running_values_equal_brute_force(spark, many_ranges, seed):
    """Values with ties, and one key that has nearly all rows and so lies in nearly all ranges."""
    rng = random.Random(seed)
    rows = [("b" if rng.random() < 0.05 else "a", i, rng.randrange(9)) for i in range(120)]
    frame = spark.createDataFrame(rng.sample(rows, len(rows)), "k string, i int, v int")
    largest = {r["i"]: r["prev"] for r in previous_max(frame, ["k"], ["i"], "v", "prev").collect()}
    total = {r["i"]: r["upto"] for r in running_total(frame, ["k"], ["i"], "v", "upto").collect()}
    for k, i, v in rows:
        before = [w for q, j, w in rows if q == k and j < i]
        assert largest[i] == (max(before) if before else None)
        assert total[i] == sum(before) + v


@pytest.mark.parametrize("seed", range(3))
def test_islands_equal_brute_force(spark, many_ranges, seed):
    """Times with ties; key a has nearly all rows within what was one day, b few over long gaps."""
    rng = random.Random(seed)
    times = [("a", rng.randrange(900), i) for i in range(90)] + [("b", rng.randrange(4000), i) for i in range(90, 110)]
    got = {r["i"]: r["island"] for r in islands(spark.createDataFrame(times, "k string, t bigint, i int"), ["k"], "t", "i", 10).collect()}
    for k in "ab":
        own, island, last = sorted((t, i) for q, t, i in times if q == k), 0, None
        for t, i in own:
            island += last is not None and t - last > 10
            last = t
            assert got[i] == island
