"""Rules over documents, and the contract's boundary pairs."""

import pytest
from pyspark.sql import functions as F

from tests.model import event, record
from tests.test_engine import collected, dispositions, frame
from tidemark.operators import rules
from tidemark.operators.timeline import time_category
from tidemark.plans import engine
from tidemark.sources.records import read_documents


def test_singletons_and_times(spark):
    rows = spark.createDataFrame([("a", None), (None, ["a"]), (None, ["a", "b"]), ("b", None), (None, None)], "s string, l array<string>")
    assert [r[0] for r in rows.select(rules.exact_singleton(F.col("s"), F.col("l"), "a")).collect()] == [True, True, False, False, False]
    times = spark.createDataFrame([("2026-01-01T00:00:00Z",), ("2026-01-01T02:00:00+02:00",), ("2026-01-01T00:00:00",), ("x",), (None,)], "t string")
    got = [r[0] for r in times.select(F.unix_seconds(rules.offset_time(F.col("t")))).collect()]
    assert got == [1767225600, 1767225600, None, None, None]
    now = F.lit("2026-01-02 00:00:00").cast("timestamp")
    assert [r[0] for r in times.select(rules.fresh(F.col("t"), now)).collect()] == [True, True, False, False, False]
    assert [r[0] for r in times.select(rules.fresh(F.col("t"), now, 23)).collect()] == [False] * 5


def test_quotas(spark):
    row = "struct<QuotaCode:string,QuotaName:string,Unit:string,Value:double,Adjustable:boolean,GlobalQuota:boolean>"
    documents = spark.createDataFrame([("s", [("L2", "Shards per region", None, 5.0, None, True), ("L1", "Other", None, 0.0, True, None), ("L0", "None", None, None, None, None)]), ("t", [("L3", "Concurrent", None, 0.0, None, None)])], f"service string, Quotas array<{row}>")
    quotas = rules.quota_rows(documents)
    assert [(r["code"], r["adjustable"], r["global"]) for r in quotas.collect()] == [("L1", True, False), ("L2", False, True), ("L3", False, False)]
    wanted = spark.createDataFrame([("s", "shard"), ("s", "stream"), ("t", "concurrent"), ("u", "x")], "service string, part string")
    assert collected(rules.quota_gaps(quotas, wanted), "service") == [("t",), ("u",)]


def test_costs_manifests_and_boundaries(spark):
    parts = spark.createDataFrame([(1.5,), (5.0,)], "usd double")
    assert rules.cost_findings(parts, "usd", 6.5, 8, 12) == []
    assert len(rules.cost_findings(parts, "usd", 9, 8, 12)) == 2
    paths = spark.createDataFrame([("src/a.py",), ("src/a.pyc",), ("README.md",), ("x",)], "p string")
    assert [r[0] for r in paths.select(rules.included(F.col("p"), ["src/"], ["README.md"], [".pyc"])).collect()] == [True, False, True, False]
    contract = spark.createDataFrame([("b1", "x"), ("b2", "y")], "id string, effect string")
    assert rules.boundary(contract, ["b2", "b1"], "b2").first()["effect"] == "y"
    with pytest.raises(ValueError):
        rules.boundary(contract, ["b1"], "b1")


def test_time_boundaries(spark):
    cases = [(10, None, "on_time"), (12_000_000, 10_000_000, "on_time"), (10_000_000, 10_000_000, "on_time"), (9_999_999, 10_000_000, "accepted_late"), (8_200_000, 10_000_000, "accepted_late"), (8_199_999, 10_000_000, "beyond_watermark")]
    rows = spark.createDataFrame(cases, "t bigint, previous bigint, want string")
    assert all(r[0] == r[1] for r in rows.select(time_category(F.col("t"), F.col("previous")), "want").collect())


def test_horizon_boundaries(spark):
    first = event("e", 1_000_000_000)
    for more, want in ((604_800_000, "IDENTICAL_DUPLICATE"), (604_800_001, "EXPIRED_IDENTITY")):
        again = first | {"ingest_time_ms": first["event_time_ms"] + 604_800_000}
        early = first | {"ingest_time_ms": again["ingest_time_ms"] - more}
        assert dispositions(spark, [record(early, 1), record(again, 2, position=1)]) == ["on_time", want]


def test_closing_and_gap_boundaries(spark):
    def sessions(gap, ahead):
        rows = [event("a", 10_000_000), event("b", 10_000_000 + gap), event("c", 10_000_000 + gap + ahead, "v")]
        out = engine.process(frame(spark, [record(e, i, position=i) for i, e in enumerate(rows)]))
        return [r[0] for r in collected(out.tables["session_output"], "member_count")]

    assert sessions(1_800_000, 3_600_000) == []
    assert sessions(1_800_000, 3_600_001) == [2]
    assert sessions(1_800_001, 3_600_001) == [1, 1]


def test_documents_are_decided_by_a_table_of_rules(spark, tmp_path):
    """Freshness, singleton, quota and cost on files: what can't be judged leaves it open, what doesn't hold refuses it."""
    import json

    good = {"captured_at": "2026-01-02T00:00:00Z", "regions": ["r-1"], "quota": {"Value": 5}, "cost": {"total": 6.5}, "mode": "lab"}
    cases = {
        "good": good, "old": good | {"captured_at": "2025-12-31T23:59:59Z"}, "later": good | {"captured_at": "2026-01-02T12:00:01Z"}, "timeless": good | {"captured_at": "2026-01-02"}, "regions": good | {"regions": ["r-1", "r-2"]}, "scalar": good | {"regions": "r-1"},
        "quota": good | {"quota": {"Value": 0}}, "text": good | {"quota": {"Value": "many"}}, "both": good | {"mode": "live", "quota": {}, "cost": {"total": 9}},
    }
    for name, case in cases.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(case))
    (tmp_path / "bad.json").write_text('{"a": 1, "a": 2}')
    table = [
        rules.Rule("$.captured_at", "fresh", 24, "stale"), rules.Rule("$.regions", "only", "r-1", "region"), rules.Rule("$.quota.Value", "at_least", 1, "quota"),
        rules.Rule("$.cost.total", "below", 8, "cost"), rules.Rule("$.mode", "equals", "lab", "mode"), rules.Rule("$.mode", "one_of", ["lab", "live"], "mode"), rules.Rule("$.cost", "present", None, "cost"),
    ]
    got = {r["path"].split("/")[-1][:-5]: (r["decision"], r["findings"]) for r in rules.decided(read_documents(spark, str(tmp_path)), table, F.lit("2026-01-02T12:00:00Z").cast("timestamp")).collect()}
    assert got == {
        "good": ("ADMITTED", []), "scalar": ("ADMITTED", []), "old": ("NO_GO", ["stale"]), "later": ("NO_GO", ["stale"]), "timeless": ("INDETERMINATE", ["stale: nothing to judge"]), "regions": ("NO_GO", ["region"]), "quota": ("NO_GO", ["quota"]),
        "text": ("INDETERMINATE", ["quota: nothing to judge"]), "both": ("INDETERMINATE", ["cost", "mode", "quota: nothing to judge"]), "bad": ("INDETERMINATE", ["unreadable: DUPLICATE_JSON_KEY"]),
    }
    with pytest.raises(ValueError):
        rules.Rule("$.a", "else", 1, "x").holds(F.col("document"), F.current_timestamp())
