"""The driver's contract."""

import __spark_entry__ as entry


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 45


def test_event_queries_all_have_sql():
    from tidemark.plans import queries

    assert set(queries.queries()) == set(queries.oracle_sql())


def test_flagship_query_on_a_small_table(spark, tmp_path, monkeypatch):
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    rows = [(i, start + timedelta(minutes=i * 7), i % 5, ["view", "click", "purchase", "signup"][i % 4], 1.25 * i, "{}") for i in range(200)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    got = entry.queries()["session_output"](spark, str(tmp_path))
    assert got.count() > 0
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(f"SELECT session_id, member_count, value_cents FROM ({entry.oracle_sql()['session_output']})").fetchall()
    assert sorted(want) == sorted(tuple(r) for r in got.select("session_id", "member_count", "value_cents").collect())
