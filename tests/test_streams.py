"""Streams: late, repeated and tied rows, order events, and heartbeats by the clock."""

import datetime as dt
import os
import time

import pytest

from ledgerline.streaming import events as streams
from ledgerline.streaming import folds

AT, HOUR = dt.datetime(2020, 1, 1), dt.timedelta(hours=1)


def files(spark, folder, schema, parts):
    """A stream of one file after the other."""
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        for name in os.listdir(folder):
            if name.endswith(".parquet") and os.path.getmtime(f"{folder}/{name}") > 1_000_000:
                os.utime(f"{folder}/{name}", (1000 + i, 1000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_order_events_are_each_counted(spark, tmp_path):
    schema = "key string, ts timestamp, event_id string, event string, quantity long"
    first = [("a", AT, "1", "OUTBOX", 5), ("a", AT + 0.1 * HOUR, "2", "FILL", 1), ("a", AT + 0.2 * HOUR, "3", "ACK", None), ("a", AT + 0.3 * HOUR, "4", "FILL", 3), ("b", AT, None, "ACK", None)]
    second = [("a", AT + 0.4 * HOUR, "4", "FILL", 3), ("a", AT + 0.5 * HOUR, "5", "FILL", 3), ("a", AT + 0.6 * HOUR, "6", "FILL", 2), ("a", AT + 0.7 * HOUR, "7", "CANCEL", None), ("z", AT + 9 * HOUR, "8", "OUTBOX", 1)]
    third = [("a", AT + 0.65 * HOUR, "9", "ACK", None), ("z", AT + 20 * HOUR, "10", "WHAT", None)]
    rows = folds.order_states(files(spark, str(tmp_path / "in"), schema, [first, second, third]))
    got = streams.finish(rows, "orders", None).collect()
    seen = sorted((r.key, r.ts, r.event_id, r.verdict, r.status, r.filled) for r in got if r.outcome == "seen")
    assert [(x[2], *x[3:]) for x in seen if x[0] == "a"] == [
        ("1", "applied", "PERSISTED", 0),
        ("2", "illegal", "PERSISTED", 0),
        ("3", "applied", "ACKNOWLEDGED", 0),
        ("4", "applied", "PARTIAL", 3),
        ("4", "duplicate", "PARTIAL", 3),
        ("5", "overfilled", "PARTIAL", 3),
        ("6", "applied", "FILLED", 5),
        ("7", "illegal", "FILLED", 5),
    ]
    assert [x[3:] for x in seen if x[0] == "b"] == [("illegal", None, 0)] and [x[3:] for x in seen if x[0] == "z"] == [("applied", "PERSISTED", 0)]
    # The file that came too late is told apart; only what the watermark has not passed is still held.
    assert [(r.event_id, r.verdict) for r in got if r.outcome == "late"] == [("9", None)]
    assert len(got) == len(first) + len(second) + len(third) - 1


def test_rows_of_one_place_are_all_taken(spark, tmp_path):
    schema = "key long, ts timestamp, event_id long, ret double"
    rows = [(1, AT, 1, 0.5), (1, AT, 1, -0.5), (1, AT, 1, -0.5), (2, AT + 5 * HOUR, 2, 0.0)]
    found = []
    for name, parts in (("one", [rows]), ("two", [rows[1:2], rows[:1] + rows[2:]])):
        out = folds.running_drawdown(files(spark, str(tmp_path / name), schema, parts), ["ts", "event_id"])
        found.append(sorted((r.key, r.ret, r.nav) for r in streams.finish(out, "ties").collect()))
    assert found[0] == found[1] == [(1, -0.5, 0.25), (1, -0.5, 0.5), (1, 0.5, 0.375)]


def test_repeats_have_an_outcome_of_their_own(spark, tmp_path):
    schema = "key long, event_id long, event string, ts timestamp"
    rows = [(1, 1, "OUTBOX", AT), (1, 1, "OUTBOX", AT), (2, 2, "OUTBOX", AT + 9 * HOUR)]
    out = streams.illegal_transitions(files(spark, str(tmp_path / "in"), schema, [rows]))
    assert [(r.event_id, r.outcome) for r in streams.finish(out, "repeats", None).collect()] == [(1, "repeat")]


def test_silent_component_is_told_while_the_stream_runs(spark, tmp_path):
    folder, schema = str(tmp_path / "beats"), "component string, ts timestamp"
    now = dt.datetime.now(dt.UTC).replace(tzinfo=None)
    beat = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    beat([("broker", now), ("feed", now), ("journal", now + HOUR), (None, now)])
    rows = folds.freshness(spark.readStream.schema(schema).parquet(folder), "component", 8)
    query = streams.start(rows, str(tmp_path / "out"), processingTime="1 second")
    told, until = [], time.time() + 60
    try:
        while time.time() < until and not {"broker", "feed"} <= {r.component for r in told if r.reason == "heartbeat is stale"}:
            time.sleep(1)
            if query.exception():
                raise query.exception()
            if query.lastProgress and os.path.isdir(str(tmp_path / "out/rows/_spark_metadata")):
                told = spark.read.parquet(str(tmp_path / "out/rows")).collect()
    finally:
        query.stop()
    stale = {r.component: r for r in told if r.reason == "heartbeat is stale"}
    assert {"broker", "feed"} <= set(stale) and all(r.status == "BLOCKED" and r.age_seconds > 8 for r in stale.values())
    assert {(r.component, r.status, r.reason) for r in told if r.component == "journal"} == {("journal", "BLOCKED", "heartbeat is in the future")}


@pytest.mark.parametrize("name", ["stream_freshness"])
def test_registered_once(name):
    import __spark_entry__

    assert name in __spark_entry__.queries() and name in __spark_entry__.oracle_sql()


def against_sql(spark, folder, name, rows):
    """What a registered query and its SQL return on a table of events of (event_id, user_id, event_type, value, ts in microseconds)."""
    import duckdb
    from pyspark.sql import functions as F

    import __spark_entry__

    given = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, us long")
    given.select("event_id", F.timestamp_micros("us").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value").coalesce(1).write.parquet(f"{folder}/events.parquet")
    sql = __spark_entry__.oracle_sql()[name]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    got = __spark_entry__.queries()[name](spark, str(folder)).collect()
    return sorted(map(tuple, got), key=repr), sorted(con.execute(sql if isinstance(sql, str) else sql[0]).fetchall(), key=repr)


WEEK = 604_800_000_000


def test_heartbeats_are_told_to_the_nearest_millisecond(spark, tmp_path):
    at = 2800 * WEEK
    got, expected = against_sql(spark, tmp_path, "stream_freshness", [(1, 1, "a", 0.0, at + 1499), (2, 1, "b", 0.0, at + 1500), (3, 1, "b", 0.0, at + 1400), (4, 1, "c", 0.0, at + 1777)])
    assert got == expected and [r[2] for r in got] == [at // 1000 + 1, at // 1000 + 2, at // 1000 + 2]


def test_orders_are_cut_and_told_by_the_nearest_millisecond(spark, tmp_path):
    at, hour = 2800 * WEEK, 3_600_000_000
    # Just before a week that the nearest millisecond has begun; then two rows on either side of the watermark.
    rows = [(1, 1, "signup", 4.0, at - 400), (2, 1, "view", 1.0, at + 1500), (3, 1, "purchase", 1.0, at + 2499)]
    rows += [(4, 2, "signup", 1.0, at + hour + 1400), (5, 3, "signup", 1.0, at + hour + 1600), (6, 4, "signup", 1.0, at + 2 * hour + 1700)]
    got, expected = against_sql(spark, tmp_path, "stream_order_states", rows)
    assert got == expected and [(r[0], r[1]) for r in got] == [("1:2800", at // 1000), ("1:2800", at // 1000 + 2), ("1:2800", at // 1000 + 2), ("2:2800", (at + hour) // 1000 + 1)]


def test_keys_share_a_group_and_keep_their_own_state(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(folds, "GROUPS", 1)
    schema, big = "key long, ts timestamp, sequence long, previous_hash string, record_hash string", 2**53 + 1
    first = [(k, AT, big, "", f"{k}") for k in (1, 2, big, None)] + [(9, AT + 5 * HOUR, 0, "", "")]
    second = [(1, AT + 5 * HOUR, big + 1, "1", "x"), (big, AT + 5 * HOUR, big + 2, "?", "x"), (None, AT + 5 * HOUR, big + 1, "None", "x"), (2, AT, big + 1, "2", "x"), (9, AT + 11 * HOUR, 1, "", "")]
    out = folds.chain_breaks(files(spark, str(tmp_path / "in"), schema, [first, second]), ["sequence"])
    got = {(r.key, r.sequence, r.outcome): (r.sequence_break, r.hash_break, r.ts) for r in streams.finish(out, "groups", None).collect()}
    assert {k: v[:2] for k, v in got.items()} == {
        **{(k, big, "seen"): (False, False) for k in (1, 2, big, None)}, (9, 0, "seen"): (False, False),
        (1, big + 1, "seen"): (False, False), (big, big + 2, "seen"): (True, True), (None, big + 1, "seen"): (False, False), (2, big + 1, "late"): (None, None),
    }
    assert got[(None, big, "seen")][2] == AT
