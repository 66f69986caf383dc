"""Streams with timers, against the batch rules and over restarts."""

import time
from datetime import datetime

from test_ordered import T0, at, meta, plain_receive
from test_streaming import run, until

from tidemark.operators import folds, sessions
from tidemark.streaming import processors, timers

LIVE = "code string, event_id long, ms long, kind string, role string, peer string"


def test_messages_are_those_of_the_batch(spark, tmp_path):
    said = [(1, "join", "recipient", "r1"), (2, "join", "recipient", "r2"), (3, "join", "publisher", "p"), (4, "leave", "recipient", "r1"), (5, "join", "recipient", "r3"), (6, "leave", "publisher", "p"), (7, "join", "recipient", "r4")]
    rows = [("a", 0, 0, "create", "", "")] + [("a", n, n, *x) for n, *x in said]
    got = run(spark, tmp_path, [rows[:3], rows[3:5], rows[5:]], LIVE, timers.message_stream, "messages", 9)
    live = spark.createDataFrame([("a", 0, 10**9)], "code string, created_at_ms long, expires_at_ms long")
    batch = spark.createDataFrame([("a", n, *x, datetime.fromtimestamp(n / 1000)) for n, *x in said], "code string, event_id long, kind string, role string, peer string, ts timestamp")
    want = sessions.session_messages(batch, live, order=["event_id"]).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str) and len(got) == 9


def test_timers_tell_each_peer(spark, tmp_path):
    rows = [("a", 0, 0, "create", "", ""), ("a", 1, 1, "join", "recipient", "r1"), ("b", 0, 0, "create", "", ""), ("b", 1, 1, "join", "publisher", "p"), ("b", 2, 2, "join", "recipient", "r1")]
    got = run(spark, tmp_path, [rows], LIVE, lambda s: timers.message_stream(s, ttl_ms=3000, idle_ms=500), "expired", 5)
    assert sorted((r.code, r.to, r.n) for r in got if r.type == "expired") == [("a", "r1", 0), ("b", "p", 0), ("b", "r1", 1)]


def test_receivers_give_up_in_event_time(spark, tmp_path):
    """The stream's lists are those of one message after the other; a later transfer's messages move time on."""
    rows = [("t", 0, "json", meta(10, 0, 5, total=4), None, at(0)), ("t", 1, "binary", None, 7, at(10)), ("t", 2, "binary", None, 7, at(20)), ("t", 3, "binary", None, 1, at(25)), ("t", 4, "json", "noise", None, at(26))]
    more = [("t", 5, "binary", None, 1, at(90)), ("t", 6, "json", meta(9, total=2), None, at(95)), ("t", 7, "json", meta(3, total=1), None, at(96)), ("t", 8, "binary", None, 3, at(99)), ("t", 9, "json", '{"type":"done"}', None, at(100)), ("t", 10, "json", meta(3, total=1), None, at(101))]
    last = [("u", 0, "json", '{"type":"done"}', None, at(600_000))]
    schema = "transfer_id string, seq long, kind string, json string, byte_len long, ts timestamp, ms long"
    timed = lambda picked: [(*r, round((r[5] - T0).total_seconds() * 1000)) for r in picked]
    got = run(spark, tmp_path, [timed(rows), timed(more), timed(last), timed([("u", 1, "json", "x", None, at(600_001))])], schema, lambda s: timers.receive_stream(s, gap_ms=30, late="0 seconds"), "given_up", 4)
    want = plain_receive(rows + more + [("t", 11, "json", "noise", None, at(600_000))], 30)
    assert sorted((r.number, r.state, r.chunks_done, r.chunks_total, r.file_bytes) for r in got) == sorted(want)
    assert [w[1] for w in want] == ["timed out", "replaced", "completed", "timed out"]


def test_stored_timers_survive_a_restart(spark, tmp_path):
    """Set, moved and burning timers; a new process finds the snapshot and fires what the old one had set."""
    processors.configure(spark)
    now = round(time.time() * 1000)
    schema = "code string, event_id long, kind string, expires_ms long, burns boolean"
    rows = [("moved", 0, "set", now + 500, False), ("moved", 1, "set", now + 10**7, False), ("soon", 2, "set", now + 1500, False), ("burns", 3, "set", now + 10**7, True), ("burns", 4, "read", None, None), ("gone", 5, "set", now + 1500, False), ("gone", 6, "delete", None, None)]
    got = run(spark, tmp_path, [rows], schema, lambda s: timers.stored_stream(s, burn_ms=1000), "stored", 2)
    assert {(r.code, r.reason) for r in got} == {("soon", "expired"), ("burns", "burned")}
    # The process that had "moved" is gone with its checkpoint; what is stored is all that a new one knows.
    now = round(time.time() * 1000)
    snapshot = spark.createDataFrame([("moved", now + 4000, False), ("past", now - 5000, False), ("late", now + 10**7, True)], "code string, expires_ms long, burns boolean")
    got = run(spark, tmp_path, [[("late", 7, "read", None, None)]], schema, lambda s: timers.stored_stream(s, snapshot, burn_ms=1000), "restarted", 3)
    assert {(r.code, r.reason) for r in got} == {("moved", "expired"), ("past", "expired"), ("late", "burned")}


def test_reconnection_attempts_are_those_of_the_batch(spark, tmp_path):
    schema = "conn_id string, event_id long, kind string"
    rows = [[("c", 0, "open"), ("c", 1, "lost"), ("d", 2, "lost"), ("d", 3, "open")], [("c", 4, "lost")], [("c", 5, "lost")], [("c", 6, "lost")]]
    processors.configure(spark)
    source = str(tmp_path / "connections")
    spark.createDataFrame(rows[0], schema).coalesce(1).write.parquet(source)
    stream = timers.reconnect_stream(spark.readStream.schema(schema).parquet(source), attempts=3, base_ms=300)
    query = stream.writeStream.format("memory").queryName("attempts").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    end = time.time() + 60
    for n, batch in enumerate(rows[1:], 1):
        while spark.table("attempts").where("what = 'attempt'").count() < n and time.time() < end:
            time.sleep(0.2)
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
    until(query, lambda: spark.table("attempts").where("what = 'gave up'").count() == 1)
    log = spark.createDataFrame([(*r, i) for i, r in enumerate(x for b in rows for x in b)], schema + ", ts long")
    want = folds.reconnects(log, "conn_id", attempts=3, base_ms=300, order=("event_id",)).where("conn_id = 'c' AND kind = 'lost'").collect()
    told = spark.table("attempts").where("conn_id = 'c'").collect()
    assert sorted((r.attempt, r.what) for r in told) == [(1, "attempt"), (2, "attempt"), (3, "attempt"), (3, "gave up")]
    assert sorted(r.attempt for r in want if not r.gave_up) == [1, 2, 3] and sum(r.gave_up for r in want) == 1
    assert spark.table("attempts").where("conn_id = 'd'").count() == 0
