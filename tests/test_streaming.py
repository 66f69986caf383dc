"""Streams give what the batch rules give."""

import time
from datetime import datetime, timedelta

from tidemark.operators import folds
from tidemark.sources import sinks
from tidemark.streaming import processors


def until(query, told, seconds=60):
    end = time.time() + seconds
    while time.time() < end and query.exception() is None and not told():
        time.sleep(0.5)
    query.stop()
    assert query.exception() is None and told()


def run(spark, tmp_path, batches, schema, build, name, n):
    """The rows that a stream gives, once there are as many as expected; timers would keep the query running."""
    processors.configure(spark)
    source = str(tmp_path / f"{name}-in")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    stream = build(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source))
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-cp")).start()
    until(query, lambda: spark.table(name).count() >= n)
    return spark.table(name).collect()


def test_rate_limit(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    times = [0, 10, 20, 30, 61, 62, 200, 201, 202, 203]
    rows = [("k", i, ms) for i, ms in enumerate(times)]
    got = run(spark, tmp_path, [rows[:4], rows[4:]], "key string, event_id long, ms long", lambda s: processors.rate_limit_stream(s, most=3, length_ms=60), "limits", 10)
    batch = spark.createDataFrame([(i, "k", t0 + timedelta(milliseconds=ms)) for i, ms in enumerate(times)], "event_id long, key string, ts timestamp")
    want = folds.rate_limit(batch, ["key"], order=["event_id"], most=3, length_ms=60).collect()
    assert sorted((r.event_id, r.n, r.over) for r in got) == sorted((r.event_id, r.n, r.over) for r in want)


def test_rate_limit_from_the_moment_of_connection(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    rows = [("k", None, -30), ("k", 0, 0), ("k", 1, 29), ("k", 2, 31), ("k", 3, 91), ("k", 4, 92)]
    got = run(spark, tmp_path, [rows[:3], rows[3:]], "key string, event_id long, ms long", lambda s: processors.rate_limit_stream(s, most=3, length_ms=60), "connected", 5)
    make = lambda picked: spark.createDataFrame([(i, "k", t0 + timedelta(milliseconds=ms)) for _, i, ms in picked], "event_id long, key string, ts timestamp")
    want = folds.rate_limit(make(rows[1:]), ["key"], order=["event_id"], most=3, length_ms=60, connects=make(rows[:1])).collect()
    assert sorted((r.event_id, r.n, r.over) for r in got) == sorted((r.event_id, r.n, r.over) for r in want) == [(0, 1, False), (1, 2, False), (2, 1, False), (3, 2, False), (4, 1, False)]


def test_sessions(spark, tmp_path):
    rows = [("1", 0, 0, "create", "", ""), ("1", 1, 1, "join", "publisher", "publisher"), ("1", 2, 2, "join", "recipient", "a"), ("2", 3, 3, "join", "recipient", "a")]
    got = run(spark, tmp_path, [rows], "code string, event_id long, ms long, kind string, role string, peer string", processors.session_stream, "sessions", 4)
    assert sorted((r.event_id, r.outcome) for r in got) == [(0, "created"), (1, "publisher joined"), (2, "recipient ready"), (3, "session not found")]


def test_candidates(spark, tmp_path):
    rows = [("a", 1, "candidate", "x"), ("a", 2, "candidate", "y")]
    more = [("a", 3, "ready", None), ("a", 4, "candidate", "z"), ("b", 5, "candidate", "w")]
    got = run(spark, tmp_path, [rows, more], "conn_id string, seq long, kind string, value string", processors.candidate_stream, "candidates", 3)
    assert sorted((r.seq, r.value) for r in got) == [(1, "x"), (2, "y"), (4, "z")]


def test_inactivity_is_a_session_window(spark):
    t0 = datetime(2024, 1, 1)
    rows = spark.createDataFrame([("t", t0), ("t", t0 + timedelta(seconds=30)), ("t", t0 + timedelta(seconds=61))], "transfer_id string, ts timestamp")
    assert sorted(r.n for r in folds.inactivity(rows, "transfer_id").collect()) == [1, 2]


def test_lockout(spark, tmp_path):
    times = [*range(5), 10, 59, 60, 61, 62]
    rows = [("k", i, ms) for i, ms in enumerate(times)]
    got = run(spark, tmp_path, [rows[:4], rows[4:]], "key string, event_id long, ms long", lambda s: processors.lockout_stream(s, limit=3, length_ms=60), "lockouts", 10)
    t0 = datetime(2024, 1, 1)
    batch = spark.createDataFrame([(i, "k", t0 + timedelta(milliseconds=ms)) for i, ms in enumerate(times)], "event_id long, key string, ts timestamp")
    want = folds.lockout(batch, ["key"], order=["event_id"], limit=3, length_ms=60).collect()
    assert sorted((r.event_id, r.blocked, r.failures) for r in got) == sorted((r.event_id, r.blocked, r.failures) for r in want)


def test_timers_end_sessions_and_clear_states(spark, tmp_path):
    """A session without a publisher ends by its idle timer, one with a publisher by its TTL; an idle key starts anew."""
    processors.configure(spark)
    schema = "code string, event_id long, ms long, kind string, role string, peer string"
    source = str(tmp_path / "in")
    rows = [("1", 0, 0, "create", "", ""), ("2", 1, 0, "create", "", ""), ("2", 2, 1, "join", "publisher", "publisher")]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(source)
    stream = processors.session_stream(spark.readStream.schema(schema).parquet(source), ttl_ms=4000, idle_ms=1000)
    query = stream.writeStream.format("memory").queryName("timers").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="500 milliseconds").start()
    until(query, lambda: spark.table("timers").where("outcome = 'expired'").count() == 2)
    assert [r.code for r in spark.table("timers").collect() if r.outcome == "expired"] == ["1", "2"]

    source, schema = str(tmp_path / "limits"), "key string, event_id long, ms long"
    spark.createDataFrame([("k", 0, 0)], schema).coalesce(1).write.parquet(source)
    stream = processors.rate_limit_stream(spark.readStream.schema(schema).parquet(source), most=9, length_ms=10**9, grace_ms=1000 - 10**9)
    query = stream.writeStream.format("memory").queryName("cleared").outputMode("append").option("checkpointLocation", str(tmp_path / "cp2")).trigger(processingTime="500 milliseconds").start()
    end = time.time() + 60
    while spark.table("cleared").count() < 1 and time.time() < end:
        time.sleep(0.5)
    time.sleep(4)
    spark.createDataFrame([("k", 1, 1)], schema).coalesce(1).write.mode("append").parquet(source)
    until(query, lambda: spark.table("cleared").count() == 2)
    assert sorted((r.event_id, r.n) for r in spark.table("cleared").collect()) == [(0, 1), (1, 1)]


def test_periodic_jobs_never_overlap(spark, tmp_path):
    ran = []

    def job(number):
        assert not guard(number)  # a call while it runs is skipped
        ran.append(number)

    guard = sinks.SingleFlight(job)
    query = sinks.periodic(spark, guard, "200 milliseconds", str(tmp_path / "ticks"))
    until(query, lambda: len(ran) >= 2)
    assert guard.skipped >= 2
