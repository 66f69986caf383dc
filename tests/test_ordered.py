"""Anchored windows, sessions and receivers against plain versions, with keys that Python would round."""

import json
import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from tidemark.operators import anchors, folds, receiving, sessions, transfer

T0 = datetime(2024, 1, 1)
#: A null in the same column makes pandas hold longs as floats, which these are not.
KEYS = [2**53 + 1, None, 7, 2**53, -(2**62) - 1]


def at(ms):
    return T0 + timedelta(milliseconds=ms)


@pytest.mark.parametrize(("length", "span"), [(10, None), (10, 10), (7, 21), (60, 100)])
def test_windows_number_events_as_one_by_one(spark, length, span):
    rnd, rows, connects = random.Random(length), [], {}
    for k in KEYS:
        t = 0
        for _ in range(200):
            t += rnd.choice([0, 0, 1, 2, 3, 9, 40])
            rows.append((len(rows), k, "x" if k == 7 else None, at(t)))
        if k != 7:
            connects[k] = rnd.choice([-500, -5, 3, 100, 10_000])
    events = spark.createDataFrame([*rows, (-1, 1, "x", None)], "event_id long, a long, b string, ts timestamp").repartition(5)
    connected = spark.createDataFrame([(k, None, at(ms + d)) for k, ms in connects.items() for d in (0, 5)] + [(9, "z", at(0)), (7, "x", None)], "a long, b string, ts timestamp")
    for known in (None, connected):
        want = {}
        for k in KEYS:
            window = folds.AnchoredWindow(3, length)
            if known is not None and k in connects:
                window.opened = connects[k]
            for event, _, _, ts in sorted((r for r in rows if r[1] == k), key=lambda r: (r[3], r[0])):
                want[event] = (*window.step(round((ts - T0) / timedelta(milliseconds=1))), k)
        got = anchors.anchored(events, ["a", "b"], at="ts", order=["event_id"], length_ms=length, connects=known, span_ms=span).collect()
        assert {r.event_id: (r._n, r._n > 3, r.a) for r in got} == want and len(got) == len(rows)
        if span is None:
            limited = folds.rate_limit(events, ["a", "b"], order=["event_id"], most=3, length_ms=length, connects=known).collect()
            assert {r.event_id: (r.n, r.over, r.a) for r in limited} == want


def test_a_hot_key_is_in_many_tasks(spark):
    """A key of 200,000 times: its spans are numbered by themselves, and agree with one pass over all of it."""
    rnd = np.random.default_rng(1)
    times = np.cumsum(rnd.integers(1, 5, 200_000))
    events = spark.createDataFrame([(i, int(t)) for i, t in enumerate(times)], "event_id long, ms long").selectExpr("event_id", "7 AS k", "timestamp_millis(ms) AS ts")
    got = anchors.placed(events, ["k"], at="ts", order=["event_id"], length_ms=1000, span_ms=5000)
    opened, n, want = None, 0, []
    for t in times.tolist():
        opened, n = (t, 1) if opened is None or t - opened > 1000 else (opened, n + 1)
        want.append((opened, n))
    assert [(r._opened, r._n) for r in got.orderBy("event_id").collect()] == want
    assert got.selectExpr("floor(unix_millis(ts) / 5000) AS s").distinct().count() > 90


def test_lockouts_and_limits_of_all_keys_are_kept(spark):
    rows = [(i, k, "retrieve", 401, at(i)) for i, k in enumerate(KEYS * 30)]
    events = spark.createDataFrame(rows, "event_id long, ip long, route string, status int, ts timestamp")
    locked = folds.lockout(events, ["ip"], order=["event_id"]).collect()
    assert sorted(((r.ip, r.failures) for r in locked), key=str) == sorted(((k, min(n, 10)) for k in KEYS for n in range(1, 31)), key=str)
    limited = folds.http_limits(events, order=["event_id"]).collect()
    assert sorted(((r.ip, r.n, r.over) for r in limited), key=str) == sorted(((k, n, n > 15) for k in KEYS for n in range(1, 31)), key=str)


def test_members_of_all_keys_are_kept(spark):
    rows = [(i, k, "join", "recipient", f"r{i % 3}", at(i)) for i, k in enumerate(k for k in KEYS for _ in range(4))]
    events = spark.createDataFrame(rows, "event_id long, code long, kind string, role string, peer string, ts timestamp")
    got = sessions.membership(events, order=["event_id"], most=3).collect()
    # A peer that joins twice is one recipient.
    assert sorted(((r.code, r.event_id % 4) for r in got if r.outcome == "session full"), key=str) == sorted(((k, 3) for k in KEYS), key=str)
    assert {r.n_recipients for r in got} == {1, 2, 3} and len(got) == len(rows)
    with pytest.raises(ValueError):
        sessions.membership(events.withColumnRenamed("event_id", "outcome"), order=["outcome"])


def test_messages_of_a_session(spark):
    live = spark.createDataFrame([("a", 0, 100_000), ("b", 0, 100_000), ("c", 0, 400)], "code string, created_at_ms long, expires_at_ms long")
    said = [
        ("a", 1, "join", "recipient", "r1"), ("a", 2, "join", "recipient", "r2"), ("a", 3, "join", "publisher", "p"), ("a", 4, "join", "publisher", "q"), ("a", 5, "leave", "recipient", "r1"), ("a", 6, "leave", "publisher", "p"), ("a", 7, "join", "recipient", "r3"),
        ("b", 1, "join", "recipient", "r1"), ("b", 2, "leave", "recipient", "r1"), ("b", 3, "join", "publisher", "p"),
        ("c", 1, "join", "recipient", "r1"), ("c", 2, "join", "publisher", "p"), ("c", 500, "join", "recipient", "r2"),
        ("none", 1, "join", "publisher", "p"),
    ]
    events = spark.createDataFrame([(c, n, *x, datetime.fromtimestamp(n / 1000)) for c, n, *x in said], "code string, event_id long, kind string, role string, peer string, ts timestamp")
    rows = sessions.session_messages(events, live, order=["event_id"]).collect()
    told = [(r.code, r.event_id, r.at_ms, r.n, r.to, r.type, r.peer_id) for r in rows]
    assert sorted(told, key=str) == sorted([
        ("a", 3, 3, 0, "p", "ready", "r1"), ("a", 3, 3, 1, "r1", "ready", "r1"), ("a", 3, 3, 2, "p", "ready", "r2"), ("a", 3, 3, 3, "r2", "ready", "r2"), ("a", 5, 5, 0, "p", "peer_left", "r1"), ("a", 6, 6, 0, "r2", "peer_left", None),
        ("c", 2, 2, 0, "p", "ready", "r1"), ("c", 2, 2, 1, "r1", "ready", "r1"), ("c", None, 400, 0, "p", "expired", None), ("c", None, 400, 1, "r1", "expired", None),
    ], key=str)
    assert sessions.session_messages(events.limit(0), live, order=["event_id"]).collect() == []


def test_a_locked_out_caller_does_not_join(spark):
    """The right password of a locked-out address joins nobody, so what hangs on that join is told otherwise in a second round."""
    live = spark.createDataFrame([("000001", 0, 10**9)], "code string, created_at_ms long, expires_at_ms long")
    rows = [(i, "000001", "recipient", "ip", f"r{i}", "join", False) for i in range(3)]
    rows += [(3, "000001", "recipient", "ip", "r3", "join", True), (4, "000001", "recipient", "ip", "r3", "leave", None), (5, "000001", "recipient", None, "r5", "join", True), (6, "000001", "recipient", "ip", "r6", "join", True), (7, "000001", "publisher", None, "p", "join", None)]
    events = spark.createDataFrame([(*r, datetime.fromtimestamp(r[0])) for r in rows], "event_id long, code string, role string, ip string, peer string, kind string, password_ok boolean, ts timestamp")
    told = {r.event_id: (r.outcome, r.answer) for r in sessions.join_answers(events, live, order=["event_id"], failures=2, length_ms=4000).collect()}
    assert [told[i][0] for i in range(8)] == ["wrong password", "wrong password", "locked out", "locked out", "ignored", "recipient joined", "recipient joined", "publisher joined"]
    assert told[2][1] == sessions.LOCKED and told[5][1] == sessions.WAIT and told[7][1] is None and told[4][1] is None
    assert sessions.join_answers(events.limit(0), live, order=["event_id"]).collect() == []


def meta(*sizes, total=0):
    return json.dumps({"type": "meta", "files": [{"size": n} for n in sizes], "totalChunks": total})


def plain_receive(rows, gap):
    """One message after the other, as a receiver sees them."""
    state, told, number = None, [], -1
    for _, _, kind, text, n, ts in rows:
        ms = round((ts - T0) / timedelta(milliseconds=1))
        if state and ms - state["last"] > gap and state["chunks"] < state["total"]:
            told.append((number, "timed out", state["chunks"], state["total"], state["got"]))
            state = None
        if kind == "binary":
            if state and state["file"] < len(state["sizes"]):
                state["got"][state["file"]] += n or 0
                state["chunks"], state["last"] = state["chunks"] + 1, ms
                state["file"] += state["got"][state["file"]] >= state["sizes"][state["file"]]
            continue
        try:
            m = json.loads(text or "")
        except ValueError:
            continue
        if not isinstance(m, dict):
            continue
        if m.get("type") == "meta":
            files = m.get("files")
            if not isinstance(files, list) or not all(isinstance(f, dict) and isinstance(f.get("size"), (int, float)) for f in files):
                continue
            if state:
                told.append((number, "replaced", state["chunks"], state["total"], state["got"]))
            number += 1
            state = {"sizes": [f["size"] for f in files], "total": m.get("totalChunks") or 0, "got": [0] * len(files), "file": 0, "chunks": 0, "last": ms}
        elif m.get("type") in ("done", "abort") and state:
            told.append((number, "completed" if m["type"] == "done" else "aborted", state["chunks"], state["total"], state["got"]))
            state = None
    if state:
        told.append((number, "stalled" if state["chunks"] >= state["total"] else "open", state["chunks"], state["total"], state["got"]))
    return told


def test_receivers_take_chunks_as_one_by_one(spark):
    rnd, rows = random.Random(4), []
    bad = ["", None, "no json", "[]", "7", '{"type":"meta"}', '{"type":"meta","files":[1]}', '{"type":"meta","files":[{"size":"x"}]}', '{"type":"meta","files":{"size":1}}', '{"type":"meta","files":[null]}', '{"type":5}']
    for k in KEYS:
        t = 0
        for i in range(150):
            t += rnd.choice([1, 1, 5, 31])
            kind = rnd.random()
            if kind < 0.75:
                rows.append((k, i, "binary", None, rnd.choice([0, 1, 10, 64, None]), at(t)))
            else:
                sizes = [rnd.choice([0, 5, 100, 200]) for _ in range(rnd.randint(0, 4))]
                text = rnd.choice([meta(*sizes, total=rnd.randint(0, 6)), meta(*sizes, total=3), '{"type":"done"}', '{"type":"abort"}', *rnd.sample(bad, 2)])
                rows.append((k, i, "json", text, None, at(t)))
    rows += [(12, 0, "json", meta(5, total=1), None, at(0)), (12, 1, "binary", None, 5, at(1)), (13, 0, "json", meta(5, total=1), None, at(0))]
    events = spark.createDataFrame(rows, "transfer_id long, seq long, kind string, json string, byte_len long, ts timestamp").repartition(4)
    for gap in (None, 30):
        got = receiving.receive(events, at="ts" if gap else None, gap_ms=gap or 0).collect()
        want = [(k, *r) for k in [*KEYS, 12, 13] for r in plain_receive([x for x in rows if x[0] == k], gap or 10**9)]
        assert sorted(((r.transfer_id, r.number, r.state, r.chunks_done, r.chunks_total, r.file_bytes) for r in got), key=str) == sorted(want, key=str)
        assert all(r.count_matches == (r.chunks_done == r.chunks_total) for r in got)
    assert {r.state for r in got} == {"timed out", "replaced", "completed", "aborted", "stalled", "open"}
    assert receiving.receive(events.limit(0)).collect() == []


def test_a_run_over_several_batches(spark):
    """Files that are filled in another batch than they begin in."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        files = spark.createDataFrame([(2**53 + 1, 0, 100), (2**53 + 1, 1, 0), (2**53 + 1, 2, 55)], "t long, file_index int, size long")
        chunks = spark.createDataFrame([(2**53 + 1, i, 3) for i in range(90)] + [(None, 0, 3)], "t long, seq long, byte_len int")
        rows = transfer.attribute(chunks, files, "t", mode="receiver").collect()
        assert {r.t for r in rows} == {2**53 + 1}
        assert [r.file_index for r in sorted(rows, key=lambda r: r.seq)] == [0] * 34 + [1] + [2] * 19
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
