"""Integrity, lookups, mutations, transfers and ordered rules on small tables."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions import crypto
from tidemark.operators import folds, integrity, lookup, mutations, transfer
from tidemark.schemas import SCHEMAS
from tidemark.sources import readers, sinks

T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def store(spark):
    file = lambda i, t: {"name": f"{i}.txt", "mimeType": "text/plain", "size": 11, "gridfsId": i, "token": t}
    sessions = [
        ("999999", "test", [file("f1", "123")], T0, T0, None, False),
        ("000001", "", [file("f2", "a" * 32), file("f3", "b" * 32)], T0 + timedelta(hours=1), T0, "s:k", True),
    ]
    files = [(f"f{i}", f"{i}.txt", 11, 4, T0, None) for i in range(1, 5)]
    chunks = [(f"c{i}{n}", f"f{i}", n, d) for i in (1, 2, 9) for n, d in enumerate((b"hell", b"o wo", b"rld"))]
    make = lambda rows, name: spark.createDataFrame(rows, SCHEMAS[name])
    return make(sessions, "stored_session"), make(files, "gridfs_file"), make(chunks, "gridfs_chunk")


def at10():
    return F.lit("2024-01-01 00:00:10").cast("timestamp")


def ids(df, c="_id"):
    return sorted(r[c] for r in df.collect())


def test_orphans_and_referenced_split_all(store):
    sessions, files, chunks = store
    assert ids(integrity.orphan_files(files, sessions)) == ["f4"]
    assert ids(integrity.referenced_files(files, sessions)) == ["f1", "f2", "f3"]
    assert ids(integrity.orphan_chunk_ids(chunks, files), "files_id") == ["f9"]
    assert integrity.expiry_partition(sessions, at10()).first() == (1, 1)
    assert integrity.orphan_files(files, sessions, as_of=at10(), min_age_ms=60_000).count() == 0
    plan = {(r.kind, r.id) for r in integrity.deletion_plan(sessions, files, chunks, at10()).collect()}
    assert plan == {("file", "f4"), ("chunks", "f9"), ("session", "999999"), ("file", "f1")}


def test_cascade_delete(spark, store):
    left = mutations.cascade_delete(*store, spark.createDataFrame([("999999",)], "code string"))
    assert [ids(left[0], "files_id"), ids(left[1]), ids(left[2], "code")] == [["f2"] * 3 + ["f9"] * 3, ["f2", "f3", "f4"], ["000001"]]


def test_lookups(spark, store):
    sessions = store[0]
    assert lookup.find_session(sessions, "999999").count() == 1
    assert lookup.find_session(sessions, "999999", at10()).count() == 0
    assert lookup.find_by_file(sessions, F.lit("f2"), F.lit("b" * 32), at10()).count() == 1
    shown = json.loads(lookup.as_json(lookup.retrieved(sessions.where("code = '000001'"))).first().json)
    assert [f["fileId"] for f in shown["files"]] == ["f2", "f3"]
    live = spark.createDataFrame([("000002",)], "code string")
    asked = spark.createDataFrame([("12345", None), ("999999", None), ("000001", False), ("000001", True), ("000002", None), ("777777", None)], "code string, password_ok boolean")
    got = {(r.code, r.password_ok): (r.status, r.error) for r in lookup.retrieve_outcome(asked, sessions, live, at10()).collect()}
    assert got == {
        ("12345", None): (400, "Invalid code format"),
        ("999999", None): (410, "expired"),
        ("000001", False): (401, "password_required"),
        ("000001", True): (200, None),
        ("000002", None): (404, "live_session"),
        ("777777", None): (404, "not_found"),
    }
    oid, tok = "0" * 24, "c" * 32
    stored = spark.createDataFrame([("1", None, [("n", "m", 1, oid, tok)], T0 + timedelta(days=1))], f"code string, password string, files {SCHEMAS['stored_session'].split('files ')[1].split(', expires_at')[0]}, expires_at timestamp")
    asks = spark.createDataFrame([(oid, tok, None), (oid, "123", None), ("z", tok, None), (oid, "d" * 32, None)], "file_id string, token string, password_ok boolean")
    assert sorted((r.file_id, r.token[0], r.status) for r in lookup.file_outcome(asks, stored, at10()).collect()) == [(oid, "1", 400), (oid, "c", 200), (oid, "d", 404), ("z", "c", 400)]


def test_publish_outcomes(spark):
    files = SCHEMAS["stored_session"].split("files ")[1].split(", expires_at")[0]
    rows = spark.createDataFrame([("p", "hi", []), ("", "hi", []), ("p", "<script>x</script> ", []), ("p", "x" * 200, []), ("p", "", [("a", "b", 1, "c", "d")])], f"password string, text string, files {files}")
    assert [r.status for r in lookup.publish_outcome(rows, limit=100, full=F.lit(False)).collect()] == [200, 400, 400, 400, 200]
    assert {r.status for r in lookup.publish_outcome(rows, limit=100, full=F.lit(False), enabled=False).collect()} == {503}


def test_updates_replace_or_keep(spark, store):
    files = SCHEMAS["stored_session"].split("files ")[1].split(", expires_at")[0]
    change = spark.createDataFrame([("000001", T0, [], "old", T0, "p", None), ("000001", T0 + timedelta(seconds=1), [], "new", T0, None, None)], f"code string, updated_at timestamp, files {files}, text string, expires_at timestamp, password string, burn_on_read boolean")
    row = mutations.update_sessions(store[0], change).where("code = '000001'").first()
    assert (row.text, row.files, row.expires_at, row.password, row.burn_on_read) == ("new", [], T0, "p", True)


def test_inserts_keep_codes_unique(spark, store):
    sessions = store[0]
    new = sessions.withColumn("code", F.when(F.col("code") == "999999", F.lit("5")).otherwise(F.col("code"))).unionByName(sessions.withColumn("code", F.lit("5")))
    assert ids(mutations.insert_sessions(sessions, new), "code") == ["5"]


def test_upsert_moves_to_the_end(spark):
    rows, new = spark.createDataFrame([("a", 0, 1), ("b", 1, 1)], "k string, at int, v int"), spark.createDataFrame([("a", 0, 2)], "k string, at int, v int")
    assert [tuple(r) for r in mutations.upsert_last(rows, new, "k", "at").orderBy("at").collect()] == [("b", 1, 1), ("a", 2, 2)]


def test_duplicate_suppression_keeps_repeats_of_a_selection(spark):
    rows = lambda x: spark.createDataFrame(x, "name string, size int")
    got = lookup.suppress_duplicates(rows([("a", 1)]), rows([("a", 1), ("b", 2), ("b", 2)]), ["name", "size"])
    assert sorted(tuple(r) for r in got.collect()) == [("a", 1), ("b", 2), ("b", 2)]


def test_split_and_reassemble_are_inverse(spark):
    rnd = random.Random(3)
    rows = [(i, bytes(rnd.randrange(256) for _ in range(n))) for i, n in enumerate((0, 1, 63, 64, 65, 200))]
    df = spark.createDataFrame(rows, "id int, data binary")
    back = {r.id: bytes(r.data) for r in transfer.reassemble(transfer.split(df, chunk_bytes=64), ["id"]).collect()}
    assert back == {i: d for i, d in rows if d}


@pytest.mark.parametrize(("sizes", "want"), [([0, 100000, 10], [65536, 34474, 0]), ([100000, 0, 10], [100000, 10, 0]), ([70000, 10], [70000, 10])])
def test_receiver_attribution(spark, sizes, want):
    files = spark.createDataFrame([("t", i, n) for i, n in enumerate(sizes)], "t string, file_index int, size bigint")
    lengths = [min(65536, n - o) for n in sizes for o in range(0, n, 65536)]
    chunks = spark.createDataFrame([("t", i, n) for i, n in enumerate(lengths)], "t string, seq bigint, byte_len bigint")
    got = dict.fromkeys(range(len(sizes)), 0)
    for r in transfer.attribute(chunks, files, "t", mode="receiver").collect():
        got[r.file_index] += r.byte_len
    assert list(got.values()) == want
    sent = dict.fromkeys(range(len(sizes)), 0)
    for r in transfer.attribute(chunks, files, "t").collect():
        sent[r.file_index] += r.byte_len
    assert list(sent.values()) == sizes
    assert transfer.totals(files, "t").first().chunks_total == len(lengths)
    events = [("t", 0, "json", json.dumps({"type": "meta", "files": [{"size": n} for n in sizes], "totalChunks": len(lengths)}), 0)]
    events += [("t", 1 + i, "binary", None, n) for i, n in enumerate(lengths)] + [("t", 99, "json", '{"type":"done"}', 0), ("t", 100, "binary", None, 5)]
    row = folds.receive(spark.createDataFrame(events, "transfer_id string, seq bigint, kind string, json string, byte_len bigint")).first()
    assert (row.state, row.file_bytes, row.count_matches) == ("completed", want, True)


def test_progress_with_times(spark):
    chunks = spark.createDataFrame([("t", 0, 50, T0 + timedelta(seconds=1)), ("t", 1, 50, T0 + timedelta(seconds=2))], "t string, seq int, byte_len int, ts timestamp")
    totals = spark.createDataFrame([("t", 100, T0)], "t string, bytes_total int, started timestamp")
    got = transfer.progress(chunks, totals, "t", at="ts", started="started").orderBy("seq").collect()
    assert [(r.percent, r.speed, r.time_remaining) for r in got] == [(50, 50.0, 1.0), (100, 50.0, 0.0)]


def events(spark, times, **extra):
    rows = [(i, "k", T0 + timedelta(milliseconds=ms)) for i, ms in enumerate(times)]
    return spark.createDataFrame(rows, "event_id long, key string, ts timestamp")


def test_anchored_window(spark):
    got = folds.rate_limit(events(spark, [0] * 100 + [60_000, 60_001]), ["key"], order=["event_id"]).orderBy("event_id").collect()
    assert [r.n for r in got[-3:]] == [100, 101, 1]
    assert [r.over for r in got[-3:]] == [False, True, False]


def test_lockout(spark):
    got = folds.lockout(events(spark, [0] * 10 + [1, 900_000, 900_001]), ["key"], order=["event_id"]).orderBy("event_id").collect()
    assert [r.blocked for r in got] == [False] * 10 + [True, True, False]


def test_membership(spark):
    steps = [("join", "recipient", "a"), ("join", "publisher", "publisher"), ("join", "publisher", "publisher"), ("join", "recipient", "b"), ("join", "recipient", "c"), ("leave", "recipient", "a"), ("leave", "publisher", "publisher"), ("join", "recipient", "d")]
    rows = spark.createDataFrame([(i, "1", T0 + timedelta(seconds=i), *s) for i, s in enumerate(steps)], "event_id long, code string, ts timestamp, kind string, role string, peer string")
    got = folds.membership(rows, order=["event_id"], most=2).orderBy("event_id").collect()
    assert [r.outcome for r in got] == ["recipient joined", "publisher joined", "publisher refused", "recipient ready", "session full", "recipient left", "session ended", "session not found"]


def test_http_limits(spark):
    rows = spark.createDataFrame([("publish", "i", T0 + timedelta(seconds=i), 200, i) for i in range(11)] + [("password", "i", T0 + timedelta(seconds=i), 200, i) for i in range(11)], "route string, ip string, ts timestamp, status int, n0 long")
    assert [r.over for r in folds.http_limits(rows, order=["n0"]).orderBy("n0").collect()] == [False] * 10 + [True]


def test_closed_forms(spark):
    at = lambda s: T0 + timedelta(seconds=s)
    live = spark.createDataFrame([("1", 0, 10**9), ("2", 0, 10**9)], "code string, created_at_ms long, expires_at_ms long")
    joins = spark.createDataFrame([("1", "publisher", datetime(1970, 1, 1, 0, 5))], "code string, role string, ts timestamp")
    assert ids(folds.idle_ends(live, joins), "code") == ["2"]
    pongs = spark.createDataFrame([("a", at(0)), ("b", at(40))], "conn_id string, ts timestamp")
    assert ids(folds.unresponsive(pongs, F.lit(at(60))), "conn_id") == ["a"]
    cands = spark.createDataFrame([("a", at(1)), ("a", at(9)), ("b", at(1))], "c string, ts timestamp")
    ready = spark.createDataFrame([("a", at(5))], "c string, ts timestamp")
    assert sorted((r.c, r.ts.second, r.applied_at and r.applied_at.second) for r in folds.flush_times(cands, ready, "c").collect()) == [("a", 1, 5), ("a", 9, 9), ("b", 1, None)]
    lost = spark.createDataFrame([("a", at(i), k) for i, k in enumerate(["open", *["lost"] * 6, "open", "lost"])], "c string, ts timestamp, kind string")
    got = folds.reconnects(lost, "c").orderBy("ts").collect()
    assert [r.delay_ms for r in got] == [None, 1000, 2000, 4000, 8000, 16000, None, None, 1000]
    assert [r.gave_up for r in got][6] is True
    timers = spark.createDataFrame([("1", at(5), at(0)), ("1", at(3), at(1))], "code string, expires_at timestamp, updated_at timestamp")
    assert folds.expiry_timers(timers, F.lit(at(0))).first().expires_at == at(3)
    states = spark.createDataFrame([("a", 1, "open"), ("a", 2, "failed")], "c string, seq int, state string")
    assert folds.channel_state(states, "c").first().state == "error"
    ends = spark.createDataFrame([("a", 1, "done"), ("a", 2, "abort")], "c string, seq int, type string")
    assert folds.first_end(ends, "c").first().type == "done"


def test_crypto(spark):
    rows = spark.createDataFrame([("pw", "ab" * 16, b"hello")], "p string, salt string, d binary")
    hashed = rows.withColumn("h", crypto.hash_password("p", "salt"))
    assert hashed.select(crypto.verify_password("p", "h"), crypto.verify_password(F.lit("no"), "h"), crypto.verify_password("p", F.lit("x"))).first() == (True, False, False)
    salt, iv = F.lit(b"s" * 16), F.lit(b"i" * 12)
    sealed = rows.withColumn("k", crypto.derive_key("p", salt, 1000)).withColumn("e", crypto.seal(F.col("d"), F.col("k"), salt, iv))
    got = sealed.select(crypto.open_(F.col("e"), F.col("k")).alias("x"), crypto.open_(F.col("e"), F.lit(b"0" * 32)).alias("y"), F.octet_length("e").alias("n"), crypto.parts(F.col("e"))["iv"].alias("iv")).first()
    assert (bytes(got.x), got.y, got.n, bytes(got.iv)) == (b"hello", None, 49, b"i" * 12)
    assert spark.range(3).select(crypto.random_token("id").alias("t"), crypto.random_code("id").alias("c")).where("length(t) = 32 AND length(c) = 6").count() == 3
    assert spark.createDataFrame([(b"a\xff",)], "d binary").select(crypto.decode_lenient("d")).first()[0] == "a\ufffd"


def test_sources(spark, store, tmp_path):
    (tmp_path / ".env").write_text("# c\n\nA = 1=2 \nA=3\nB=\n")
    assert {r.key: r.value for r in readers.read_env(spark, str(tmp_path / ".env")).collect()} == {"A": "1=2", "B": ""}
    frames = spark.createDataFrame([('{"type":"join"}',), ("{",), ('"' + "x" * 70000 + '"',)], "raw string")
    assert [(r.type, r.close_code) for r in readers.parse_frames(frames).select("type", "close_code").collect()] == [("join", None), (None, 1003), (None, 1009)]
    blobs = {r._id: bytes(r.data) for r in readers.read_blobs(store[1], store[2]).collect()}
    assert blobs == {"f1": b"hello world", "f2": b"hello world", "f3": b"", "f4": b""}
    head = sinks.download_headers(readers.read_blobs(store[1], store[2])).where("_id = 'f1'").first()
    assert head.content_disposition == 'attachment; filename="1.txt"'
    sinks.write_snapshot(store[1], str(tmp_path / "t"))
    assert readers.read_table(spark, str(tmp_path / "t"), "gridfs_file").count() == 4


def test_routing(spark):
    sessions = spark.createDataFrame([("1", ("publisher",), [("a",)]), ("2", None, [("b",)])], "code string, publisher struct<id: string>, recipients array<struct<id: string>>")
    frames = spark.createDataFrame([("1", "publisher", "publisher", "a"), ("1", "publisher", "publisher", None), ("1", "publisher", "publisher", "z"), ("1", "recipient", "a", None), ("2", "recipient", "b", None), ("3", "recipient", "b", None)], "code string, role string, sender string, peer_id string")
    got = [(r.target, r.error) for r in lookup.route_frames(frames, sessions).collect()]
    assert sorted(got, key=str) == sorted([("a", None), (None, "peerId required from publisher"), (None, "Recipient not found"), ("publisher", None), (None, "Publisher not connected"), (None, "Session not found")], key=str)
    urls = spark.createDataFrame([('"stun:a"',), ('["stun:a","stun:b"]',)], "j string").select(lookup.server_urls(F.try_parse_json("j")).alias("u"))
    assert [r.u for r in urls.collect()] == [["stun:a"], ["stun:a", "stun:b"]]
