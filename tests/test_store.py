"""Multipart bodies, look-ups that skip, and maintenance that is cut off."""

import hashlib
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.schemas import FILES, SCHEMAS
from tidemark.sources import multipart, snapshots

T0 = datetime(2024, 1, 1)
FORM = "multipart/form-data; boundary=XyZ"


def part(name, data, filename=None, kind=None, mark=b"XyZ"):
    head = b'Content-Disposition: form-data; name="' + name.encode() + b'"' + (b'; filename="' + filename.encode() + b'"' if filename is not None else b"")
    return b"--" + mark + b"\r\n" + head + b"\r\n" + (b"Content-Type: " + kind.encode() + b"\r\n" if kind else b"") + b"\r\n" + data + b"\r\n"


def test_parts_of_odd_bodies(spark):
    every = bytes(range(256))
    body = {
        "binary": b"preamble\r\n" + part("a", every, "ü \\\"x\\\".bin", "image/png") + part("b", b"") + b"--XyZ--\r\nepilogue --XyZ",
        "inside": part("a", b"one --XyZ two\r\n--XyZa\r\n\r\n--Xy\r\n", "f") + b"--XyZ--",
        "no end": part("a", b"1") + part("b", b"2"),
        "empty": b"",
        "only end": b"--XyZ--\r\n",
        "no name": b"--XyZ\r\nContent-Type: x/y\r\n\r\nz\r\n--XyZ--\r\n",
        "spaces": part("a", b"1").replace(b"--XyZ\r\n", b"--XyZ \t\r\n") + b"--XyZ-- \r\n",
        "null": None,
    }
    rows = [(k, v, FORM) for k, v in body.items()] + [("json", b"{}", "application/json"), ("none", b"x", None), ("no mark", b"x", "multipart/form-data"), ("quoted", part("q", b"v", mark=b"a b") + b"--a b--", 'Multipart/Form-Data; boundary="a b"; charset=x')]
    requests = spark.createDataFrame(rows, "request_id string, body binary, content_type string")
    told = {(r.request_id, r.at): (r.kind, r.name, r.filename, r.mimeType, r.length, bytes(r.data)) for r in multipart.parts(requests).collect()}
    assert told == {
        ("binary", 0): ("file", "a", 'ü "x".bin', "image/png", 256, every),
        ("binary", 1): ("field", "b", None, "text/plain", 0, b""),
        ("inside", 0): ("file", "a", "f", "text/plain", 31, b"one --XyZ two\r\n--XyZa\r\n\r\n--Xy\r\n"),
        ("no end", 0): ("field", "a", None, "text/plain", 1, b"1"),
        ("no end", 1): ("field", "b", None, "text/plain", 3, b"2\r\n"),
        ("spaces", 0): ("field", "a", None, "text/plain", 1, b"1"),
        ("quoted", 0): ("field", "q", None, "text/plain", 1, b"v"),
    }
    errors = {r.request_id: r.error for r in multipart.outcomes(requests).collect()}
    other, cut = dict.fromkeys(("json", "none", "no mark"), "Not multipart"), dict.fromkeys(("no end", "empty", "null"), "Unexpected end of form")
    assert errors == other | cut | dict.fromkeys(("binary", "inside", "only end", "no name", "spaces", "quoted"))
    assert multipart.outcomes(requests.limit(0)).collect() == []


def test_limits_of_bodies(spark):
    files = lambda n: b"".join(part(f"f{i}", b"x", f"{i}.txt") for i in range(n)) + b"--XyZ--"
    bodies = [("20", files(20)), ("21", files(21)), ("field", part("t", b"x" * (1 << 20)) + b"--XyZ--"), ("long", part("t", b"x" * ((1 << 20) + 1)) + b"--XyZ--"), ("big", part("t", b"x" * 50, "n") + b"--XyZ--")]
    requests = spark.createDataFrame([(k, b, FORM) for k, b in bodies], "request_id string, body binary, content_type string")
    assert {r.request_id: r.error for r in multipart.outcomes(requests, file_bytes=49).collect()} == {"20": None, "21": "LIMIT_FILE_COUNT", "field": None, "long": "LIMIT_FIELD_VALUE", "big": "LIMIT_FILE_SIZE"}


def rows_read(df):
    """Rows that the scans of a query gave, and the filters pushed into them, after it has run."""
    df.collect()
    n, pushed = 0, ""
    todo = [df._jdf.queryExecution().executedPlan()]
    while todo:
        plan = todo.pop()
        if "Scan parquet" in plan.nodeName():
            n += plan.metrics().apply("numOutputRows").value()
            pushed += plan.toString()
        if plan.nodeName() == "AdaptiveSparkPlan":
            todo.append(plan.executedPlan())
        elif "QueryStage" in plan.nodeName():
            todo.append(plan.plan())
        todo += [plan.children().apply(i) for i in range(plan.children().size())]
    return n, pushed


def test_lookups_read_few_rows(spark, tmp_path):
    n = 40_000
    rows = spark.range(n).select(
        F.lpad((F.col("id") * 7919 % 1_000_000).cast("string"), 6, "0").alias("code"),
        F.lit("t").alias("text"),
        F.array(F.struct(F.lit("n").alias("name"), F.lit("m").alias("mimeType"), F.lit(1).cast("long").alias("size"), F.md5(F.col("id").cast("string")).alias("gridfsId"), F.concat(F.lit("k"), "id").alias("token"))).cast(FILES).alias("files"),
        F.timestamp_seconds(F.col("id")).alias("expires_at"),
    )
    path = str(tmp_path / "snapshot")
    snapshots.write(rows, path, keys=n, group_bytes=1 << 17)
    hit = snapshots.find_session(spark, path, f"{7919 * 100:06d}")
    assert [r.text for r in hit.collect()] == ["t"]
    read, plan = rows_read(hit)
    assert 0 < read < n / 8 and "EqualTo(code,791900)" in plan
    missing, _ = rows_read(snapshots.find_session(spark, path, "000001x"))
    assert missing == 0
    digest = hashlib.md5(b"100").hexdigest()
    found = snapshots.find_by_file(spark, path, digest, "k100", F.timestamp_seconds(F.lit(99)))
    assert [r.code for r in found.collect()] == [f"{7919 * 100:06d}"]
    read, _ = rows_read(found)
    assert read < n / 8
    assert snapshots.find_by_file(spark, path, digest, "k101", F.timestamp_seconds(F.lit(99))).count() == 0
    assert snapshots.find_by_file(spark, path, digest, "k100", F.timestamp_seconds(F.lit(100))).count() == 0


@pytest.mark.parametrize("cut", ["plan", "chunks", "files", None])
def test_maintenance_that_is_cut_off_ends_alike(spark, tmp_path, monkeypatch, cut):
    file = lambda i: {"name": i, "mimeType": None, "size": 1, "gridfsId": i, "token": None}
    sessions = spark.createDataFrame([("a", "", [file("f1")], T0, T0, None, False), ("b", "", [file("f2")], T0 + timedelta(days=1), T0, None, False)], SCHEMAS["stored_session"])
    files = spark.createDataFrame([(f"f{i}", "n", 1, 1, T0, None) for i in (1, 2, 3)], SCHEMAS["gridfs_file"])
    chunks = spark.createDataFrame([(f"c{i}", f"f{i}", 0, b"x") for i in (1, 2, 3, 4)], SCHEMAS["gridfs_chunk"])
    root = str(tmp_path / "store")
    snapshots.put(root, chunks, files, sessions)
    now = F.lit("2024-01-01 01:00:00").cast("timestamp")
    if cut:
        put = snapshots.put

        def killed(root_, *tables):
            if cut != "plan":
                tables[0].write.mode("overwrite").parquet(f"{root_}/chunks/{tables[3]}")
            if cut == "files":
                tables[1].write.mode("overwrite").parquet(f"{root_}/files/{tables[3]}")
            raise KeyboardInterrupt

        monkeypatch.setattr(snapshots, "put", killed)
        with pytest.raises(KeyboardInterrupt):
            snapshots.maintain(spark, root, 0, now)
        assert [t.count() for t in snapshots.current(spark, root)] == [4, 3, 2]  # the version before holds
        monkeypatch.setattr(snapshots, "put", put)
    # The run that comes again is told a later time, but what was planned holds.
    snapshots.maintain(spark, root, 0, now if cut is None else F.lit("2024-06-01 00:00:00").cast("timestamp"))
    left = snapshots.current(spark, root)
    assert [sorted(r[0] for r in t.collect()) for t in left] == [["c2"], ["f2"], ["b"]]
    snapshots.maintain(spark, root, 0, F.lit("2024-06-01 00:00:00").cast("timestamp"))
    assert [t.count() for t in snapshots.current(spark, root)] == [1, 1, 1]
    snapshots.maintain(spark, root, 1, F.lit("2024-06-01 00:00:00").cast("timestamp"))
    assert [t.count() for t in snapshots.current(spark, root)] == [0, 0, 0]


def test_maintenance_runs_as_a_stream(spark, tmp_path):
    from test_streaming import until

    root = str(tmp_path / "store")
    snapshots.put(root, *(spark.createDataFrame(rows, SCHEMAS[s]) for rows, s in (([("c1", "f1", 0, b"x")], "gridfs_chunk"), ([], "gridfs_file"), ([("a", "", [], T0, T0, None, False)], "stored_session"))))
    query = snapshots.maintenance(spark, root, "200 milliseconds", str(tmp_path / "cp"))
    until(query, lambda: snapshots.current(spark, root)[2].count() == 0)
    assert [t.count() for t in snapshots.current(spark, root)] == [0, 0, 0]
